"""Best-fit packing of documents into sequences, by linear grouping.

Documents become token ids; only those longer than a sequence are cut. Lengths are
integers up to the capacity, so a histogram of at most ``capacity`` rows decides the
whole plan, whatever the number of documents:

1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded
   up to the largest of its group, which leaves few sizes.
2. For these sizes the configuration programme (how often to use which multiset of
   sizes) is solved by column generation and rounded down.
3. Actual lengths take the places of the rounded ones. Sequences that this leaves with a gap of
   more than ``TIGHT`` tokens are opened, and their pieces go through steps 1 to 3 again, ``ROUNDS`` times in all.
4. What is left, and all small lengths, go best-fit into the gaps, tightest first.

A plan is a list of runs: "pieces number a to b of length l take sequences s, s+1, ...
at offset o". Its size depends on the capacity and the number of groups, not on the
data, so it is broadcast. Pieces find their run by their number within their length;
numbers are dealt in even buckets, so no task holds all pieces of one length.

Cases: a null or empty text is the end token alone; repeated rows are packed as often
as they occur; null ids are kept; an empty table gives no rows; only the id and text
columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.scratch import materialize
from strataseek.llm.slices import slices

#: Lengths above this share of the capacity are large.
LARGE = 1 / 8
#: Groups of large lengths.
GROUPS = 32
#: Times that pieces are grouped and solved; a configured sequence stays if its gap has at most so many tokens.
ROUNDS, TIGHT = 8, 1
#: Most bytes of words, with their ids, that a worker knows when a slice begins.
CACHE_BYTES = 4_000_000
#: ASCII characters that are neither letters nor digits nor white space, and kinds of bytes: white space 0, ASCII letters 1, those signs 2, others 3.
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
KINDS = np.array([0 if bytes([c]).isspace() else 1 if bytes([c]).isalpha() else 2 if c in SIGNS else 3 for c in range(256)], np.uint8)
ROWS_PER_BUCKET = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


# ---------------------------------------------------------------- tokens


class WordTokens:
    """Token ids of a text, joined from those of its words; ids of words used lately are kept, as Arrow arrays.

    Right for tokenizers that drop white space before anything else looks at the text:
    then the ids of a text are those of its blank-separated parts, one after the other.
    """

    def __init__(self, tokenizer_file: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        split = str(spec.get("pre_tokenizer"))
        if "Removed" not in split or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("this tokenizer doesn't drop white space: words can't be encoded by themselves")
        end = spec["model"].get("end_of_word_suffix")
        if not end or any(t["content"].rstrip(SIGNS.decode()).isalpha() or not t["content"].strip(SIGNS.decode()) for t in spec["added_tokens"]):
            raise ValueError("this tokenizer doesn't mark the ends of pieces, or an added token looks like a word: pieces can't be encoded by themselves")
        self.added = [t["content"].lower().encode() for t in spec["added_tokens"]]
        # The model alone, for pieces in byte-level form: printable bytes stand for themselves, the others for code points from 256 on, in order.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(256, 512))
        self.byte_level = "".join([chr(b) if b in plain else chr(next(rest)) for b in range(256)]).replace(chr(256 + 0x20), " ")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True
        # Known words, their ids one after the other, how many each has, and the round of its last use.
        self.words, self.ids = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.counts, self.used, self.round = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def pieces(self, word: bytes) -> bytes | None:
        """Lower-cased pieces, blank between them, of a word of letters with ASCII signs behind, or of one of the two alone; None for other words.

        The pre-tokenizer cuts such a word before the signs; the normaliser only lower-cases it.
        """
        if word.isalpha():  # ASCII letters
            return word.lower()
        core = word.rstrip(SIGNS)
        if not core:
            return word
        text = core.decode()
        low = text.lower()
        if not (text.isalpha() and low.isalpha()) or "\u03a3" in text or not is_normalized("NFC", text):
            return None
        return low.encode() + b" " + word[len(core) :] if len(core) < len(word) else low.encode()

    def encode(self, words: list[bytes], pieces: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` with pieces, then those of the others, one after the other; how many each word has."""
        cut = [x for x in pieces if x is not None]
        ids, counts = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if cut:
            found = self.model.encode_batch_fast([charmap_decode(b" ".join(cut), "strict", self.byte_level)[0]], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            last = np.cumsum([2 if b" " in x else 1 for x in cut]) - 1
            counts = np.diff(np.flatnonzero(self.ends[ids])[last] + 1, prepend=0)
        others = self.tokenizer.encode_batch_fast([w.decode() for w, x in zip(words, pieces, strict=True) if x is None], add_special_tokens=False)
        own = [e.ids for e in others]
        return np.concatenate([ids, *(np.array(x, "<u4") for x in own)]), np.concatenate([counts, np.array([len(x) for x in own], np.int64)])

    def trim(self) -> None:
        """Keeps half of ``CACHE_BYTES``, of the words used last, if there is more than that."""
        sizes = 4 * self.counts + pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        if sizes.sum() <= CACHE_BYTES:
            return
        order = np.argsort(-self.used, kind="stable")
        keep = np.zeros(len(order), bool)
        keep[order[np.cumsum(sizes[order]) <= CACHE_BYTES // 2]] = True
        self.ids = self.ids[np.repeat(keep, self.counts)]
        self.words, self.counts, self.used = self.words.filter(pa.array(keep)), self.counts[keep], self.used[keep]

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each of these distinct words among the known ones, to which absent words are added."""
        self.trim()
        self.round += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] = self.round
        absent = np.flatnonzero(at < 0)
        if len(absent):
            own = words.take(pa.array(absent)).to_pylist()
            pieces = [self.pieces(w) for w in own]
            ids, counts = self.encode(own, pieces)
            absent = absent[np.argsort([x is None for x in pieces], kind="stable")]
            at[absent] = len(self.words) + np.arange(len(absent))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(absent))])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.used = np.concatenate([self.used, np.full(len(absent), self.round)])
        return at

    def cut(self, text: bytes) -> tuple[np.ndarray, pa.Array]:
        """Where the words of ``text`` begin, and the words. ASCII signs between an ASCII letter and white space are a word of their own, and A-Z are lower-cased.

        But neither where an added token may stand, or an accent (lead byte CC) that could compose with a letter of one case only.
        """
        low = text.lower()
        plain = b"\xcc" not in low and not any(x in low for x in self.added)
        chars = np.frombuffer(low if plain else text, np.uint8)
        kinds = KINDS[chars]
        runs = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
        own = kinds[runs]
        before, behind = np.concatenate([[0], own[:-1]]), np.concatenate([own[1:], [0]])
        begins = (own != 0) & (before == 0)
        if plain:
            begins |= (own == 2) & (before == 1) & (behind == 0)
        lengths = np.diff(runs, append=len(chars)) * (own != 0)
        ends = np.cumsum(lengths)
        offsets = np.append((ends - lengths)[begins], ends[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars[kinds != 0])])
        return runs[begins], words

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids, little-endian, 4 bytes each."""
        if not texts:
            return []
        begins, words = self.cut(b"\n".join([*texts, b""]))
        words = words.dictionary_encode()
        at = self.find(words.dictionary)[words.indices.to_numpy()]
        firsts, counts = (np.cumsum(self.counts) - self.counts)[at], self.counts[at]
        ends = np.cumsum(counts)
        found = self.ids[np.repeat(firsts - ends + counts, counts) + np.arange(counts.sum())]
        bounds = np.append(0, ends)[np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))].tolist()
        return [found[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(tokenizer_file: str) -> WordTokens:
    if tokenizer_file not in _TOKENS:
        _TOKENS[tokenizer_file] = WordTokens(tokenizer_file)
    return _TOKENS[tokenizer_file]


def cut_documents(docs: DataFrame, tokenizer_file: str, capacity: int, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, 4 bytes each): at least one row for each row of ``docs``."""
    step, end = 4 * capacity, np.array([end_id], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_file)
        for batch in slices(it, lambda b: b.column(1)):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, own in zip(batch.column(0).to_pylist(), tokens.texts(texts), strict=True):
                own += end
                for k, start in enumerate(range(0, len(own), step)):
                    piece = own[start : start + step]
                    for column, value in zip(out, (doc, k, start // 4, len(piece) // 4, piece), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, _PIECES)


# ---------------------------------------------------------------- plan


@dataclass
class Bins:
    """``count`` sequences that hold the same lengths. items: (length, times)."""

    count: int
    gap: int
    items: tuple[tuple[int, int], ...] = ()

    def filled(self, count: int, length: int, times: int) -> "Bins":
        return Bins(count, self.gap - length * times, (*self.items, (length, times)))


@dataclass
class Plan:
    """runs: (length, first piece number, pieces, first sequence, offset). Of the sequences, full ones hold one piece, configured ones come from the programme."""

    sequences: int
    runs: list[tuple[int, int, int, int, int]]
    full: int = 0
    configured: int = 0

    @classmethod
    def of(cls, packed: list[Bins]) -> "Plan":
        first, runs, taken = 0, [], Counter()
        for bins in packed:
            offset = 0
            for length, times in bins.items:
                for _ in range(times):
                    runs.append((length, taken[length], bins.count, first, offset))
                    taken[length] += bins.count
                    offset += length
            first += bins.count
        return cls(first, runs)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the greatest worth that fits (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int32)
    for k in np.argsort(-worth / sizes):
        s, w = int(sizes[k]), worth[k]
        if w <= 1e-12:
            continue
        for lo in range(s, capacity + 1, s):
            hi = min(lo + s, capacity + 1)
            new = best[lo - s : hi - s] + w
            better = new > best[lo:hi] + 1e-12
            if better.any():
                best[lo:hi][better] = new[better]
                choice[lo:hi][better] = k
    pattern = np.zeros(len(sizes), np.int64)
    room = int(best.argmax())
    while room > 0 and choice[room] >= 0:
        pattern[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return float(worth @ pattern), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, rounded down: column generation on the configuration programme."""
    n = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)  # columns of the basis
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        column = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, x / column, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        x = x - step * column
        x[out] = step
        patterns[:, out] = pattern
        pivot = inverse[out] / column[out]
        inverse = inverse - np.outer(column, pivot)
        inverse[out] = pivot
    return [(patterns[:, i].round().astype(np.int64), int(np.floor(x[i] + 1e-6))) for i in range(n) if x[i] >= 1 - 1e-6]


def grouped(lengths: Counter, groups: int) -> dict[int, int]:
    """Linear grouping: the pieces, longest first, in ``groups`` groups of equal cardinality, each rounded up to its longest. Pieces by rounded length."""
    each = max(1, ceil(sum(lengths.values()) / groups))
    demand: Counter = Counter()
    rounded, room = 0, 0
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            if not room:
                rounded, room = length, each
            n = min(left, room)
            demand[rounded] += n
            left, room = left - n, room - n
    return dict(demand)


def substitute(rest: Counter, capacity: int, groups: int, large: float) -> list[Bins]:
    """Sequences of large lengths by the configuration programme; takes from ``rest`` what it places.

    A slot of a configuration takes the longest piece that is left and no longer than the slot. Pieces shorter than
    their slots leave room, so the last slot takes the longest piece that fits what is left of the sequence.
    """
    stock = sorted(n for n in rest if n > large * capacity)
    demand = grouped(Counter({n: rest[n] for n in stock}), groups)
    if not demand:
        return []
    sizes = list(demand)

    def longest(limit: int, used: Counter) -> int:
        i = bisect_right(stock, limit)
        while i and rest[stock[i - 1]] <= used[stock[i - 1]]:
            i -= 1
        return stock[i - 1] if i else 0

    packed: list[Bins] = []
    found = configurations(np.array(sizes), np.array([demand[x] for x in sizes], float), capacity)
    slots = [([size for size, m in zip(sizes, pattern.tolist(), strict=True) for _ in range(m)], times) for pattern, times in found]
    for own, times in sorted(slots, reverse=True):
        while times:
            used: Counter = Counter()
            gap = capacity
            for size in [*own[:-1], capacity]:
                n = longest(min(size, gap), used)
                if n:
                    used[n] += 1
                    gap -= n
            if not used:
                break
            count = min(times, *(rest[n] // k for n, k in used.items()))
            packed.append(Bins(count, gap, tuple(sorted(used.items(), reverse=True))))
            times -= count
            for n, k in used.items():
                rest[n] -= k * count
                if not rest[n]:
                    del rest[n]
                    stock.remove(n)
    return packed


def best_fit(lengths: Counter, capacity: int, packed: list[Bins]) -> list[Bins]:
    """Longest first, each into the tightest gap of ``packed`` that takes it, else into a new sequence."""
    gaps: dict[int, list[Bins]] = {}
    for bins in packed:
        gaps.setdefault(bins.gap, []).append(bins)
    order = sorted(g for g in gaps if g)

    def keep(bins: Bins) -> None:
        if not bins.count:
            return
        if bins.gap and not gaps.get(bins.gap):
            insort(order, bins.gap)
        gaps.setdefault(bins.gap, []).append(bins)

    for length in sorted((n for n in lengths if lengths[n]), reverse=True):
        left = lengths[length]
        while left:
            i = bisect_left(order, length)
            if i < len(order):
                bins = gaps[order[i]].pop()
                if not gaps[order[i]]:
                    order.pop(i)
            else:
                bins = Bins(ceil(left / (capacity // length)), capacity)
            # A piece leaves the tightest gap that there is, so the next of this length follows it until no more fit.
            per = bins.gap // length
            whole = min(bins.count, left // per)
            left -= whole * per
            keep(bins.filled(whole, length, per))
            if whole < bins.count and left:
                keep(bins.filled(1, length, left))
                whole, left = whole + 1, 0
            keep(Bins(bins.count - whole, bins.gap, bins.items))
    return [bins for own in gaps.values() for bins in own if bins.items]


def contents(packed: list[Bins]) -> Counter:
    out: Counter = Counter()
    for bins in packed:
        for length, times in bins.items:
            out[length] += times * bins.count
    return out


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE, rounds: int = ROUNDS, tight: int = TIGHT) -> Plan:
    """Places for ``histogram[length]`` pieces of each length.

    In each round, sequences that substitution leaves with a gap of at most ``tight`` stay, and the pieces of the others are grouped and
    solved again: what is left is fewer pieces each time, so its groups lie elsewhere and end up narrower. Small pieces, and
    large ones that no round has placed, go best-fit.
    """
    rest = Counter({length: n for length, n in histogram.items() if n})
    full = rest.pop(capacity, 0)
    kept: list[Bins] = []
    for _ in range(rounds):
        found = substitute(rest, capacity, groups, large)
        stay = [bins for bins in found if bins.gap <= tight]
        rest += contents([bins for bins in found if bins.gap > tight])
        if not stay:
            break
        kept += stay
    plan = Plan.of(([Bins(full, 0, ((capacity, 1),))] if full else []) + best_fit(rest, capacity, kept))
    plan.full, plan.configured = full, sum(bins.count for bins in kept)
    return plan


# ---------------------------------------------------------------- placing


def place_pieces(pieces: DataFrame, capacity: int, *, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (with a column length, from 1 to the capacity) with sequence_id and offset.

    ``pieces`` is written to the shared folder once; leave out columns that needn't be shuffled.
    """
    spark = pieces.sparkSession
    own = pieces.columns
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # capacity rows at most
    plan = plan_packing(histogram, capacity, groups)

    runs = sorted(plan.runs)
    lengths = np.array([r[0] for r in runs], np.int64)
    starts, first, offsets = (np.array([r[i] for r in runs], np.int64) for i in (1, 3, 4))
    known = spark.sparkContext.broadcast(((lengths << 44) + starts, starts, first, offsets))

    buckets = max(32, ceil(sum(histogram.values()) / ROWS_PER_BUCKET))
    pieces = pieces.withColumn("__bucket", F.pmod("__row", F.lit(buckets)))
    before = (
        pieces.groupBy("length", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("length", "__bucket", F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    )
    numbered = (
        pieces.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__row")))
        .join(before, ["length", "__bucket"])
        .select(*own, (F.col("__before") + F.col("__rank") - 1).cast("long").alias("__number"))
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, first, offsets = known.value
        for batch in it:
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            length = batch.column(own.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(first[at] + number - starts[at], pa.int64()), pa.array(offsets[at], pa.int64())],
                names=[*own, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in own)
    return numbered.mapInArrow(batches, f"{kinds}, sequence_id long, offset long")


