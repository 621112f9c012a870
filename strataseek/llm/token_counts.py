"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair encoding, a sequence of pieces is the encoding of its text if and only
if each two neighbours are the encoding of their own two-piece text. So the encoding of
a prefix ends in the one piece t for which the encoding of the prefix before t ends in
a piece that may stand before t:

    count(p) = count(p - len(t)) + 1.

One pass gives the count at every prefix, and truncation ("how many characters fit in
n tokens") or budget questions ("how many tokens has this prefix") are answered from
the stored counts, without encoding again. Texts are cut where no piece of the
vocabulary spans the two characters; between the cuts the programme is kept by word.

A text's counts are stored as one signed byte for each code point: the change of the
count, which is small as one more character ends one piece of at most 16 characters.

Cases: a null text is empty; no text gives no tokens; repeated rows give repeated
results; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.wordcache import WordCache

SPACE = "▁"
#: Words whose counts a worker keeps (twice that at most).
CACHE_WORDS = 200_000
#: Texts of one round, in characters, so that memory is bounded whatever the batch.
ROUND_CHARS = 4_000_000

_COUNTS = "doc_id long, n_bytes long, n_chars long, n_tokens long, limit_chars long, prefix_deltas binary"


class PrefixCounter:
    """Prefix counts for a SentencePiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = {i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if i not in special}
        self.longest: dict[str, int] = {}  # of the pieces that end in a character
        inner = set()
        for piece in self.score:
            self.longest[piece[-1]] = max(self.longest.get(piece[-1], 0), len(piece))
            inner.update(zip(piece, piece[1:], strict=False))
        self.inner = {a + b for a, b in inner}
        # Cheap first cuts, where they are right: before a space mark that follows another character, and around line ends.
        if "\n" in self.score or any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece spans a word boundary: this model needs other cuts")
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache = WordCache(CACHE_WORDS)

    def merge(self, text: str) -> list[str]:
        """The model's encoding of a short text: merge the best-scored pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], -np.inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = (left[-1] + right[0]) not in self.inner or (left + right not in self.score and self.merge(left + right) == [left, right])
            self.pairs[left, right] = known
        return known

    def word_deltas(self, word: str, last: list[str], counts: list[int], deltas: bytearray, done: int) -> bytes:
        """Changes of the count over ``word``. The first ``done`` entries of the three lists (counts: one more) hold for its prefix already."""
        score, longest, pairs = self.score, self.longest, self.pairs
        del last[done:], counts[done + 1 :], deltas[done:]
        for end in range(done + 1, len(word) + 1):
            c = word[end - 1]
            if c not in score:  # falls back to one token for each byte
                n = len(c.encode())
                last.append("")
                counts.append(counts[-1] + n)
                deltas.append(n)
                continue
            for n in range(1, min(end, longest[c]) + 1):
                start = end - n
                piece = word[start:end]
                if piece not in score:
                    continue
                before = last[start - 1] if start else ""
                if not before or (ok := pairs.get((before, piece))) or (ok is None and self.may_follow(before, piece)):
                    last.append(piece)
                    deltas.append((counts[start] + 1 - counts[-1]) & 255)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise AssertionError(f"no piece ends the prefix {word[:end]!r}")
        return bytes(deltas)

    def fill(self, words: set[str]) -> None:
        """Adds the counts of words not known yet, in order, so that a word goes on from the prefix that it shares with the one before."""
        last: list[str] = []
        counts, deltas, previous = [0], bytearray(), ""
        self.cache.trim()
        for word in sorted(self.cache.missing(words)):
            same = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                same += 1
            self.cache[word] = self.word_deltas(word, last, counts, deltas, same)
            previous = word

    def cut(self, text: str) -> list[str]:
        """The words of a text, as the model sees it: space marks for spaces and one in front."""
        if not text:
            return []
        if "  " in text or " \n" in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return self.words.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n")).split(" ")

    def deltas(self, texts: list[str]) -> list[bytes]:
        """For each text, the change of the token count at each of its code points."""
        words = [self.cut(t) for t in texts]
        self.fill(set(chain.from_iterable(words)))
        get = self.cache.__getitem__
        out = []
        for own in words:
            d = b"".join(map(get, own))
            # The space put before the text belongs to its first character.
            out.append(bytes([(d[0] + d[1]) & 255]) + d[2:] if d else b"")
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Token count of each prefix, of 0 code points up to all."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])


def tokens_at(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(deltas, np.int8)[:n_chars].sum(dtype=np.int64))


def chars_within(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


def count_tokens(docs: DataFrame, model_file: str, *, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, limit_chars, prefix_deltas: one row for each row of ``docs``. No shuffle.

    limit_chars: where to truncate a text so that it has ``limit`` tokens at most, told from its prefix counts; all of it without a limit.
    """

    def rounds(texts: list[str]) -> Iterator[list[str]]:
        own: list[str] = []
        size = 0
        for t in texts:
            own.append(t)
            size += len(t)
            if size >= ROUND_CHARS:
                yield own
                own, size = [], 0
        if own:
            yield own

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for batch in it:
            at = 0
            for texts in rounds([t or "" for t in batch.column(1).to_pylist()]):
                deltas = count.deltas(texts)
                totals = [tokens_at(d, len(d)) for d in deltas]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array([len(d) for d in deltas], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([len(d) if limit is None or n <= limit else chars_within(d, limit) for d, n in zip(deltas, totals, strict=True)], pa.int64()),
                        pa.array(deltas, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_chars", "n_tokens", "limit_chars", "prefix_deltas"],
                )
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, _COUNTS)
