"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its
word shingles. Two fingerprints link if they differ in at most ``threshold`` bits.

Search. The 64 bits are cut into threshold // 2 + 1 segments, so that linked
fingerprints differ in at most one bit of some segment. A segment's anchors are the
words of a covering code: a Hamming code on the largest 2^r - 1 bits that fit (covering
radius 1), any bits on the rest (radius 0). A fingerprint's home is the anchor within
the covering radius; it is replicated to every anchor within the covering radius plus
the segment's threshold of 1. If x and y link, y reaches x's home in some segment. Per
anchor, each home fingerprint is compared with all that came, and no more than a
spanning forest of the links goes on, so no group emits all its pairs.

With a second threshold, fingerprints have another 64 bits, from a remix of the same
hashes, and a link must also have at most that many differing bits in all 128. 64 bits tell
texts apart too badly for the wider thresholds that a Jaccard similarity of 0.8 needs.

Equal fingerprints are one node from the start. Anchors with very many fingerprints are
cut into blocks, and each pair of blocks is a task of its own: nothing is capped.

Cases: a text without words (null, empty, blank) has fingerprint 0, which links like
any other; fewer words than a shingle are one shingle; null ids are the largest; a
component without any id has a null id; repeated rows have one component; an empty
table gives no rows; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.llm.components import components
from strataseek.llm.scratch import discard, materialize

BITS = 64
#: Hashes whose bits are counted at a time.
CHUNK = 100_000
#: Fingerprints of an anchor that one task takes before the anchor is cut into blocks.
BLOCK = 100_000
#: Comparisons of one anchor from which on it is worth a matrix of its own.
SMALL = 2048
#: Comparisons of one anchor up to which all homes are compared with all.
DIRECT = 1 << 24
#: Comparisons done at a time.
PAIRS = 1 << 21


def least_id(low: str, row: str) -> Column:
    """Struct of no_id, low and row: in its order rows with an id come first, then go by id and row."""
    return F.struct(F.col(low).isNull().alias("no_id"), F.col(low).alias("low"), F.col(row).alias("row"))


def remix(hashes: np.ndarray) -> np.ndarray:
    """Other bits from the same hashes (the finaliser of SplitMix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, CHUNK at a time. Words are cut at ASCII white space; only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        own = map(b" ".join, zip(*(words[at + k : at + k + m] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(seed)), np.uint64, count=m)


def majority(chunks: Iterable[np.ndarray], wide: bool = False) -> tuple[int, int]:
    """As unsigned numbers; the second is 0 unless ``wide``."""
    counts, n = np.zeros((1 + wide, BITS), np.int64), 0
    for hashes in chunks:
        n += len(hashes)
        for out, h in zip(counts, (hashes, remix(hashes)) if wide else (hashes,), strict=True):
            out += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    found = np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()
    return found[0], found[1] if wide else 0


def fingerprint(text: bytes, shingle: int, seed: int = 42, wide: bool = False) -> tuple[int, int]:
    return majority(shingle_hashes(text, shingle, seed), wide)


def fingerprints(docs: DataFrame, shingle: int, *, wide: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, fp, fp2 (signed) and, with ``carry``, __row (all columns): one row for each row of ``docs``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).field(at) if carry else batch.column(1)
            found = [fingerprint(t or b"", shingle, wide=wide) for t in texts.cast(pa.binary()).to_pylist()]
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1]), *batch.columns[1:]][:names], names=["doc_id", "fp", "fp2", "__row"][:names])

    # With all columns in one struct, the text goes to Python once.
    at, names = docs.columns.index(text_col) if carry else None, 4 if carry else 3
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("__row") if carry else F.col(text_col).cast("string").alias("__text"))
    kinds = "doc_id long, fp long, fp2 long" + (f", __row {docs.select(F.struct('*').alias('r')).schema[0].dataType.simpleString()}" if carry else "")
    return read.mapInArrow(batches, kinds)


# ---------------------------------------------------------------- anchors


class Segment:
    """Bits ``shift`` to ``shift + width - 1`` of a fingerprint, with their code."""

    def __init__(self, number: int, shift: int, width: int):
        self.number, self.shift, self.width = number, np.uint64(shift), width
        self.length = max(2**r - 1 for r in range(2, 5) if 2**r - 1 <= width)  # of the Hamming code
        words = np.arange(1 << self.length, dtype=np.int64)
        syndrome = np.zeros(len(words), np.int64)
        for bit in range(self.length):
            syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
        # The home: a word with syndrome s is one flip, of bit s, from its code word.
        self.home = np.where(syndrome, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
        # Code words at distance 2: flip bits i and j with i xor j = s.
        flips = [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, self.length + 1) if i != s and i < i ^ s <= self.length] for s in range(1, self.length + 1)]
        self.second = np.array([[0] * len(flips[0]), *flips], np.int64)  # by syndrome
        self.syndrome = syndrome

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, anchor, whether it is home) of every replica."""
        word = (fps >> self.shift & np.uint64((1 << self.width) - 1)).astype(np.int64)
        code, free = word & ((1 << self.length) - 1), word >> self.length
        home, s = self.home[code], self.syndrome[code]
        index = np.arange(len(fps))
        off = np.flatnonzero(s)  # a code word has no other within distance 2
        n = self.second.shape[1]
        parts = [(index, home, free)]
        parts += [(np.repeat(off, n), (code[off, None] ^ self.second[s[off]]).ravel(), np.repeat(free[off], n))]
        parts += [(index, home, free ^ (1 << bit)) for bit in range(self.width - self.length)]
        at, code, free = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = (np.int64(self.number) << 40) | (free << self.length) | code
        return at, key, np.arange(len(at)) < len(fps)


def segments(threshold: int) -> list[Segment]:
    n = threshold // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [Segment(i, a, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _replicas(threshold: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = segments(threshold)
        for batch in it:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for code in codes:
                at, key, home = code.anchors(fps)
                taken = batch.take(pa.array(at))
                yield pa.record_batch([pa.array(key), *taken.columns, pa.array(home)], names=["anchor", "fp", "fp2", "row", "home"])

    return batches


# ---------------------------------------------------------------- comparison


@dataclass(frozen=True)
class Limit:
    """When two fingerprints link. all_bits: over both halves; None if there is one half."""

    bits: int
    all_bits: int | None = None

    def near(self, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(x ^ y)
        out = apart <= self.bits
        if self.all_bits is not None and out.any():
            out &= apart.astype(np.int16) + np.bitwise_count(x2 ^ y2) <= self.all_bits
        return out


def forest(fps: np.ndarray, fps2: np.ndarray, limit: Limit) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among ``fps``, as two lists of indices."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            hit = limit.near(fps[rest], fps[node], fps2[rest], fps2[node])
            if hit.any():
                linked = rest[hit].tolist()
                left += [node] * len(linked)
                right += linked
                frontier += linked
                rest = rest[~hit]
    return left, right


def links(keys: np.ndarray, fps: np.ndarray, fps2: np.ndarray, home: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, per key, what the links of its homes connect. keys are sorted; edges are indices."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    group = np.repeat(np.arange(len(starts)), sizes)
    homes = np.bincount(group, weights=home, minlength=len(starts)).astype(np.int64)
    large = homes * sizes > DIRECT
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    dense = set(np.flatnonzero(large).tolist())

    # Groups of some size: all homes against all, as a matrix, in blocks of rows.
    medium = ~large & (homes * sizes > SMALL)
    for g in np.flatnonzero(medium).tolist():
        s, e = int(starts[g]), int(starts[g] + sizes[g])
        own = s + np.flatnonzero(home[s:e])
        step = max(1, PAIRS // (e - s))
        for at in range(0, len(own), step):
            i, j = np.nonzero(np.bitwise_count(fps[own[at : at + step], None] ^ fps[None, s:e]) <= limit.bits)
            a, b = own[at + i], s + j
            near = limit.near(fps[a], fps[b], fps2[a], fps2[b]) & (a != b)
            left.append(a[near])
            right.append(b[near])

    # Small groups: the pairs of many groups at a time.
    row = np.flatnonzero(home & (~large & ~medium)[group] & (sizes[group] > 1))
    ends = np.cumsum(sizes[group[row]])
    at = 0
    while at < len(row):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        own = row[at:to]
        n = sizes[group[own]]
        a = np.repeat(own, n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[own]], n)
        # The first half alone, before anything is looked up of the second.
        some = np.flatnonzero((np.bitwise_count(fps[a] ^ fps[b]) <= limit.bits) & (a != b))
        a, b = a[some], b[some]
        near = limit.near(fps[a], fps[b], fps2[a], fps2[b])
        left.append(a[near])
        right.append(b[near])
        at = to
    a, b = np.concatenate(left), np.concatenate(right)
    per = np.bincount(group[a], minlength=len(starts))
    many = per >= sizes
    if many.any():  # more edges than a forest of the group has
        dense.update(np.flatnonzero(many).tolist())
        few = ~many[group[a]]
        a, b = a[few], b[few]
    more: tuple[list[int], list[int]] = ([], [])
    for g in dense:
        s, e = int(starts[g]), int(starts[g] + sizes[g])
        for out, found in zip(more, forest(fps[s:e], fps2[s:e], limit), strict=True):
            out.extend(s + i for i in found)
    return np.concatenate([a, np.array(more[0], np.int64)]), np.concatenate([b, np.array(more[1], np.int64)])


def _compare(limit: Limit):
    """Rows come sorted by (anchor, lo, hi); a group that goes over a batch's end is held until it is whole."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
            fps, fps2, row = (table.column(c).to_numpy() for c in ("fp", "fp2", "row"))
            a, b = links(keys, fps.view(np.uint64), fps2.view(np.uint64), table.column("home").to_numpy(), limit)
            return pa.record_batch([pa.array(row[a]), pa.array(row[b])], names=["u", "v"])

        def numbered(table: pa.Table) -> np.ndarray:
            anchor, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "lo", "hi"))
            new = (anchor[1:] != anchor[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            return np.concatenate([[0], np.cumsum(new)])

        for batch in it:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            keys = numbered(table)
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield edges(table.slice(0, last), keys[:last])
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield edges(table, numbered(table))

    return batches


def near_links(nodes: DataFrame, limit: Limit) -> DataFrame:
    """u, v (rows): edges that connect the nodes (fp, fp2, row; one for each fingerprint) as their links do."""
    replicas = materialize(nodes.select("fp", "fp2", "row").mapInArrow(_replicas(limit.bits), "anchor long, fp long, fp2 long, row long, home boolean"), "replicas")
    # At most rows / BLOCK anchors. As a table, so that its size decides whether the replicas are shuffled to meet it.
    crowded = materialize(
        replicas.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > BLOCK)
        .select(F.col("anchor").alias("__crowded"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("__blocks")),
        "crowded",
    )
    own = F.pmod(F.xxhash64("fp", "fp2"), F.col("__blocks")).cast("int")
    dealt = (
        replicas.join(crowded, F.col("anchor") == F.col("__crowded"), "left")
        .withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
        .withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .select("anchor", F.least("__own", "__other").alias("lo"), F.greatest("__own", "__other").alias("hi"), "fp", "fp2", "row", "home")
        .repartition("anchor", "lo", "hi")
        .sortWithinPartitions("anchor", "lo", "hi")
    )
    out = materialize(dealt.mapInArrow(_compare(limit), "u long, v long"), "links")
    discard(replicas)
    discard(crowded)
    return out


def first_of_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, first (as of ``least_id``): for each node with a link, the first of its component. nodes: low, row; links: u, v (rows)."""
    roots = components(links)
    members = roots.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    least = members.join(nodes.select(F.col("row").alias("node"), "low"), "node").groupBy("root").agg(F.min(least_id("low", "node")).alias("first"))
    return members.join(least, "root").select("node", "first")


def near_duplicates(
    docs: DataFrame, *, shingle: int, threshold: int, all_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """doc_id, fp (signed), component_id (its smallest id), is_first (of its component) and, with ``carry``, __row."""
    limit = Limit(threshold, all_bits)
    found = fingerprints(docs, shingle, wide=all_bits is not None, id_col=id_col, text_col=text_col, carry=carry)
    rows = materialize(found.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    nodes = rows.groupBy("fp", "fp2").agg(F.min(least_id("doc_id", "row")).alias("first")).select("fp", "fp2", "first.low", "first.row")
    nodes = materialize(nodes, "nodes")
    roots = first_of_components(nodes, near_links(nodes, limit))
    labels = nodes.join(roots, F.col("row") == F.col("node"), "left").select(
        F.col("fp").alias("__fp"), F.col("fp2").alias("__fp2"), F.coalesce("first", least_id("low", "row")).alias("root")
    )
    return rows.join(labels, (F.col("fp") == F.col("__fp")) & (F.col("fp2") == F.col("__fp2"))).select(
        "doc_id",
        "fp",
        F.col("root.low").alias("component_id"),
        (F.col("row") == F.col("root.row")).alias("is_first"),
        *(["__row"] if carry else []),
    )
