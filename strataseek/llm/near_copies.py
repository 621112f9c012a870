"""Near copies by the Jaccard similarity of word shingles: SimHash and min-hash candidates, confirmed on the shingles.

Candidates. The anchor search over 128-bit fingerprints (see ``simhash``) gives close pairs,
but a distance that catches a similarity of 0.8 would also take in unrelated texts.
So texts are also candidates if one of BANDS bands of ROWS min-hashes is equal: at a similarity s
this misses (1 - s ** ROWS) ** BANDS of the pairs, by calculation 0.007 % at 0.8.

Confirmation. Candidates are gathered in connected components. Within each, texts that share a rare shingle are compared
on all of them, and only pairs of at least the wanted similarity are links; no more than a
spanning forest of these goes on. Large components are cut into blocks, and each pair
of blocks is a task of its own: nothing is capped.

Cases: texts with equal sets of shingles are one node from the start, texts without words (null, empty, blank)
too; these are like nothing else. The other cases are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.components import components
from strataseek.llm.scratch import materialize
from strataseek.llm.simhash import Limit, first_of_components, least_id, majority, near_links, remix, shingle_hashes
from strataseek.llm.slices import slices

BANDS, ROWS = 24, 5
#: Texts of one component that a task takes before the component is cut into blocks.
BLOCK = 4096
#: Texts up to which all are compared with all.
FEW = 64
#: Hashes that are permuted at a time.
CHUNK = 4096
_RNG = np.random.default_rng(42)
MULTIPLIERS, ADDENDS = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
MULTIPLIERS |= np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)]))


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band of a set of hashes; none for an empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.min([(own[at : at + CHUNK] * MULTIPLIERS + ADDENDS).min(axis=1) for at in range(0, len(own), CHUNK)], axis=0).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.T:
        key = remix(key ^ column)
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp, fp2, shingles (hash of the set), bands, __row (all columns): one row for each row of ``docs``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, lambda b: b.column(1).field(at)):
            prints, sets, keys = [], [], []
            for t in batch.column(1).field(at).cast(pa.binary()).to_pylist():
                chunks = list(shingle_hashes(t or b"", shingle))
                own = np.unique(np.concatenate([np.empty(0, np.uint64), *chunks]))
                prints.append(majority(chunks, True))
                sets.append(xxhash.xxh64_intdigest(own.tobytes()))
                keys.append(bands(own))
            both, sets = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64), np.array(sets, np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            columns = [batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sets), lists, *batch.columns[1:]]
            yield pa.record_batch(columns, names=["doc_id", "fp", "fp2", "shingles", "bands", "__row"])

    at = docs.columns.index(text_col)  # in the struct, so that the text goes to Python once
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("__row"))
    return read.mapInArrow(batches, f"doc_id long, fp long, fp2 long, shingles long, bands array<long>, __row {read.schema['__row'].dataType.simpleString()}")


def band_links(nodes: DataFrame) -> DataFrame:
    """u, v (rows): in each band, the first node of each key with the others."""
    keyed = nodes.select(F.explode("bands").alias("key"), F.col("row").alias("v"))
    firsts = keyed.groupBy("key").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "u")
    return keyed.join(firsts, "key").where("u != v").select("u", "v").distinct()


class Rare:
    """Which sets may be like a given one: those that share one of their rarest hashes.

    Two sets of at least this Jaccard similarity share a hash among the first n - ceil(similarity * n) + 1 of each, n being
    its size, in any one order of all hashes. The order here is by rarity, so few sets meet. Sets that are done leave the lists as these are read.
    """

    def __init__(self, of: dict[int, np.ndarray], similarity: float):
        order = np.argsort(np.argsort(np.bincount(np.concatenate(list(of.values()))), kind="stable"))
        firsts = {i: np.sort(order[codes])[: len(codes) - ceil(similarity * len(codes) - 1e-9) + 1] for i, codes in of.items()}
        nodes, keys = np.repeat(list(firsts), [len(x) for x in firsts.values()]), np.concatenate(list(firsts.values()))
        by = np.argsort(keys, kind="stable")
        found, starts, n = np.unique(keys[by], return_index=True, return_counts=True)
        self.lists = {int(k): nodes[by[s : s + m]] for k, s, m in zip(found, starts, n, strict=True) if m > 1}
        self.keys = {i: [k for k in x.tolist() if k in self.lists] for i, x in firsts.items()}

    def __call__(self, node: int, alive: np.ndarray) -> np.ndarray:
        met = []
        for k in self.keys[node]:
            own = self.lists[k]
            self.lists[k] = own = own[alive[own]]
            met.append(own)
        return np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)


def confirmed(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs of at least this Jaccard similarity, as two lists of indices. Empty sets are like nothing."""
    left, right = [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    if len(some) < 2:
        return left, right
    codes = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True)[1]
    of = dict(zip(some.tolist(), np.split(codes, np.cumsum(sizes[some])[:-1]), strict=True))
    rare = Rare(of, similarity) if len(some) > FEW else None
    mark, alive = np.zeros(codes.max() + 1, bool), sizes > 0
    for first in some.tolist():
        if not alive[first]:
            continue
        frontier = [first]
        alive[first] = False
        while frontier:
            node = frontier.pop()
            n = sizes[node]
            own = np.flatnonzero(alive) if rare is None else rare(node, alive)
            own = own[np.minimum(sizes[own], n) / np.maximum(sizes[own], n) >= similarity]
            if not len(own):
                continue
            mark[of[node]] = True
            common = np.add.reduceat(mark[np.concatenate([of[i] for i in own.tolist()])], np.cumsum(sizes[own]) - sizes[own], dtype=np.int64)
            mark[of[node]] = False
            linked = own[common / (sizes[own] + n - common) >= similarity]
            left += [node] * len(linked)
            right += linked.tolist()
            frontier += linked.tolist()
            alive[linked] = False
    return left, right


def _confirm(shingle: int, similarity: float):
    """Rows come sorted by (component, lo, hi); a group that goes over a batch's end is held until it is whole."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, sets = None, [], []

        def edges() -> pa.RecordBatch:
            a, b = confirmed(sets, similarity)
            return pa.record_batch([pa.array([row[i] for i in at], pa.int64()) for at in (a, b)], names=["u", "v"])

        for batch in it:
            own = (batch.column(c).to_pylist() for c in ("component", "lo", "hi", "row"))
            for *at, r, text in zip(*own, batch.column(batch.schema.get_field_index("__text")).cast(pa.binary()).to_pylist(), strict=True):
                if at != key:
                    if len(sets) > 1:
                        yield edges()
                    key, row, sets = at, [], []
                row.append(r)
                sets.append(shingle_set(text or b"", shingle))
        if len(sets) > 1:
            yield edges()

    return batches


def confirmed_links(candidates: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u, v (rows): edges that connect the nodes as their confirmed links do. texts: row, __text."""
    roots = components(candidates)
    members = materialize(roots.select("u", "v").union(roots.select(F.col("v").alias("u"), "v").distinct()), "candidates")
    # At most members / BLOCK components. As a table, so that its size decides whether the members are shuffled to meet it.
    crowded = materialize(
        members.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("v").alias("__crowded"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("__blocks")),
        "crowded",
    )
    dealt = (
        members.join(crowded, F.col("v") == F.col("__crowded"), "left")
        .withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
        .withColumn("__own", F.pmod(F.xxhash64("u"), F.col("__blocks")).cast("int"))
        .select(F.col("v").alias("component"), F.col("u").alias("row"), "__own", "__blocks")
        .join(texts, "row")
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .select("component", F.least("__own", "__other").alias("lo"), F.greatest("__own", "__other").alias("hi"), "row", "__text")
        .repartition("component", "lo", "hi")
        .sortWithinPartitions("component", "lo", "hi")
    )
    return materialize(dealt.mapInArrow(_confirm(shingle, similarity), "u long, v long"), "confirmed")


def near_copies(docs: DataFrame, *, shingle: int, similarity: float, threshold: int, all_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (its smallest id), is_first (of its component), __row: one row for each row of ``docs``. threshold, all_bits: of fingerprints that are candidates."""
    rows = materialize(sketches(docs, shingle, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    key = ("fp", "fp2", "shingles")
    # The bands of a group are those of its shingles, so any row's will do.
    nodes = rows.groupBy(*key).agg(F.min(least_id("doc_id", "row")).alias("first"), F.first("bands").alias("bands")).select(*key, "first.low", "first.row", "bands")
    nodes = materialize(nodes, "nodes")
    candidates = near_links(nodes, Limit(threshold, all_bits)).union(band_links(nodes))
    texts = rows.select("row", F.col(f"__row.`{text_col}`").alias("__text"))
    roots = first_of_components(nodes, confirmed_links(candidates, texts, shingle, similarity))
    labels = nodes.join(roots, F.col("row") == F.col("node"), "left")
    labels = labels.select(*(F.col(c).alias(f"__{c}") for c in key), F.coalesce("first", least_id("low", "row")).alias("root"))
    same = (F.col("fp") == F.col("__fp")) & (F.col("fp2") == F.col("__fp2")) & (F.col("shingles") == F.col("__shingles"))
    return rows.join(labels, same).select("doc_id", F.col("root.low").alias("component_id"), (F.col("row") == F.col("root.row")).alias("is_first"), "__row")
