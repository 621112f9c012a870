"""Connected components by alternating stars, on tables.

Each round deals the edges out twice; before it, each task replaces the edges that it
has by the stars of their own components, which needs no shuffle and shortens all paths.
It ends once each node has one edge at most and no end of an edge is a beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.scratch import discard, materialize

#: Edges that a task looks at together, which bounds its memory.
CHUNK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges that isn't the smallest of its component, and that smallest node."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(ids))  # ids are sorted, so the smallest place is that of the smallest id
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (further := label[label])).any():
            label = further
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def contracted() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.record_batch([pa.array(x) for x in stars(table.column("u").to_numpy(), table.column("v").to_numpy())], names=["u", "v"])

    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield contracted()
            held = []
    if held:
        yield contracted()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours. Edges may repeat."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these. Edges have the larger node first."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node begins one edge at most, and none that ends one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("begins"), F.lit(0).alias("ends")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("begins").alias("begins"), F.max("ends").alias("ends"))
    return per.where((F.col("begins") > 1) | ((F.col("begins") > 0) & (F.col("ends") > 0))).isEmpty()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """u, v: each node of ``edges`` (columns u and v, longs) that isn't the smallest of its component, with that smallest node.

    Minima are combined before the shuffle and the joins have one row for each node on the
    right, so a hub with very many neighbours is split, not gathered. Each round is written to the shared folder.
    """
    contracted = lambda df: materialize(df.mapInArrow(_contract, "u long, v long"), "stars")
    state = contracted(edges.select("u", "v").where("u != v"))
    for _ in range(rounds):
        new = contracted(_small_star(_large_star(state)))
        discard(state)
        state = new
        if _settled(state):
            return state
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
