"""Hierarchical weighted hash tree: region, rack, shard.

Every shard draws an exponential time from the hash of (key, shard) divided by its
weight. A rack's draw is the earliest of its shards' draws and a region's the
earliest of its racks', so each node wins with a chance in proportion to the weight
below it. A key descends: earliest region, its earliest rack, its earliest shard.
Giving a subtree more weight can only make that subtree's draws earlier, hence rows
move into the subtree whose weight changed and nowhere else.

Law: ``key``. The shard depends on the id and the tree alone.

Cases: a null id is one key like any other; repeated rows go to one shard and take
different slots; a null text has size 8 and the CRC of no bytes; an empty table gives
no rows; further columns of the input are ignored, whatever their names; a weight that isn't
above 0, a shard number twice or an empty region or rack is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.scratch import materialize

#: Rows that one window task numbers at most, about.
ROWS_PER_BUCKET = 10_000


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0

    def __post_init__(self) -> None:
        if not (isfinite(self.weight) and self.weight > 0):
            raise ValueError(f"shard {self.number} needs a weight above 0, not {self.weight}")


@dataclass(frozen=True)
class Tree:
    """regions[i][j] is the tuple of shards of rack j in region i."""

    regions: tuple[tuple[tuple[Shard, ...], ...], ...]

    def __post_init__(self) -> None:
        numbers = [s.number for s in self.shards()]
        if not numbers or len(set(numbers)) < len(numbers) or not all(rack for region in self.regions for rack in region) or not all(self.regions):
            raise ValueError("a tree needs shards with numbers of their own, and no empty region or rack")

    @classmethod
    def even(cls, regions: int, racks: int, shards: int) -> "Tree":
        def rack(i: int, j: int) -> tuple[Shard, ...]:
            first = (i * racks + j) * shards
            return tuple(Shard(first + k) for k in range(shards))

        return cls(tuple(tuple(rack(i, j) for j in range(racks)) for i in range(regions)))

    def shards(self) -> list[Shard]:
        return [s for region in self.regions for rack in region for s in rack]

    def grown(self, region: int, rack: int, weight: float = 1.0) -> "Tree":
        """The same tree with one more shard in the given rack."""
        new = Shard(max(s.number for s in self.shards()) + 1, weight)
        racks = list(self.regions[region])
        racks[rack] = (*racks[rack], new)
        regions = list(self.regions)
        regions[region] = tuple(racks)
        return replace(self, regions=tuple(regions))


def _draw(key: Column, shard: Shard) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"shard-{shard.number}"), key), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(shard.weight))


def _earliest(draws: list[Column]) -> Column:
    return draws[0] if len(draws) == 1 else F.least(*draws)


def _descend(draws: list[Column], below: list[Column]) -> Column:
    """below[i] for the first i whose draw is the earliest."""
    if len(draws) == 1:
        return below[0]
    first = _earliest(draws)
    out = F.when(draws[0] == first, below[0])
    for draw, node in zip(draws[1:-1], below[1:-1], strict=True):
        out = out.when(draw == first, node)
    return out.otherwise(below[-1])


def _with_shard(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Adds column ``out``. One projection per level, so that each draw is computed once."""
    own = df.columns
    leaves = {s.number: F.col(f"__d{s.number}") for s in tree.shards()}
    df = df.select(*own, *(_draw(F.col(key), s).alias(f"__d{s.number}") for s in tree.shards()))
    racks = [
        (
            _earliest([leaves[s.number] for s in rack]).alias(f"__r{i}_{j}"),
            _descend([leaves[s.number] for s in rack], [F.lit(s.number) for s in rack]).alias(f"__s{i}_{j}"),
        )
        for i, region in enumerate(tree.regions)
        for j, rack in enumerate(region)
    ]
    df = df.select(*own, *(c for pair in racks for c in pair))
    regions = []
    for i, region in enumerate(tree.regions):
        draws = [F.col(f"__r{i}_{j}") for j in range(len(region))]
        regions += [_earliest(draws).alias(f"__r{i}"), _descend(draws, [F.col(f"__s{i}_{j}") for j in range(len(region))]).alias(f"__s{i}")]
    df = df.select(*own, *regions)
    n = range(len(tree.regions))
    return df.select(*own, _descend([F.col(f"__r{i}") for i in n], [F.col(f"__s{i}") for i in n]).cast("int").alias(out))


def assign_shards(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    The text is read once and only its size and CRC go on. Slots are gapless within a
    shard: rows are dealt to even buckets, numbered inside (shard, bucket), and moved up
    by the counts of the buckets before, so no task holds a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = _with_shard(rows, "doc_id", tree, "shard")
    if grown is not None:
        rows = _with_shard(rows, "doc_id", grown, "grown_shard")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "shards")

    buckets = max(32, ceil(rows.count() / ROWS_PER_BUCKET / max(1, len(tree.shards()))))
    rows = rows.withColumn("__bucket", F.pmod("__row", F.lit(buckets)))
    before = (
        rows.groupBy("shard", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n")
    )
    numbered = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__row")))
    return numbered.join(before, ["shard", "__bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__before") + F.col("__rank") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
