"""Collection rows: ids, payload and idempotent upsert into partitioned Parquet tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from strataseek.config import EMBEDDING_DIM, POINT_NAMESPACE
from strataseek.errors import BackendError, ConfigError, ValidationError
from strataseek.functions.text import uuid5
from strataseek.operators.commits import ABANDONED_MS, claim, claims, listed, move, try_claim
from strataseek.scratch import delete


#: Payload fields that searches filter on.
INDEXED = ("paragraph_name", "division", "file_path", "language", "codebase")


def chunk_id(codebase: Column, path: Column, line_start: Column) -> Column:
    return F.concat_ws(":", codebase, path, line_start.cast("string"))


def point_id(chunk: Column) -> Column:
    return uuid5(POINT_NAMESPACE, chunk)


def to_points(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """chunks as of ``chunking.chunk`` with an embedding. A metadata value that is empty falls back to the chunk's field."""
    given = lambda key, own: F.coalesce(F.nullif(F.try_element_at(F.col("metadata"), F.lit(key)), F.lit("")), own)
    if "metadata" not in chunks.columns:
        chunks = chunks.withColumn("metadata", F.create_map().cast("map<string,string>"))
    number = lambda key: F.coalesce(F.try_element_at("metadata", F.lit(key)).try_cast("int"), key)
    first = number("line_start")
    own_id = chunk_id(F.col("codebase"), F.col("path"), F.col("line_start"))
    out = chunks.select(
        point_id(own_id).alias("id"),
        F.col("embedding").alias("vector"),
        "content",
        given("file_path", F.col("path")).alias("file_path"),
        first.alias("line_start"),
        F.greatest(number("line_end"), first).alias("line_end"),
        "name",
        given("paragraph_name", F.col("name")).alias("paragraph_name"),
        given("division", F.col("division")).alias("division"),
        given("chunk_type", F.col("chunk_type")).alias("chunk_type"),
        given("language", F.col("language")).alias("language"),
        given("codebase", F.col("codebase")).alias("codebase"),
        "dependencies",
        own_id.alias("chunk_id"),
        *(["part"] if "part" in chunks.columns else []),
    )
    if dim is not None:
        out = out.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"an embedding doesn't have {dim} dimensions"))))
    return out


def last_of_each(points: DataFrame, seq: Column) -> DataFrame:
    """The last row of each id by ``seq``: combined before the shuffle, rows of an id never meet in a window."""
    row = F.struct(*(F.col(c) for c in points.columns if c != "id"))
    return points.groupBy("id").agg(F.max_by(row, seq).alias("r")).select("id", "r.*")


# ---------------------------------------------------------------- collection
#
# A collection is a folder with one table for each upsert (d1, d2, ...) and now and then a base (b7: all up to d7).
# An upsert is written under a name of its own, claims the next number and takes it by a rename, so readers see each upsert all or not at
# all, and of two writers at once neither loses its rows: the later number wins where both write an id.
# A row whose ``deleted`` is true takes its id out of the collection; a base drops such rows.


def create_collection(spark: SparkSession, path: str, dim: int = EMBEDDING_DIM) -> None:
    """Note width and metric at ``path``. Nothing happens if the collection is there, unless its width is another."""
    about = f"{path}/about"
    spark.createDataFrame([(dim, "cosine")], "dim int, metric string").write.mode("ignore").parquet(about)
    found = spark.read.parquet(about).first()["dim"]
    if found != dim:
        raise ConfigError(f"{path} holds vectors of {found} numbers, not {dim}")


def _tables(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest base (0: none) and the upserts after it, in order."""
    whole = [n for n in listed(spark, path, "_SUCCESS") if n[:1] in "bd" and n[1:].isdigit()]
    base = max((int(n[1:]) for n in whole if n[0] == "b"), default=0)
    return base, sorted(int(n[1:]) for n in whole if n[0] == "d" and int(n[1:]) > base)


def _commit(spark: SparkSession, path: str, written: str) -> None:
    """Give the table at ``written`` the next number. If a base was made meanwhile that passed over the claim, it takes another."""
    while True:
        base, deltas = _tables(spark, path)
        number = claim(spark, path, "d", max([base, *deltas]) + 1)
        move(spark, written, f"{path}/d{number}")
        if _tables(spark, path)[0] < number:
            return
        written = f"{path}/d{number}"


def _write(df: DataFrame, target: str) -> None:
    """By codebase, which is also a filter's field; the others have bloom filters, and rows lie by path."""
    out = df.sortWithinPartitions("codebase", "file_path") if "file_path" in df.columns else df
    writer = out.write.mode("overwrite").partitionBy("codebase")
    for field in ("id", *INDEXED):
        if field in df.columns and field != "codebase":
            writer = writer.option(f"parquet.bloom.filter.enabled#{field}", "true")
    try:
        writer.parquet(target)
    except Exception as e:
        raise BackendError(f"{target}: {e}") from e


def upsert(spark: SparkSession, path: str, new: DataFrame, seq: Column | None = None, *, compact_after: int = 8) -> int:
    """Put ``new`` into the collection by id; the last write wins. Returns the rows given, repeated ids too.

    ``new`` is evaluated once. Only its own rows are written; after ``compact_after`` upserts they are put together.
    A column ``deleted``, where true, takes the id out instead, in the same commit.
    seq: which of several rows of an id in ``new`` is the last; by ``part`` if there is one, else in an order that depends on the rows alone.
    """
    if "id" not in new.columns:
        raise ValidationError("points need an id")
    if seq is None:
        seq = F.col("part") if "part" in new.columns else F.xxhash64(*(c for c in new.columns if not isinstance(new.schema[c].dataType, MapType)))
    given = Observation()
    counted = new.withColumn("__seq", seq).observe(given, F.count(F.lit(1)).alias("n"))
    latest = last_of_each(counted, F.col("__seq")).drop("__seq", "part")
    target = f"{path}/new-{uuid.uuid4().hex}"
    _write(latest, target)
    n = given.get["n"]
    if not n:
        delete(spark, target)  # a table by codebase has no file, and so no columns, without rows
        return 0
    _commit(spark, path, target)
    if len(_tables(spark, path)[1]) >= compact_after:
        compact(spark, path)
    return n


def compact(spark: SparkSession, path: str) -> None:
    """One base of all upserts up to the first that is still being put in place. What the base before had replaced is deleted; what this one replaces stays for those who are reading it."""
    base, deltas = _tables(spark, path)
    late = time.time() * 1000 - ABANDONED_MS
    pending = [n for n, at in claims(spark, path, "d").items() if n > base and n not in deltas and at > late]
    deltas = [n for n in deltas if n < min(pending, default=n + 1)]
    # One writer at a time goes on from a base, so nothing is deleted that another still puts together.
    if not deltas or not try_claim(spark, path, f"from{base}") and claims(spark, path, "from")[base] > late:
        return
    target = f"{path}/new-{uuid.uuid4().hex}"
    newest = _newest(spark, path, base, deltas)
    _write(_present(newest), target)
    if not any("=" in name for name in listed(spark, target)):
        _write(newest, target)  # a table without rows has no columns either
    move(spark, target, f"{path}/b{deltas[-1]}")
    for name in listed(spark, path):
        if name[:1] in "bd" and name[1:].isdigit() and (int(name[1:]) < base or name == f"d{base}"):
            delete(spark, f"{path}/{name}")


def _newest(spark: SparkSession, path: str, base: int, deltas: list[int]) -> DataFrame | None:
    tables = [spark.read.parquet(f"{path}/d{n}") for n in reversed(deltas)] + ([spark.read.parquet(f"{path}/b{base}")] if base else [])
    if not tables:
        return None
    out, seen = tables[0], tables[0].select("id")
    for older in tables[1:]:
        out = out.unionByName(older.join(seen, "id", "left_anti"), allowMissingColumns=True)
        seen = seen.union(older.select("id"))
    return out


def _present(points: DataFrame) -> DataFrame:
    return points.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in points.columns else points


def read_points(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest row of each id; None if there is no collection.

    Older tables lose the ids of newer ones in an anti join, whose right side is ids alone; ids of a table are read again for each older one, so the number
    of tables is kept small by ``compact``.
    """
    newest = _newest(spark, path, *_tables(spark, path))
    return None if newest is None else _present(newest)


def remove(spark: SparkSession, path: str, gone: DataFrame) -> int:
    """Take the points of ``gone`` (id, codebase) out of the collection, all or none; ids that aren't in it do nothing."""
    return upsert(spark, path, gone.select("id", "codebase", F.lit(True).alias("deleted")))
