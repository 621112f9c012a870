"""Incremental ingest: new files of a folder go into the collection as they come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from strataseek.functions.encodings import with_text
from strataseek.functions.text import is_blank
from strataseek.operators.chunking import chunk, metadata
from strataseek.operators.dependencies import dependencies
from strataseek.operators.points import chunk_id, create_collection, point_id, to_points, upsert
from strataseek.operators.postings import PostingIndex
from strataseek.operators.preprocess import preprocess
from strataseek.plans.ingest import embed, embed_once
from strataseek.providers import Embedder, HashEmbedder
from strataseek.scratch import discard, materialize
from strataseek.sources.files import decoded, with_route
from strataseek.sources.tree import UNREADABLE, register

FILE = "path string, modificationTime timestamp, length long, content binary"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a file's state knows of it: the version, and the lines at which its chunks begin.
VERSION = "hash string, codebase string, starts array<int>"
CHANGED = ("path", "codebase", "language", "hash", "modified", "content", "line_start", "line_end", "chunk_type", "name", "division", "token_count", "part")
#: Paths that are handed to the state together, as a call for each path costs more than its work. Fixed, since a path has to find its state again; a task holds one bucket's new files at a time.
BUCKETS = 1 << 16


def stream_ingest(spark: SparkSession, root: str, collection: str, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """Upserts are by id, so a micro-batch that is run again after a failure changes nothing."""
    own = embedder or HashEmbedder()
    create_collection(spark, collection, own.dim)
    raw = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(root)

    def batch(df: DataFrame, _: int) -> None:
        found = with_route(df.select("path", "content")).where(F.col("language").isNotNull())
        text = decoded(F.col("content"), F.col("language"))
        chunks = chunk(preprocess(found.withColumn("text", text).drop("content")))
        upsert(df.sparkSession, collection, to_points(embed(chunks, own), own.dim))

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Versions(StatefulProcessor):
    """The rows of a bucket of paths, each path with a version of its own in the state.

    A version that the state knows gives nothing; another gives its chunks, and a row with ``deleted`` for each chunk of the version before that has no successor.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("versions", "path string", VERSION)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest: dict[str, tuple[tuple, list[dict]]] = {}
        for row in rows:
            own = row.asDict()
            own.pop("bucket")
            at = (own["modified"] is not None, own["modified"], own["hash"])
            found = newest.get(own["path"])
            if found is None or at > found[0]:
                newest[own["path"]] = (at, [own])
            elif at == found[0]:
                found[1].append(own)
        for path, (_, found) in newest.items():
            yield from self.compared(path, found)

    def compared(self, path: str, found: list[dict]) -> Iterator[Row]:
        version, codebase = found[0]["hash"], found[0]["codebase"]
        before = self.known.getValue((path,)) or (None, None, [])
        if version == before[0] and codebase == before[1]:
            return
        live = [row for row in found if row["line_start"] is not None]
        starts = {row["line_start"] for row in live}
        self.known.updateValue((path,), (version, codebase, sorted(starts)))
        for row in live:
            yield Row(**row, deleted=False)
        for n in before[2]:
            if codebase != before[1] or n not in starts:
                yield Row(**dict.fromkeys(found[0]) | {"path": path, "codebase": before[1], "line_start": n, "part": 0, "deleted": True})

    def close(self) -> None:
        pass


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks that aren't blank of rows of ``source_tree``, with the file's hash and time; a file that can be read and has none is a row without lines."""
    readable = files.where(F.coalesce(~F.col("error").startswith(UNREADABLE), F.lit(True)))
    hashed = with_text(readable.select("path", "modified", "content", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("hash")))
    routed = with_route(hashed).where(F.col("language").isNotNull())
    chunks = chunk(preprocess(routed, "hash", "modified"), also=("hash", "modified"), keep_files=True)
    blank = is_blank(F.col("content"))
    return chunks.select(*(F.when(~blank, F.col(c)).alias(c) if c in ("line_start", "line_end") else F.col(c) for c in CHANGED))


def changes(files: DataFrame) -> DataFrame:
    """The chunks of ``file_chunks`` of new and changed files, and with ``deleted`` those that changed files no longer have. Needs the state store of RocksDB."""
    chunks = file_chunks(files).withColumn("modified", F.unix_micros("modified"))  # a number, which no time zone of a worker moves
    out = StructType([*(StructField(f.name, f.dataType) for f in chunks.schema.fields), StructField("deleted", BooleanType())])
    keyed = chunks.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))
    found = keyed.groupBy("bucket").transformWithState(Versions(), out, "Append", "None")
    return found.withColumn("modified", F.timestamp_micros("modified"))


def stream_versions(
    spark: SparkSession, root: str, collection: str, checkpoint: str, embedder: Embedder | None = None, *, store: str | None = None, index: PostingIndex | None = None, partition_bytes: int = 64 << 20
) -> StreamingQuery:
    """Keeps the collection as the tree is: files that were only touched do nothing, a changed file's old chunks go in the commit that brings the new ones.

    An emptied file loses its chunks, as does one that no encoding fits any more. One that can't be read stays as it was until it changes again; one that is taken
    from the tree stays too, since a stream only sees what is there. A micro-batch that fails leaves neither state nor points, and is run again.
    store: vectors by content as of ``embed_once``, so that chunks that a changed file keeps aren't sent again.
    """
    register(spark)
    files = spark.readStream.format("source_tree").option("path", root).option("partition_bytes", partition_bytes).load()
    return keep_versions(files, collection, checkpoint, embedder, store=store, index=index)


def keep_versions(
    files: DataFrame, collection: str, checkpoint: str, embedder: Embedder | None = None, *, store: str | None = None, index: PostingIndex | None = None
) -> StreamingQuery:
    """``stream_versions`` of any stream of files: path, modified, content, error. The session's state store becomes that of RocksDB.

    index: takes and loses the chunks that the collection does, behind it; a batch that fails in between is run again for both.
    """
    spark = files.sparkSession
    own = embedder or HashEmbedder()
    create_collection(spark, collection, own.dim)
    spark.conf.set(STATE_STORE, ROCKSDB)

    def batch(df: DataFrame, _: int) -> None:
        seen = materialize(df, "changes")  # the state is looked at once
        live = seen.where(~F.col("deleted")).withColumn("dependencies", dependencies(F.col("language"), F.col("content"))).withColumn("metadata", metadata())
        vectors = embed_once(live, own, store) if store else embed(live, own)
        gone = seen.where("deleted").select(point_id(chunk_id(F.col("codebase"), F.col("path"), F.col("line_start"))).alias("id"), F.col("path").alias("file_path"), "codebase", "part", "deleted")
        new = to_points(vectors, own.dim).withColumn("deleted", F.lit(False))
        upsert(df.sparkSession, collection, new.unionByName(gone, allowMissingColumns=True))
        if index is not None:
            index.remove(gone)
            starts = chunk_id(F.col("codebase"), F.col("path"), F.col("line_start"))
            texts = live.groupBy(point_id(starts).alias("id")).agg(F.max_by("content", "part").alias("text"))  # of equal ids the collection keeps one
            index.add(texts)
        discard(seen)

    return changes(files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
