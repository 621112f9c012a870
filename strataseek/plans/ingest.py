"""Files to points: scan, preprocess, chunk, embed, upsert."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from strataseek.config import EMBEDDING_BATCH
from strataseek.functions.text import is_blank
from strataseek.operators.chunking import chunk
from strataseek.operators.commits import listed
from strataseek.operators.points import create_collection, to_points, upsert
from strataseek.operators.preprocess import preprocess
from strataseek.providers import Embedder, HashEmbedder, embed_batches, embed_limited
from strataseek.scratch import discard, materialize
from strataseek.sources.files import scan
from strataseek.sources.tree import UNREADABLE, can_list, scan_tree


#: Seconds between the calls of a provider with a rate limit.
PAUSE = 25.0


def embed(chunks: DataFrame, embedder: Embedder, limited: bool = False, tasks: int = 1) -> DataFrame:
    """Adds embedding, in Arrow batches: a provider is called with many texts at a time, order kept.

    limited: for a provider with a rate limit, ``tasks`` tasks at a time, each with pauses as many times as long, so that together they keep to the rate of one.
    """
    chunks = chunks.coalesce(tasks) if limited else chunks
    names = chunks.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t or "" for t in batch.column(names.index("content")).to_pylist()]
            vectors = embed_limited(embedder, texts, pause=PAUSE * tasks) if limited else embed_batches(embedder, texts)
            yield pa.record_batch([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    schema = chunks.schema
    return chunks.mapInArrow(batches, StructType([*schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def embed_once(chunks: DataFrame, embedder: Embedder, store: str, *, limited: bool = False, tasks: int = 1) -> DataFrame:
    """As ``embed``, by a table of vectors at ``store``: a text that was ever embedded isn't sent again, and equal texts are sent once.

    store: for one model; a table for each run, of the vectors that it made, by the SHA-256 of the content. A run's new texts are dealt to ``tasks`` tasks by it, so
    no task is left with all of them. A run that breaks off leaves nothing, one beside it at most doubles some vectors.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("__key", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    tables = [f"{store}/{name}" for name in listed(spark, store, "_SUCCESS") if name.startswith("v")]
    fresh = keyed.select("__key", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["__key"])
    if tables:
        fresh = fresh.join(spark.read.parquet(*tables).select("__key"), "__key", "left_anti")
    dealt = fresh.repartition(tasks, "__key") if limited else fresh
    target = f"{store}/v{uuid.uuid4().hex}"
    embed(dealt, embedder, limited, tasks).select("__key", "embedding").write.parquet(target)
    vectors = spark.read.parquet(target, *tables).dropDuplicates(["__key"])
    return keyed.join(vectors, "__key").drop("__key")


def file_counts(found: int, processed: DataFrame) -> dict[str, int]:
    """files_found, files_processed, skipped_empty, errors. Files that were found but couldn't be read are errors, and don't stop the others."""
    n = processed.agg(F.count(F.lit(1)).alias("read"), F.count_if(~is_blank(F.col("code"))).alias("processed")).first()
    return {"files_found": found, "files_processed": n["processed"], "skipped_empty": n["read"] - n["processed"], "errors": found - n["read"]}


def dry_run(processed: DataFrame, chunks: DataFrame, found: int) -> dict[str, int]:
    """What an ingest would do: counts of files and chunks, and calls of the embedding provider."""
    total = chunks.count()
    return file_counts(found, processed) | {"chunks_created": total, "embedding_calls": -(-total // EMBEDDING_BATCH)}


def ingest(
    spark: SparkSession, root: str, collection: str, codebase: str | None = None, language: str | None = None, max_files: int = 0, embedder: Embedder | None = None, estimate: bool = False,
    store: str | None = None, limited: bool = False, tasks: int = 1,
) -> dict[str, int]:
    """Counters files_found, files_processed, skipped_empty, errors, chunks_created, chunks_embedded, chunks_indexed; with ``estimate``, those of ``dry_run``.

    Processed files and chunks are written to the shared folder, so that each step runs once; a chunk is embedded once.
    store, limited, tasks: of ``embed_once``, so that a text is embedded once over all ingests, and within a provider's rate.
    """
    own = embedder or HashEmbedder()
    if can_list(root):  # each file is a row, also one that is empty or can't be read
        files = materialize(scan_tree(spark, root, language, max_files), "files")
        found = files.count()
        files = files.where(F.coalesce(~F.col("error").startswith(UNREADABLE), F.lit(True))).drop("error", "encoding", "confidence")
    else:
        files = scan(spark, root, language, max_files)
        found = files.select("path").count()  # of the listing: contents aren't read for it
    if codebase:
        files = files.withColumn("codebase", F.lit(codebase))
    processed = materialize(preprocess(files), "processed")
    chunks = materialize(chunk(processed).where(~is_blank(F.col("content"))), "chunks")
    if estimate:
        return dry_run(processed, chunks, found)
    create_collection(spark, collection, own.dim)
    embedded = embed_once(chunks, own, store, limited=limited, tasks=tasks) if store else embed(chunks, own, limited, tasks)
    indexed = upsert(spark, collection, to_points(embedded, own.dim))
    created = chunks.count()
    counters = file_counts(found, processed) | {"chunks_created": created, "chunks_embedded": indexed, "chunks_indexed": indexed}
    discard(processed)
    discard(chunks)
    return counters
