"""A table of questions to ranked chunks, and to hit rates."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strataseek.config import DEFAULT_TOP_K, FEATURES
from strataseek.functions.text import is_blank, strip, tokens
from strataseek.operators.evaluation import hits_of_many
from strataseek.operators.many import bm25_many, dense_many, fuse_many
from strataseek.operators.rerank import provider_rows, rerank_many
from strataseek.providers import CrossEncoder, Embedder, HashEmbedder, embed_batches
from strataseek.scratch import materialize

log = logging.getLogger(__name__)


def asked(questions: DataFrame, embedder: Embedder) -> DataFrame:
    """question, query, feature, scope, tokens, vector: blank codebases and features that aren't given take their defaults; each query is embedded once."""
    text = lambda c: strip(F.col(c)) if c in questions.columns else F.lit(None).cast("string")
    own = questions.select("question", F.coalesce("query", F.lit("")).alias("query"), text("feature").alias("feature"), F.nullif(text("codebase"), F.lit("")).alias("scope"))
    own = own.where(~is_blank(F.col("query"))).withColumns({"feature": F.coalesce(F.nullif("feature", F.lit("")), F.lit(FEATURES[0])), "tokens": tokens(F.col("query"))})

    names = [*own.columns, "vector"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vectors = embed_batches(embedder, batch.column(1).to_pylist(), "query")
            yield pa.record_batch([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=names)

    return materialize(own.mapInArrow(batches, StructType([*own.schema.fields, StructField("vector", ArrayType(DoubleType()))])), "questions")


def cross_scores(pairs: DataFrame, encoder: CrossEncoder) -> DataFrame:
    """question, id, relevance of pairs (question, query, id, content), on the executors, one call a question. A question whose call fails has no rows."""
    schema = StructType([pairs.schema["question"], pairs.schema["id"], StructField("relevance", DoubleType())])
    names = schema.names

    def of_question(rows: pa.Table) -> pa.Table:
        given: list[tuple] = []
        try:
            given = provider_rows(rows["id"].to_pylist(), encoder.scores(rows["query"][0].as_py(), [t or "" for t in rows["content"].to_pylist()]))
        except Exception as e:
            log.warning("the cross-encoder failed, results keep the order by metadata: %s", e)
        n = len(given)
        return pa.table([rows["question"].slice(0, 1).take(pa.array([0] * n, pa.int64())), pa.array([i for i, _ in given], rows.schema.field("id").type), pa.array([s for _, s in given], pa.float64())], names=names)

    return pairs.select("question", "query", "id", "content").groupBy("question").applyInArrow(of_question, schema)


def search_many(points: DataFrame, questions: DataFrame, *, embedder: Embedder | None = None, top_k: int = DEFAULT_TOP_K, cross_encoder: CrossEncoder | None = None) -> DataFrame:
    """question, id, score, confidence, rank and payload: for each question (question, query and maybe feature, codebase) what a search for it alone finds.

    Both channels read the points once for a block of questions; what follows handles ``top_k`` rows a question. Blank queries have no rows.
    """
    own = asked(questions, embedder or HashEmbedder())
    fused = materialize(fuse_many(dense_many(points, own, 2 * top_k), bm25_many(points, own, 2 * top_k), own, top_k), "fused")
    found = points.drop("vector").join(fused.select("question", "id", F.col("fused").alias("score")), "id").join(own.select("question", "query", "feature", "tokens"), "question")
    found = found.withColumn("name", F.coalesce(F.nullif("paragraph_name", F.lit("")), "name"))
    scores = None
    if cross_encoder is not None:
        found = materialize(found, "found")
        scores = materialize(cross_scores(found, cross_encoder), "relevance")
    return rerank_many(found, scores).drop("tokens")


def evaluate(points: DataFrame, truth: DataFrame, *, embedder: Embedder | None = None, top_k: int = DEFAULT_TOP_K, cross_encoder: CrossEncoder | None = None) -> DataFrame:
    """``evaluation.hits_of_many`` of all queries of a truth table (id, query, codebase, expected_files, expected_names and maybe feature). Each is asked within its codebase."""
    kinds = ["feature"] if "feature" in truth.columns else []
    found = search_many(points, truth.select(F.col("id").alias("question"), "query", "codebase", *kinds), embedder=embedder, top_k=top_k, cross_encoder=cross_encoder)
    return hits_of_many(found.select(F.col("question").alias("id"), "rank", "file_path", "name"), truth)
