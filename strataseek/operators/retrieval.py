"""Dense and sparse channels, normalisation and fusion."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strataseek.config import BM25_B, BM25_K1, EQUAL_FUSION, HIGH_FROM, IDENTIFIER_WEIGHTS, MEDIUM_FROM, SEMANTIC_WEIGHTS
from strataseek.scratch import fence, materialize

log = logging.getLogger(__name__)

IDENTIFIER = r"\b[A-Z0-9_-]{4,}\b"


def is_identifier_query(query: Column) -> Column:
    """Looks for a name rather than a meaning: an upper-case token of four or more, a word with - or _, or mostly upper-case words in a short query."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, "[^A-Za-z0-9_-]", "")
    loud = F.size(F.filter(words, lambda w: (F.length(bare(w)) >= 3) & (bare(w) == F.upper(bare(w))) & bare(w).rlike("[A-Za-z]")))
    n = F.size(words)
    return query.rlike(IDENTIFIER) | F.exists(words, lambda w: w.rlike("[-_]")) | ((loud >= F.greatest(F.lit(1), F.floor(n / 2))) & (n <= 6))


def channel_weights(identifier: bool) -> tuple[float, float]:
    return IDENTIFIER_WEIGHTS if identifier else SEMANTIC_WEIGHTS


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def top(scored: DataFrame, k: int, *, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """The k best by (score, id): each task keeps k rows, the driver's side of the plan merges them."""
    return scored.where(F.col(score_col).isNotNull()).orderBy(F.col(score_col).desc(), F.col(id_col)).limit(k)


# ---------------------------------------------------------------- dense


def _cosines(column: pa.ListArray, query: np.ndarray) -> np.ndarray:
    """Of each vector with the query; NaN for a null, a vector of another width or without a length."""
    out = np.full(len(column), np.nan)
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), len(query)), False))
    own = column if fits.all() else column.filter(pa.array(fits))
    vectors = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), len(query))
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * np.linalg.norm(query)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[fits] = np.where(norms > 0, vectors @ query / norms, np.nan)
    return out


def cosine_scores(points: DataFrame, query: list[float], *, id_col: str = "id", vector_col: str = "vector", best: int | None = None) -> DataFrame:
    """id, score (cosine): a matrix product for each Arrow batch, whatever the width. Vectors that don't fit the query have no row.

    best: a batch passes on no more than what may be among the ``best`` highest, ties within 1e-6 included.
    """
    q = np.array(query, np.float64)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            score = _cosines(batch.column(1), q)
            kept = ~np.isnan(score)
            if best is not None and kept.sum() > best:
                kept &= score >= np.partition(score[kept], -best)[-best] - 1e-6
            yield pa.record_batch([batch.column(0).filter(pa.array(kept)), pa.array(score[kept])], names=["id", "score"])

    read = points.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>" if points.schema[vector_col].dataType.elementType.typeName() != "float" else "array<float>"))
    return read.mapInArrow(batches, StructType([read.schema["id"], StructField("score", DoubleType())]))


def dense(points: DataFrame, query: list[float], k: int, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, score of the channel's k best. Only id and vector are read; payloads join after the cut."""
    return top(cosine_scores(points, query, id_col=id_col, vector_col=vector_col, best=k), k)


# ---------------------------------------------------------------- BM25


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, Latin-1 letters included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9à-öø-ÿ]+"), F.lit(0))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(F.array_distinct(terms(F.lit(query)))).first()[0]


def term_lists(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, n_terms, t (array of term, tf): the terms of each document, sorted and counted inside the row. No shuffle."""
    own = docs.select(F.col(id_col).alias("id"), F.sort_array(terms(F.col(text_col))).alias("t"))
    t, n = F.col("t"), F.size("t")
    # Each different term begins where its neighbour before is another.
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    own = fence(own.select("id", "t", F.when(n > 0, begins).alias("b")))
    found = F.transform("b", lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(F.col("b"), k + 1), n) - i).cast("long").alias("tf")))
    return own.select("id", n.alias("n_terms"), F.coalesce(found, F.array().cast("array<struct<term:string,tf:bigint>>")).alias("t"))


def inverted_index(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, term, tf, n_terms: one row for each term of each document."""
    own = term_lists(docs, id_col=id_col, text_col=text_col)
    return own.select("id", "n_terms", F.explode("t").alias("x")).select("id", "n_terms", "x.term", "x.tf")


def _weight(k1: float, b: float, docs: Column, mean: Column, df: Column, tf: Column, n: Column) -> Column:
    """A term's part of the score, by Robertson and Zaragoza."""
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


def bm25_scores(docs: DataFrame, query: str, *, id_col: str = "id", text_col: str = "text", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """id, score of all documents with a hit, from the texts: for collections without an index.

    Query terms are counted within each row in one pass, so no term is exploded; lengths and counts are written to the
    shared folder. Document frequencies and the mean length are a scalar subquery over them.
    """
    wanted = query_terms(docs.sparkSession, query)
    own = fence(docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")))
    counted = own.select("id", F.size("t").alias("n"), *((F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(wanted)))
    counted = materialize(counted, "term-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    any_hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(wanted))], F.lit(False))
    joined = counted.where(any_hit).withColumn("s", stats.select(F.struct("*")).scalar())
    parts = [_weight(k1, b, F.col("s.docs"), F.col("s.mean"), F.col(f"s.df{i}"), F.col(f"tf{i}"), F.col("n")) for i in range(len(wanted))]
    return joined.select("id", reduce(lambda x, y: x + y, parts, F.lit(0.0)).alias("score"))


def bm25(docs: DataFrame, query: str, k: int, **more) -> DataFrame:
    return top(bm25_scores(docs, query, **more), k)


#: Of a file of postings, on average. A task writes some such files.
POSTINGS = 1 << 17


def files_of(lists: DataFrame, buckets: int, least: int) -> int:
    """Files of a bucket, so that none grows with the collection. lists: of ``term_lists``."""
    held = lists.agg(F.sum(F.size("t"))).first()[0] or 0
    return max(least, -(-held // (buckets * POSTINGS)))


def dealt(postings: DataFrame, buckets: int, files: int, least: int, *by: str) -> DataFrame:
    """By bucket and file. Where there are more files than the least, tasks grow in number with them: two for each, as some meet in one."""
    return postings.repartition(2 * buckets * files, *by) if files > least else postings.repartition(*by)


class TextIndex:
    """An inverted index on disk: postings by bucket of the term, sorted by term, and the totals of the collection.

    A search reads the buckets of its terms alone, and of these the row groups that hold them.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64, files: int = 4):
        """files: of a bucket, so that the postings of a frequent term are written by several tasks; more where a bucket has many postings."""
        self.spark, self.path, self.buckets, self.files = spark, path.rstrip("/"), buckets, files

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> "TextIndex":
        lists = materialize(term_lists(docs, id_col=id_col, text_col=text_col), "term-lists")  # texts are read once
        found = lists.select("id", "n_terms", F.explode("t").alias("x")).select("id", "n_terms", "x.term", "x.tf").withColumn("bucket", self._bucket(F.col("term")))
        files = files_of(lists, self.buckets, self.files)
        found = found.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)))
        dealt(found, self.buckets, files, self.files, "bucket", "file").drop("file").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        lists.agg(F.count(F.lit(1)).alias("docs"), F.avg("n_terms").alias("mean")).write.mode("overwrite").parquet(f"{self.path}/totals")
        return self

    def scores(self, query: str, *, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
        """id, score of all documents with a hit."""
        wanted = query_terms(self.spark, query)
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("t")).select(self._bucket(F.col("t"))).collect()] if wanted else []
        found = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
        totals = self.spark.read.parquet(f"{self.path}/totals").select(F.struct("docs", "mean")).scalar()
        each = found.join(F.broadcast(df), "term").withColumn("s", totals)
        part = _weight(k1, b, F.col("s.docs"), F.col("s.mean"), F.col("df"), F.col("tf"), F.col("n_terms"))
        return each.groupBy("id").agg(F.sum(part).alias("score"))

    def topk(self, query: str, k: int, *, within: DataFrame | None = None) -> DataFrame:
        """id, score of the k best by (score, id). within: ids that a search is restricted to."""
        found = self.scores(query)
        return top(found.join(within.select("id"), "id", "left_semi") if within is not None else found, k)


def sparse(points: DataFrame, query: str, k: int, *, index=None, filtered: bool = False, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, score of the channel's k best among ``points``: from the index if there is one, else from the texts; nothing if there is neither.

    filtered: ``points`` is a part of what the index holds. Frequencies are those of the index, or else of ``points``. An index that fails is passed over.
    """
    if index is not None:
        own = points.select(F.col(id_col).alias("id")) if filtered else None
        try:
            return index.topk(query, k, within=own)
        except Exception as e:
            log.warning("the index of terms failed, the texts are searched: %s", e)
    if text_col not in points.columns:
        return points.sparkSession.createDataFrame([], StructType([points.select(F.col(id_col).alias("id")).schema["id"], StructField("score", DoubleType())]))
    return bm25(points, query, k, id_col=id_col, text_col=text_col)


# ---------------------------------------------------------------- fusion


def best_of_each(hits: DataFrame, *, pos_col: str | None = None) -> DataFrame:
    """The best of repeated hits of one channel, all its columns; of equal scores the first by ``pos_col``."""
    rest = [c for c in hits.columns if c not in ("id", "score")]
    if not rest:
        return hits.groupBy("id").agg(F.max("score").alias("score"))
    order = F.struct("score", *([-F.col(pos_col)] if pos_col else []))
    return hits.groupBy("id").agg(F.max("score").alias("score"), F.max_by(F.struct(*rest), order).alias("r")).select("id", "score", "r.*")


def minmax(hits: DataFrame, equal: float, *, score_col: str = "score", out: str = "norm", large: bool = False) -> DataFrame:
    """Adds the score scaled to 0..1 over all rows; ``equal`` if all scores are the same.

    Rows already cut to k meet in one window, so what made them runs once. With ``large``, for
    rows of any number, the bounds are a scalar subquery over partial minima and maxima.
    """
    if large:
        bounds = hits.agg(F.struct(F.min(score_col).alias("lo"), F.max(score_col).alias("hi")).alias("b"))
        own = [c for c in hits.columns if c != out or c == score_col]
        with_bounds = hits.select(*own, bounds.scalar().alias("__b"))
        lo, hi = F.col("__b.lo"), F.col("__b.hi")
        return with_bounds.withColumn(out, F.when(hi == lo, F.lit(equal)).otherwise((F.col(score_col) - lo) / (hi - lo))).drop("__b")
    w = Window.partitionBy(F.lit(0))
    lo, hi = F.min(score_col).over(w), F.max(score_col).over(w)
    return hits.withColumn(out, F.when(hi == lo, F.lit(equal)).otherwise((F.col(score_col) - lo) / (hi - lo)))


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, weights: tuple[float, float], k: int) -> DataFrame:
    """id, fused, dense, sparse: weighted sum of normalised channels over all ids, the k best by (fused, dense, sparse, id)."""
    dense_hits, sparse_hits = dense_hits.select("id", "score"), sparse_hits.select("id", "score")
    d = minmax(best_of_each(dense_hits), EQUAL_FUSION).select("id", F.col("norm").alias("dense"))
    s = minmax(best_of_each(sparse_hits), EQUAL_FUSION).select("id", F.col("norm").alias("sparse"))
    both = d.join(s, "id", "full_outer").select("id", F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"))
    fused = both.withColumn("fused", F.col("dense") * weights[0] + F.col("sparse") * weights[1])
    return fused.orderBy(F.col("fused").desc(), F.col("dense").desc(), F.col("sparse").desc(), "id").limit(k).select("id", "fused", "dense", "sparse")
