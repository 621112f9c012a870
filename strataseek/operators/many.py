"""Both channels for a table of questions at once.

Questions go in blocks of bounded size; a block is held by every task and meets all points in one pass: vectors by a product of two
matrices for each Arrow batch, terms by the postings of the batch's rows. A task keeps the best of each question over all its batches, so
what it passes on is ``k`` rows a question, whatever it has read; a last cut for each question puts the tasks' best together.

Order: by the score, rounded to ``DIGITS`` digits, then by id; a total order, so equal points can't crowd a task.
A question's ``scope`` (null: all) is the codebase that it is asked in. As in a search for one question, term statistics are then those of its scope.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from strataseek.config import BM25_B, BM25_K1, EQUAL_FUSION, IDENTIFIER_WEIGHTS, SEMANTIC_WEIGHTS
from strataseek.operators.retrieval import is_identifier_query, terms
from strataseek.scratch import materialize

DIGITS = 9
#: Of a block of questions: how many, and their numbers or terms together.
QUESTIONS, NUMBERS = 512, 1 << 20
#: Cells of the matrix of points by questions that are scored together.
SCORES = 1 << 19
#: Words of documents that are looked up together, and pairs of a document's term and a question that are scored together (one document may have more).
WORDS, PAIRS = 1 << 18, 1 << 18


class Best:
    """The ``k`` best of each question so far, by score, then id."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor = k, np.full(questions, -np.inf)
        self.held: list[pa.Table] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: pa.Array, **more: pa.Array) -> None:
        """scores: points by questions, NaN where a point is no hit. more: further columns of the points."""
        scores = np.round(scores, DIGITS)
        with np.errstate(invalid="ignore"):
            question, point = np.nonzero((scores >= self.floor).T)
        at = pa.array(point)
        self.held.append(pa.table({"q": question, "score": scores[point, question], "id": ids.take(at)} | {c: v.take(at) for c, v in more.items()}))
        self.size += len(question)
        if self.size > 4 * self.k * len(self.floor) + SCORES:
            self.cut()

    def cut(self) -> None:
        found = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = found["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = found["score"].to_numpy()[last]
        self.held = [found.filter(pa.array(rank < self.k))]
        self.size = len(self.held[0])

    def rows(self, questions: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.cut()
            found = self.held[0].combine_chunks()
            more = {c: found[c] for c in found.column_names[3:]}
            yield from pa.table({"question": questions.take(found["q"].combine_chunks()), "id": found["id"], "score": found["score"]} | more).to_batches()


def slices(batch: pa.RecordBatch, weights: np.ndarray, most: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose rows weigh ``most`` together, or are a single one; of ``rows`` rows at most."""
    ends, at = np.cumsum(weights), 0
    while at < len(weights):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = max(at + 1, fit if rows is None else min(fit, at + rows))
        yield batch.slice(at, to - at)
        at = to


def blocks(questions: DataFrame, size: Callable[[Row], int]) -> Iterator[list[Row]]:
    """The rows of ``questions`` in lists of bounded size, one after the other."""
    held: list[Row] = []
    numbers = 0
    for row in questions.toLocalIterator():
        if held and (len(held) >= QUESTIONS or numbers + size(row) > NUMBERS):
            yield held
            held, numbers = [], 0
        held.append(row)
        numbers += size(row)
    if held:
        yield held


def best_of_questions(hits: DataFrame, k: int) -> DataFrame:
    """question, id, score, rank: the k best of each question. Spark cuts inside tasks before it shuffles."""
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scoped(questions: DataFrame) -> DataFrame:
    return questions if "scope" in questions.columns else questions.withColumn("scope", F.lit(None).cast("string"))


def _out(points: DataFrame, questions: DataFrame, id_col: str) -> StructType:
    return StructType([StructField("question", questions.schema["question"].dataType), StructField("id", points.schema[id_col].dataType), StructField("score", DoubleType())])


def _arrow(values: list, field: StructField) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array(values, to_arrow_type(field.dataType))


def _in_scope(batch: pa.Array, scopes: list[str | None]) -> np.ndarray | None:
    """points by questions: whether a point is in the question's scope. None: all are."""
    if not any(s is not None for s in scopes):
        return None
    known = pa.array(sorted({s for s in scopes if s is not None}), pa.string())
    own = pc.fill_null(pc.index_in(batch, value_set=known), -1).to_numpy(zero_copy_only=False)
    wanted = np.array([-2 if s is None else known.index(s).as_py() for s in scopes])
    return (wanted[None, :] == -2) | (own[:, None] == wanted[None, :])


def _all_of(parts: list[DataFrame], empty: DataFrame, schema: StructType) -> DataFrame:
    out = empty.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def dense_many(points: DataFrame, questions: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "vector", scope_col: str | None = "codebase") -> DataFrame:
    """question, id, score (cosine), rank: the ``k`` best points of each question (question, vector and maybe scope).

    Vectors that are null, of another width or without a length have no row, nor have such questions.
    """
    out = _out(points, questions, id_col)
    scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
    read = points.select(F.col(id_col).alias("id"), scope.alias("scope"), F.col(vector_col).cast("array<float>" if points.schema[vector_col].dataType.elementType.typeName() == "float" else "array<double>").alias("v"))
    parts = []
    for block in blocks(_scoped(questions).where("vector IS NOT NULL").select("question", "vector", "scope"), lambda r: len(r["vector"])):
        for width in sorted({len(r["vector"]) for r in block}):
            own = [r for r in block if len(r["vector"]) == width and any(r["vector"])]
            if own:
                parts.append(materialize(read.mapInArrow(_dense_pass(own, out, k), out), "dense-hits"))
    return best_of_questions(_all_of(parts, points, out), k)


def _dense_pass(block: list[Row], out: StructType, k: int) -> Callable:
    matrix = np.array([r["vector"] for r in block], np.float64)
    matrix = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).T.copy()
    ids, scopes = _arrow([r["question"] for r in block], out["question"]), [r["scope"] for r in block]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(block), k), max(1, SCORES // len(block))
        for whole in it:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(batch.column(2)), len(matrix)), False))
                batch = batch.filter(pa.array(fits))
                if not batch.num_rows:
                    continue
                vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(matrix))
                norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = vectors @ matrix / np.where(norms > 0, norms, np.nan)[:, None]
                within = _in_scope(batch.column(1), scopes)
                best.add(scores if within is None else np.where(within, scores, np.nan), batch.column(0))
        yield from best.rows(ids)

    return batches


# ---------------------------------------------------------------- BM25


@dataclass
class Asked:
    """The terms of a block of questions: by term, the questions that have it (rows ``at[code]`` to ``at[code + 1]``) and its weights there."""

    vocabulary: list[str]
    at: np.ndarray
    question: np.ndarray
    idf: np.ndarray
    mean: np.ndarray


MATCHED = [StructField("n", IntegerType()), StructField("codes", ArrayType(IntegerType())), StructField("tfs", ArrayType(LongType()))]


def _match_pass(vocabulary: list[str]) -> Callable:
    """id, scope, number of terms and, of those in the vocabulary, code and frequency."""
    known = pa.array(vocabulary, pa.string())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in it for part in slices(whole, pc.fill_null(pc.list_value_length(whole.column(2)), 0).to_numpy(zero_copy_only=False), WORDS)):
            own = batch.column(2)
            n = own.value_lengths().to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(own.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)[code >= 0]
            pairs, tf = np.unique(row * max(1, len(vocabulary)) + code[code >= 0], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(n) + 1) * max(1, len(vocabulary)))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((pairs % max(1, len(vocabulary)), pa.int32()), (tf, pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int32()), *lists], names=["id", "scope", "n", "codes", "tfs"])

    return batches


def _score_pass(asked: Asked, block: list[Row], out: StructType, k: int, k1: float, b: float) -> Callable:
    ids, scopes = _arrow([r["question"] for r in block], out["question"]), [r["scope"] for r in block]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(block), k), max(1, min(1024, SCORES // len(block)))
        for whole in it:
            met = np.append(0, np.cumsum(np.diff(asked.at)[whole.column(3).flatten().to_numpy()]))
            ends = np.append(0, np.cumsum(whole.column(3).value_lengths().to_numpy(zero_copy_only=False)))
            for batch in slices(whole, np.diff(met[ends]), PAIRS, step):
                codes = batch.column(3).flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
                # Each term of a row meets the questions that have it.
                first, times = asked.at[codes], asked.at[codes + 1] - asked.at[codes]
                pair = np.repeat(np.arange(len(codes)), times)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
                q, tf = asked.question[place], batch.column(4).flatten().to_numpy()[pair].astype(np.float64)
                n = batch.column(2).to_numpy()[row[pair]]
                part = asked.idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / asked.mean[q]))
                scores = np.bincount(row[pair] * len(block) + q, part, batch.num_rows * len(block)).reshape(batch.num_rows, len(block))
                scores[scores == 0] = np.nan
                within = _in_scope(batch.column(1), scopes)
                best.add(scores if within is None else np.where(within, scores, np.nan), batch.column(0))
        yield from best.rows(ids)

    return batches


def _statistics(matched: DataFrame, block: list[Row], vocabulary: list[str]) -> Asked:
    """Term weights of each question in its scope. What comes to the driver is a row for each term and scope that is asked for."""
    spark = matched.sparkSession
    code = {t: i for i, t in enumerate(vocabulary)}
    wanted = sorted({r["scope"] for r in block if r["scope"] is not None})
    sizes = matched.groupBy("scope").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"))
    size = {r["scope"]: r for r in sizes.where(F.col("scope").isin(wanted)).collect()} if wanted else {}
    size[None] = sizes.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    each = matched.select("scope", F.explode("codes").alias("code")).groupBy("scope", "code").agg(F.count(F.lit(1)).alias("df"))
    df = {}
    if any(r["scope"] is None for r in block):
        df |= {(None, r["code"]): r["df"] for r in each.groupBy("code").agg(F.sum("df").alias("df")).collect()}
    pairs = sorted({(r["scope"], code[t]) for r in block if r["scope"] is not None for t in r["terms"]})
    if pairs:
        df |= {(r["scope"], r["code"]): r["df"] for r in each.join(spark.createDataFrame(pairs, "scope string, code int"), ["scope", "code"]).collect()}
    rows = sorted((code[t], q) for q, r in enumerate(block) for t in r["terms"])
    docs = [float((size.get(r["scope"]) or {"docs": 0})["docs"] or 0) for r in block]
    mean = [float(s["terms"]) / s["docs"] if (s := size.get(r["scope"])) and s["docs"] else 1.0 for r in block]
    own = [df.get((block[q]["scope"], c), 0) for c, q in rows]
    idf = np.array([np.log(1 + (docs[q] - n + 0.5) / (n + 0.5)) for (_, q), n in zip(rows, own, strict=True)], np.float64)
    codes = np.array([c for c, _ in rows], np.int64)
    return Asked(vocabulary, np.searchsorted(codes, np.arange(len(vocabulary) + 1)), np.array([q for _, q in rows], np.int64), idf, np.maximum(np.array(mean), 1e-9))


def bm25_many(docs: DataFrame, questions: DataFrame, k: int, *, id_col: str = "id", text_col: str = "content", scope_col: str | None = "codebase", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """question, id, score, rank: the ``k`` best of the documents with a term of the question (question, query and maybe scope).

    A block's terms are looked up in all documents once; what is found is written, counted for the weights, and scored.
    """
    out = _out(docs, questions, id_col)
    scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
    read = docs.select(F.col(id_col).alias("id"), scope.alias("scope"), terms(F.col(text_col)).alias("terms"))
    schema = StructType([*read.schema.fields[:2], *MATCHED])
    parts = []
    for block in blocks(_scoped(questions).select("question", F.array_distinct(terms(F.col("query"))).alias("terms"), "scope"), lambda r: len(r["terms"])):
        vocabulary = sorted({t for r in block for t in r["terms"]})
        if vocabulary:
            matched = materialize(read.mapInArrow(_match_pass(vocabulary), schema), "matched-terms")
            asked = _statistics(matched, block, vocabulary)
            parts.append(materialize(matched.where(F.size("codes") > 0).mapInArrow(_score_pass(asked, block, out, k, k1, b), out), "term-hits"))
    return best_of_questions(_all_of(parts, docs, out), k)


# ---------------------------------------------------------------- fusion


def normalised(hits: DataFrame, equal: float, score: str = "score") -> DataFrame:
    """``hits`` with ``score`` scaled to 0..1 over each question's rows; ``equal`` if all are the same."""
    w = Window.partitionBy("question")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumns({"__lo": lo, "__hi": hi}).withColumn(score, F.when(F.col("__lo") == F.col("__hi"), F.lit(equal)).otherwise((F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def fuse_many(dense_hits: DataFrame, sparse_hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question, id, fused, dense, sparse, rank: the k best of each question by (fused, dense, sparse, id). Weights go by what kind of question it is."""
    d = normalised(dense_hits.select("question", "id", "score"), EQUAL_FUSION).withColumnRenamed("score", "dense")
    s = normalised(sparse_hits.select("question", "id", "score"), EQUAL_FUSION).withColumnRenamed("score", "sparse")
    both = d.join(s, ["question", "id"], "full_outer").na.fill(0.0, ["dense", "sparse"])
    named = F.coalesce(is_identifier_query(F.coalesce("query", F.lit(""))), F.lit(False))
    weights = questions.select("question", *(F.when(named, IDENTIFIER_WEIGHTS[i]).otherwise(SEMANTIC_WEIGHTS[i]).alias(f"__w{i}") for i in (0, 1)))
    fused = both.join(weights, "question").withColumn("fused", F.col("dense") * F.col("__w0") + F.col("sparse") * F.col("__w1"))
    order = Window.partitionBy("question").orderBy(*(F.col(c).desc() for c in ("fused", "dense", "sparse")), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question", "id", "fused", "dense", "sparse", "rank")
