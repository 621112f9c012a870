"""Registered queries of the engine's own operators, over whole tables, with DuckDB SQL beside each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek import config as C
from strataseek import scratch
from strataseek.functions import text as T
from strataseek.operators import answers, chunking, dependencies, evaluation, many, points, postings, preprocess, rerank, retrieval, segment, sizing, vectors
from strataseek.sources import files
from strataseek.streaming.ingest import keep_versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SPACE = r"[\s\x1c-\x1f]"
REGISTRY = ", ".join(f"('{n}', '{lang}', {list(ext)}, {i})" for i, (n, lang, ext, *_) in enumerate(C.CODEBASES))
ROUTES = f"""registry(name, language, extensions, ord) AS (VALUES {REGISTRY}),
routes AS (SELECT extension, arg_min(language, ord) AS language, arg_min(name, ord) AS codebase
  FROM (SELECT unnest(extensions) AS extension, * EXCLUDE (extensions) FROM registry) GROUP BY extension)"""
#: A made-up path for each document, so that routing meets all kinds of extension.
EXTENSIONS = [".cob", ".F90", ".f", ".txt", "", ".cbl", ".CPY", ".f77"]
PATH_SQL = f"concat('src/', source, '/d', doc_id, ({EXTENSIONS})[(doc_id % 8 + 1)::INT])"
QUERY = "the of and retion"
VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
NS_SQL = C.POINT_NAMESPACE.replace("-", "")


class LengthEmbedder:
    """Two numbers that SQL can tell too, to see that vectors come back to their texts."""

    dim = 2

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        return [[float(len(t) % 7), float(len(t))] for t in texts]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def with_path(docs: DataFrame) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int"))
    return docs.withColumn("path", F.concat(F.lit("src/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), ext))


# ---------------------------------------------------------------- retrieval

DOT = "list_sum(list_transform(list_zip(embedding::DOUBLE[], {q}), lambda z: z[1] * z[2]))"
COS = (
    f"({DOT.format(q=VECTOR)} / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * {sum(v * v for v in VECTOR) ** 0.5!r}))"
)
DENSE = f"SELECT vec_id AS id, round({COS}, 6) AS score FROM embeddings"


def _dense(points: DataFrame, k: int, query: list[float] = VECTOR) -> DataFrame:
    hits = retrieval.cosine_scores(points, query, id_col="vec_id", vector_col="embedding", best=k)
    return retrieval.top(hits.withColumn("score", F.round("score", 6)), k)


@query("dense_topk", f"{DENSE} ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark, d):
    return _dense(table(spark, d, "embeddings"), 20)


@query("dense_topk_filtered", f"{DENSE} WHERE label = 1 ORDER BY score DESC, id LIMIT 20")
def dense_topk_filtered(spark, d):
    return _dense(table(spark, d, "embeddings").where("label = 1"), 20)


#: The width of real collections: each vector 24 times, the query's copies with other weights.
WIDE = [v * (1 + i % 5) / 5 for i in range(C.EMBEDDING_DIM // len(VECTOR)) for v in VECTOR]
WIDE_SQL = "flatten(list_transform(range(24), lambda i: embedding::DOUBLE[]))"


@query(
    "dense_topk_wide",
    f"""SELECT vec_id AS id, round(list_sum(list_transform(list_zip(w, {WIDE}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(w, lambda x: x * x))) * {sum(v * v for v in WIDE) ** 0.5!r}), 6) AS score
FROM (SELECT vec_id, {WIDE_SQL} AS w FROM embeddings) ORDER BY score DESC, id LIMIT 20""",
)
def dense_topk_wide(spark, d):
    wide = F.flatten(F.array_repeat("embedding", C.EMBEDDING_DIM // len(VECTOR)))
    return _dense(table(spark, d, "embeddings").select("vec_id", wide.alias("embedding")), 20, WIDE)


TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9à-öø-ÿ]+')"
WANTED = QUERY.split()
BM25 = f"""
c AS (SELECT doc_id AS id, len(t) AS n, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(WANTED))} FROM (SELECT doc_id, {TERMS} AS t FROM documents)),
s AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(WANTED)))} FROM c),
bm AS (SELECT id, round({' + '.join(f"ln(1 + (docs - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for i in range(len(WANTED)))}, 6) AS score
  FROM c, s WHERE {' OR '.join(f"tf{i} > 0" for i in range(len(WANTED)))})"""


def _bm25(spark, d, k):
    hits = retrieval.bm25_scores(table(spark, d, "documents"), QUERY, id_col="doc_id")
    return retrieval.top(hits.withColumn("score", F.round("score", 6)), k)


@query("bm25_topk", f"WITH {BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return _bm25(spark, d, 20)


@query("bm25_topk_indexed", f"WITH {BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk_indexed(spark, d):
    index = retrieval.TextIndex(spark, scratch.new_path(spark, "text-index"), buckets=8, files=1).write(table(spark, d, "documents"), id_col="doc_id")
    return retrieval.top(index.scores(QUERY).withColumn("score", F.round("score", 6)), 20)


def _blocks(spark) -> postings.PostingIndex:
    return postings.PostingIndex(spark, scratch.new_path(spark, "postings"), buckets=8, files=2, block_docs=32)


@query("bm25_topk_blocks", f"WITH {BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk_blocks(spark, d):
    """By postings in blocks, of which those that can't reach the twentieth aren't read."""
    index = _blocks(spark).add(table(spark, d, "documents"), id_col="doc_id")
    return index.topk(QUERY, 20).withColumn("score", F.round("score", 6))


@query("bm25_topk_after_upserts", f"WITH {BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk_after_upserts(spark, d):
    """Some documents come first with other texts, some come later; what counts is what the last upsert has left."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 5
    index = _blocks(spark).add(docs.where(k != 1).withColumn("text", F.when(k == 2, F.concat(F.lit("the of and retion the "), "source")).otherwise(F.col("text"))), id_col="doc_id")
    index.add(docs.where(k.isin(1, 3)), id_col="doc_id").add(docs.where(k == 2), id_col="doc_id")
    return index.topk(QUERY, 20).withColumn("score", F.round("score", 6))


@query("inverted_index", f"SELECT id, term, n::INT AS n_terms, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id AS id, {TERMS} AS t FROM documents)) GROUP BY id, term, n")
def inverted_index(spark, d):
    return retrieval.inverted_index(table(spark, d, "documents"), id_col="doc_id")


@query("bm25_term_stats", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TERMS}) AS term FROM documents) GROUP BY id, term) GROUP BY term")
def bm25_term_stats(spark, d):
    return retrieval.inverted_index(table(spark, d, "documents"), id_col="doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _norm(of: str, equal: float) -> str:
    return f"CASE WHEN max({of}) OVER () = min({of}) OVER () THEN {equal}::DOUBLE ELSE ({of} - min({of}) OVER ()) / (max({of}) OVER () - min({of}) OVER ()) END"


def _fused_sql(wd: float, ws: float) -> str:
    return f"""WITH {BM25},
d AS (SELECT id, {_norm('score', 1.0)} AS dense FROM ({DENSE} ORDER BY score DESC, id LIMIT 40)),
p AS (SELECT id, {_norm('score', 1.0)} AS sparse FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 40)),
f AS (SELECT id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, coalesce(dense, 0) * {wd}::DOUBLE + coalesce(sparse, 0) * {ws}::DOUBLE AS fused FROM d FULL JOIN p USING (id))
SELECT id, round(fused, 6) AS fused, round(dense, 6) AS dense, round(sparse, 6) AS sparse FROM f ORDER BY f.fused DESC, f.dense DESC, f.sparse DESC, id LIMIT 20"""


def _fused(spark, d, weights):
    out = retrieval.fuse(_dense(table(spark, d, "embeddings"), 40), _bm25(spark, d, 40), weights, 20)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("fused", "dense", "sparse")))


@query("hybrid_fuse_identifier", _fused_sql(*C.IDENTIFIER_WEIGHTS))
def hybrid_fuse_identifier(spark, d):
    return _fused(spark, d, C.IDENTIFIER_WEIGHTS)


@query("hybrid_fuse_semantic", _fused_sql(*C.SEMANTIC_WEIGHTS))
def hybrid_fuse_semantic(spark, d):
    return _fused(spark, d, C.SEMANTIC_WEIGHTS)


# ---------------------------------------------------------------- a table of questions

#: Each hundredth vector asks all vectors; each benchmark item asks all documents.
DENSE_MANY = """dm AS (SELECT q.vec_id AS question, p.vec_id AS id, round(list_sum(list_transform(list_zip(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda z: z[1] * z[2]))
 / (sqrt(list_sum(list_transform(p.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(q.embedding::DOUBLE[], lambda x: x * x)))), 9) AS score
 FROM embeddings p, embeddings q WHERE {which})"""
RANKED_MANY = "SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id)::INT AS rank FROM {of} QUALIFY rank <= {k}"
SHOWN_MANY = f"SELECT question, id, round(score, 6) AS score, rank FROM ({RANKED_MANY})"
BM25_MANY = f"""
qt AS (SELECT DISTINCT item_id AS question, unnest({TERMS}) AS term FROM benchmark),
own AS (SELECT doc_id AS id, {TERMS} AS t FROM documents),
dt AS (SELECT id, len(t) AS n, unnest(t) AS term FROM own),
tf AS (SELECT id, n, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM own),
bq AS (SELECT question, id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY question, id)"""


@query("dense_many_questions", f"WITH {DENSE_MANY.format(which='q.vec_id % 100 = 0')} {SHOWN_MANY.format(of='dm', k=20)}")
def dense_many_questions(spark, d):
    points_ = table(spark, d, "embeddings")
    asked = points_.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return many.dense_many(points_, asked, 20, id_col="vec_id", vector_col="embedding", scope_col=None).withColumn("score", F.round("score", 6))


@query("knn_index_topk", f"WITH {DENSE_MANY.format(which='q.vec_id % 100 = 0')} {SHOWN_MANY.format(of='dm', k=20)}")
def knn_index_topk(spark, d):
    """Through the index, calibrated to find all that the exact scan finds."""
    points_ = table(spark, d, "embeddings")
    asked = points_.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    named = {"id_col": "vec_id", "vector_col": "embedding", "scope_col": None}
    index = vectors.VectorIndex(spark, scratch.new_path(spark, "vector-index")).write(points_, dim=len(VECTOR), **named)
    index.calibrate(points_, asked, 20, recall=1.0, **named)
    return index.search(asked, 20).withColumn("score", F.round("score", 6))


def _benchmark(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("query"))


@query("bm25_many_questions", f"WITH {BM25_MANY} {SHOWN_MANY.format(of='bq', k=20)}")
def bm25_many_questions(spark, d):
    return many.bm25_many(table(spark, d, "documents"), _benchmark(spark, d), 20, id_col="doc_id", text_col="text", scope_col=None).withColumn("score", F.round("score", 6))


SCOPED = f"""WITH own AS (SELECT doc_id, lang, {TERMS} AS t FROM documents), qs AS (SELECT item_id AS question, (['en', 'de', 'fr', 'es'])[(item_id % 4 + 1)::INT] AS scope, text FROM benchmark),
qt AS (SELECT DISTINCT question, scope, unnest({TERMS}) AS term FROM qs),
tf AS (SELECT doc_id AS id, lang, n, term, count(*) AS tf FROM (SELECT doc_id, lang, len(t) AS n, unnest(t) AS term FROM own) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT lang, count(*) AS docs, avg(len(t)) AS mean FROM own GROUP BY lang),
bq AS (SELECT question, id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score
  FROM qt JOIN tf ON tf.term = qt.term AND tf.lang = qt.scope JOIN df ON df.term = qt.term AND df.lang = scope JOIN st ON st.lang = scope GROUP BY question, id)"""


@query("bm25_many_in_codebases", f"{SCOPED} {SHOWN_MANY.format(of='bq', k=20)}")
def bm25_many_in_codebases(spark, d):
    of = F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("question") % 4).cast("int"))
    found = many.bm25_many(table(spark, d, "documents"), _benchmark(spark, d).withColumn("scope", of), 20, id_col="doc_id", text_col="text", scope_col="lang")
    return found.withColumn("score", F.round("score", 6))


NORM_MANY = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
IDENTIFIER_MANY = f"""(SELECT item_id AS question, (regexp_matches(text, '\\b[A-Z0-9_-]{{4,}}\\b') OR len(list_filter(ws, lambda w: regexp_matches(w, '[-_]'))) > 0
 OR (len(list_filter(ws, lambda w: length(regexp_replace(w, '[^A-Za-z0-9_-]', '', 'g')) >= 3 AND regexp_replace(w, '[^A-Za-z0-9_-]', '', 'g') = upper(regexp_replace(w, '[^A-Za-z0-9_-]', '', 'g'))
 AND regexp_matches(regexp_replace(w, '[^A-Za-z0-9_-]', '', 'g'), '[A-Za-z]'))) >= greatest(1, len(ws) // 2) AND len(ws) <= 6)) AS named
 FROM (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM benchmark))"""
HYBRID_MANY = f"""WITH {BM25_MANY}, {DENSE_MANY.format(which='q.vec_id IN (SELECT item_id FROM benchmark)')},
d AS (SELECT question, id, {NORM_MANY} AS dense FROM ({RANKED_MANY.format(of='dm', k=20)}) WINDOW w AS (PARTITION BY question)),
p AS (SELECT question, id, {NORM_MANY} AS sparse FROM ({RANKED_MANY.format(of='bq', k=20)}) WINDOW w AS (PARTITION BY question)),
f AS (SELECT question, id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, coalesce(dense, 0) * (CASE WHEN named THEN {C.IDENTIFIER_WEIGHTS[0]}::DOUBLE ELSE {C.SEMANTIC_WEIGHTS[0]}::DOUBLE END)
  + coalesce(sparse, 0) * (CASE WHEN named THEN {C.IDENTIFIER_WEIGHTS[1]}::DOUBLE ELSE {C.SEMANTIC_WEIGHTS[1]}::DOUBLE END) AS fused
  FROM d FULL JOIN p USING (question, id) JOIN {IDENTIFIER_MANY} USING (question)),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY f.fused DESC, f.dense DESC, f.sparse DESC, id)::INT AS rank FROM f)
SELECT question, id, round(fused, 6) AS fused, round(dense, 6) AS dense, round(sparse, 6) AS sparse, rank FROM r WHERE rank <= 10"""


@query("hybrid_many_questions", HYBRID_MANY)
def hybrid_many_questions(spark, d):
    asked, points_ = _benchmark(spark, d), table(spark, d, "embeddings")
    with_vector = asked.join(points_.select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector")), "question")
    by_meaning = many.dense_many(points_, with_vector, 20, id_col="vec_id", vector_col="embedding", scope_col=None)
    by_terms = many.bm25_many(table(spark, d, "documents"), asked, 20, id_col="doc_id", text_col="text", scope_col=None)
    fused = many.fuse_many(by_meaning, by_terms, asked, 10)
    return fused.select("question", "id", *(F.round(c, 6).alias(c) for c in ("fused", "dense", "sparse")), "rank")


BENCHMARK_HITS = f"""(SELECT 'c' || question % 3 AS codebase, coalesce(bool_or(contains(upper(coalesce(d.text, '')), upper(b.text))), false) AS hit FROM
 (SELECT item_id AS question, text FROM benchmark) b LEFT JOIN ({RANKED_MANY.format(of='bq', k=5)}) r USING (question) LEFT JOIN documents d ON d.doc_id = r.id GROUP BY question)"""


@query("hit_rate_of_benchmark", f"WITH {BM25_MANY} SELECT codebase, count(*) FILTER (WHERE hit) AS hits, count(*) AS total, round(avg(hit::INT), 6) AS rate FROM {BENCHMARK_HITS} GROUP BY ROLLUP (codebase)")
def hit_rate_of_benchmark(spark, d):
    """Each item asks for the documents that quote it: a hit is a document among the first five that holds the whole item."""
    docs, asked = table(spark, d, "documents"), _benchmark(spark, d)
    found = many.bm25_many(docs, asked, evaluation.TOP, id_col="doc_id", text_col="text", scope_col=None)
    results = found.join(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("name")), "id").select(F.col("question").alias("id"), "rank", F.lit("").alias("file_path"), "name")
    wanted = asked.select(F.col("question").alias("id"), F.concat(F.lit("c"), (F.col("question") % 3).cast("string")).alias("codebase"), F.array().cast("array<string>").alias("expected_files"), F.array("query").alias("expected_names"))
    return evaluation.hit_rates(evaluation.hits(results, wanted)).withColumn("rate", F.round("rate", 6))


@query("channel_dedupe_best", "SELECT conv_id AS id, max(n) AS score, arg_min(role, turn) AS role, min(turn) AS pos FROM (SELECT *, length(coalesce(text, '')) AS n, max(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS best FROM conversations) WHERE n = best GROUP BY conv_id")
def channel_dedupe_best(spark, d):
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("score"), "role", F.col("turn").alias("pos"))
    return retrieval.best_of_each(hits, pos_col="pos")


for _name, _equal in (("minmax_fusion_norm", C.EQUAL_FUSION), ("minmax_rerank_norm", C.EQUAL_RERANK)):

    def _f(spark, d, equal=_equal):
        scored = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
        return retrieval.minmax(scored, equal, large=True).select("id", "score", F.round("norm", 6).alias("norm"))

    query(_name, f"SELECT id, score, round({_norm('score', _equal)}, 6) AS norm FROM (SELECT doc_id AS id, n_chars::DOUBLE AS score FROM documents)")(_f)

WORDS = f"list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
BARE = "regexp_replace(w, '[^A-Za-z0-9_-]', '', 'g')"


@query(
    "identifier_query_class",
    f"""SELECT conv_id, turn, (regexp_matches(text, '\\b[A-Z0-9_-]{{4,}}\\b') OR len(list_filter(ws, lambda w: regexp_matches(w, '[-_]'))) > 0
 OR (len(list_filter(ws, lambda w: length({BARE}) >= 3 AND {BARE} = upper({BARE}) AND regexp_matches({BARE}, '[A-Za-z]'))) >= greatest(1, len(ws) // 2) AND len(ws) <= 6)) AS identifier
FROM (SELECT *, {WORDS} AS ws FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations))""",
)
def identifier_query_class(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", retrieval.is_identifier_query(F.coalesce("text", F.lit(""))).alias("identifier"))


@query("confidence_bucket", f"SELECT id, CASE WHEN norm >= 0.75 THEN 'HIGH' WHEN norm >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT doc_id AS id, (n_chars % 101)::DOUBLE / 100 AS norm FROM documents)")
def confidence_bucket(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), retrieval.confidence((F.col("n_chars") % 101).cast("double") / 100).alias("confidence"))


# ---------------------------------------------------------------- rerank

BOOST_QUERY = "trace procedure flow of src3 d5 erent in gnucobol cobol"
BOOST_TOKENS = BOOST_QUERY.split()
TOK = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda x: lower(x)))"
CHUNK_SQL = f"""SELECT doc_id AS id, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS name, CASE doc_id % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'DATA' ELSE '' END AS division,
 {PATH_SQL} AS file_path, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS deps, CASE WHEN doc_id % 2 = 0 THEN 'gnucobol' ELSE 'blas' END AS codebase,
 CASE WHEN doc_id % 2 = 0 THEN 'cobol' ELSE 'fortran' END AS language, (n_chars % 97)::DOUBLE / 97 AS score, (doc_id % 50)::INT AS line_start, (doc_id % 50 + 5)::INT AS line_end FROM documents"""
BOOST_SQL = f"""least((CASE WHEN len({TOK.format('name')}) > 0 AND len(list_filter({TOK.format('name')}, lambda t: NOT list_contains({BOOST_TOKENS}, t))) = 0 THEN 0.2::DOUBLE ELSE 0 END)
 + (CASE WHEN division = 'PROCEDURE' THEN 0.1::DOUBLE ELSE 0 END)
 + (CASE WHEN list_has_any({TOK.format('file_path')}, {BOOST_TOKENS}) THEN 0.05::DOUBLE ELSE 0 END)
 + (CASE WHEN list_has_any({TOK.format("array_to_string(deps, ',')")}, {BOOST_TOKENS}) THEN 0.05::DOUBLE ELSE 0 END)
 + (CASE WHEN list_has_any({TOK.format("array_to_string(deps, ',')")}, {BOOST_TOKENS}) THEN 0.05::DOUBLE ELSE 0 END)
 + (CASE WHEN list_contains({BOOST_TOKENS}, codebase) THEN 0.03::DOUBLE ELSE 0 END) + (CASE WHEN list_contains({BOOST_TOKENS}, language) THEN 0.02::DOUBLE ELSE 0 END), 0.3::DOUBLE)"""


def chunk_rows(spark, d) -> DataFrame:
    docs = with_path(table(spark, d, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    even = F.col("doc_id") % 2 == 0
    return docs.select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"),
        F.when(F.col("doc_id") % 3 == 0, "PROCEDURE").when(F.col("doc_id") % 3 == 1, "DATA").otherwise("").alias("division"),
        F.col("path").alias("file_path"),
        F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("dependencies"),
        F.when(even, "gnucobol").otherwise("blas").alias("codebase"),
        F.when(even, "cobol").otherwise("fortran").alias("language"),
        ((F.col("n_chars") % 97).cast("double") / 97).alias("score"),
        (F.col("doc_id") % 50).cast("int").alias("line_start"),
        (F.col("doc_id") % 50 + 5).cast("int").alias("line_end"),
    )


@query("metadata_boost", f"SELECT id, round({BOOST_SQL}, 6) AS boost FROM ({CHUNK_SQL})")
def metadata_boost(spark, d):
    return chunk_rows(spark, d).select("id", F.round(rerank.boost(BOOST_TOKENS, "dependency_mapping"), 6).alias("boost"))


RERANKED = f"SELECT id, {_norm('boosted', 0.5)} AS s, file_path, line_start, line_end, name FROM (SELECT *, score + {BOOST_SQL} AS boosted FROM ({CHUNK_SQL}))"


@query("rerank_order", f"SELECT id, round(s, 6) AS score, CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ({RERANKED})")
def rerank_order(spark, d):
    out = rerank.rerank(chunk_rows(spark, d), BOOST_TOKENS, "dependency_mapping", large=True)
    return out.select("id", F.round("score", 6).alias("score"), "confidence")


@query("cross_encoder_blend", f"SELECT id, round({_norm('b', 0.5)}, 6) AS score FROM (SELECT r.id, s * 0.4::DOUBLE + coalesce(quality, 0) * 0.6::DOUBLE AS b FROM ({RERANKED}) r LEFT JOIN (SELECT doc_id AS id, max(quality) AS quality FROM labels GROUP BY 1) l USING (id))")
def cross_encoder_blend(spark, d):
    scores = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("relevance"))
    return rerank.rerank(chunk_rows(spark, d), BOOST_TOKENS, "dependency_mapping", scores, large=True).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- sources and routes


@query("route_by_extension", f"WITH {ROUTES} SELECT doc_id, language, codebase FROM (SELECT doc_id, lower(regexp_extract({PATH_SQL}, '[^/](\\.[^./]+)$', 1)) AS extension FROM documents) LEFT JOIN routes USING (extension)")
def route_by_extension(spark, d):
    return files.with_route(with_path(table(spark, d, "documents"))).select("doc_id", "language", "codebase")


@query("supported_files", f"WITH {ROUTES} SELECT language, codebase, count(*) AS files FROM (SELECT lower(regexp_extract({PATH_SQL}, '[^/](\\.[^./]+)$', 1)) AS extension FROM documents) JOIN routes USING (extension) GROUP BY ALL")
def supported_files(spark, d):
    docs = with_path(table(spark, d, "documents"))
    own = files.with_route(docs.where(files.is_supported(spark, F.col("path"))))
    return own.groupBy("language", "codebase").agg(F.count(F.lit(1)).alias("files"))


@query(
    "binary_sniff",
    "SELECT doc_id, b <> '' AND (doc_id % 10 = 5 OR len(regexp_extract_all(b, '[\\t\\n\\r -~]')) < strlen(b) * 0.75) AS is_binary FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 10 = 3 THEN repeat('é', n_chars::INT // 5) WHEN doc_id % 10 = 5 THEN '?' ELSE '' END AS b FROM documents)",
)
def binary_sniff(spark, d):
    k = F.col("doc_id") % 10
    more = F.when(k == 3, F.repeat(F.lit("é"), F.floor(F.col("n_chars") / 5).cast("int"))).when(k == 5, F.lit("\x00")).otherwise("")
    own = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).cast("binary").alias("content"))
    return own.select("doc_id", files.looks_binary(F.col("content")).alias("is_binary"))


@query("codebase_registry", f"WITH {ROUTES} SELECT name, language, ord::INT AS ord, array_to_string(extensions, ',') AS extensions FROM registry")
def codebase_registry(spark, d):
    return C.codebases(spark).select("name", "language", "ord", F.array_join("extensions", ",").alias("extensions"))


@query("codebase_counts", f"WITH {ROUTES} SELECT name, count(codebase) AS chunks FROM registry LEFT JOIN (SELECT CASE doc_id % 4 WHEN 0 THEN 'blas' WHEN 1 THEN 'lapack' WHEN 2 THEN 'gnucobol' END AS codebase FROM documents) ON codebase = name GROUP BY name")
def codebase_counts(spark, d):
    k = F.col("doc_id") % 4
    chunks = table(spark, d, "documents").select(F.when(k == 0, "blas").when(k == 1, "lapack").when(k == 2, "gnucobol").alias("codebase"))
    return evaluation.codebase_counts(C.codebases(spark), chunks)


@query("codebase_options", f"WITH {ROUTES} SELECT value, label, ord FROM (SELECT NULL AS value, 'All codebases' AS label, 0 AS ord UNION ALL SELECT name, coalesce(map_extract_value(MAP {C.LABELS}, name), name), ord::INT + 1 FROM registry)")
def codebase_options(spark, d):
    return C.codebase_options(spark)


FEATURE_SQL = f"(SELECT doc_id, source, lang, {list(C.FEATURES)}[(doc_id % 8 + 1)::INT] AS feature FROM documents)"


@query("example_queries", f"SELECT doc_id, CASE WHEN lang = 'de' AND feature IN ('{C.FEATURES[0]}', '{C.FEATURES[3]}') THEN 'de/' || feature ELSE 'any/' || feature END AS examples FROM {FEATURE_SQL}")
def example_queries(spark, d):
    features = spark.createDataFrame([(f, [f"any/{f}"]) for f in C.FEATURES], "feature string, queries array<string>")
    own = spark.createDataFrame([("de", f, [f"de/{f}"] if f != C.FEATURES[1] else []) for f in (C.FEATURES[0], C.FEATURES[1], C.FEATURES[3])], "codebase string, feature string, queries array<string>")
    chosen = table(spark, d, "documents").select("doc_id", F.col("lang").alias("codebase"), F.get(F.array(*map(F.lit, C.FEATURES)), (F.col("doc_id") % 8).cast("int")).alias("feature"))
    return C.example_queries(chosen, own, features).select("doc_id", F.array_join("examples", ",").alias("examples"))


@query("codebase_filter", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de'")
def codebase_filter(spark, d):
    from strataseek.plans.search import within

    return within(table(spark, d, "documents").withColumnRenamed("lang", "codebase"), "de").select("doc_id", "n_chars")


# ---------------------------------------------------------------- lines, blocks, sizes

LINES_SQL = "(SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no, len(ls) AS last FROM (SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN []::VARCHAR[] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents))"


@query("line_explode", f"SELECT doc_id, line_no::INT AS line_no, md5(line) AS line_md5 FROM {LINES_SQL}")
def line_explode(spark, d):
    return preprocess.number_lines(table(spark, d, "documents"), "doc_id").select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("line_stats", f"SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars, max(length(line)) AS longest FROM {LINES_SQL} GROUP BY doc_id")
def line_stats(spark, d):
    own = preprocess.number_lines(table(spark, d, "documents"), "doc_id")
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.max(F.length("line")).cast("long").alias("longest"))


#: As a character class of RE2, and the characters one by one.
BLANK = "[\\s\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
CHARS = " || ".join(f"chr({ord(c)})" for c in T.SPACES)
RTRIM, LTRIM = (lambda x: f"rtrim({x}, {CHARS})"), (lambda x: f"ltrim({x}, {CHARS})")
PARAGRAPHS = f"""(SELECT doc_id, 0 AS pos, 'PROCEDURE DIVISION.' AS line FROM documents
UNION ALL SELECT doc_id, line_no, CASE WHEN line_no % 7 = 4 THEN 'P-' || line_no || '.' ELSE line END FROM {LINES_SQL})"""


@query(
    "block_boundaries",
    f"""WITH l AS (SELECT doc_id, (pos + 1)::INT AS no, line, (max(pos) OVER (PARTITION BY doc_id) + 1)::INT AS last,
 regexp_matches(line, '^[^\\s]') AND regexp_full_match(upper(replace({RTRIM('line')}, 'ß', 'SS')), '[A-Z0-9-]+{BLANK}*[.]') AND pos > 0 AS head FROM {PARAGRAPHS}),
h AS (SELECT doc_id, no AS line_start, coalesce(lead(no) OVER (PARTITION BY doc_id ORDER BY no) - 1, last)::INT AS line_end, upper(replace({RTRIM("left(rtrim(line), -1)")}, 'ß', 'SS')) AS name FROM (SELECT * FROM l WHERE head))
SELECT * FROM h UNION ALL SELECT doc_id, 1, max(last), 'PROCEDURE-BLOCK' FROM l GROUP BY doc_id HAVING NOT bool_or(head)""",
)
def block_boundaries(spark, d):
    own = F.transform(T.lines(F.coalesce("text", F.lit(""))), lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("P-"), (i + 1).cast("string"), F.lit("."))).otherwise(x))
    files = table(spark, d, "documents").select("doc_id", F.concat(F.array(F.lit("PROCEDURE DIVISION.")), own).alias("lines"))
    return segment.cobol_blocks(files).select("doc_id", F.inline("blocks")).select("doc_id", "line_start", "line_end", "name")


UNITS = f"(SELECT doc_id, line_no::INT AS no, last::INT AS last, CASE line_no % 9 WHEN 3 THEN 'subroutine s' || line_no WHEN 7 THEN 'END' ELSE line END AS line FROM {LINES_SQL})"


@query(
    "gap_blocks",
    f"""WITH m AS (SELECT *, regexp_matches(line, '{segment.UNIT_HEADER}') AS head, regexp_matches(line, '{segment.UNIT_END}') AS ends FROM {UNITS}),
u AS (SELECT *, lead(no) OVER w AS next_no, lead(head) OVER w AS next_head FROM (SELECT * FROM m WHERE head OR ends) WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
b AS (SELECT doc_id, no AS line_start, coalesce(CASE WHEN next_head THEN next_no - 1 ELSE next_no END, last) AS line_end, last,
 upper(regexp_extract(line, '{segment.UNIT_HEADER}', 2)) AS name FROM u WHERE head),
g AS (SELECT doc_id, coalesce(lag(line_end) OVER w, 0) + 1 AS line_start, line_start - 1 AS line_end, 'FILE-BLOCK' AS name FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_start)
 UNION ALL SELECT doc_id, max(line_end) + 1, max(last), 'FILE-BLOCK' FROM b GROUP BY doc_id
 UNION ALL SELECT doc_id, 1, max(last), 'FILE-BLOCK' FROM m GROUP BY doc_id HAVING NOT bool_or(head))
SELECT doc_id, line_start, line_end, name FROM b UNION ALL SELECT * FROM g WHERE line_start <= line_end""",
)
def gap_blocks(spark, d):
    unit = lambda x, i: F.when((i + 1) % 9 == 3, F.concat(F.lit("subroutine s"), (i + 1).cast("string"))).when((i + 1) % 9 == 7, "END").otherwise(x)
    files = table(spark, d, "documents").select("doc_id", F.transform(T.lines(F.coalesce("text", F.lit(""))), unit).alias("lines"))
    return segment.fortran_blocks(files).select("doc_id", F.inline("blocks")).select("doc_id", "line_start", "line_end", "name")


#: Heads and ends of all kinds of unit, spelt in different ways, between the lines of a document.
UNIT_LINES = {2: "  pure function F{n}(x)", 4: "  END FUNCTION f{n}", 5: "module  m{n}", 7: "   end module", 8: "block  data b{n}", 9: "end block data", 10: "Double Precision FUNCTION d{n}()", 12: "END", 13: "program p{n}", 14: "end\tprogram p{n}  ", 16: "endsubroutine"}
UNIT_LINES_SQL = "CASE line_no % 17 " + " ".join(f"WHEN {k} THEN replace('{v}', '{{n}}', line_no::VARCHAR)" for k, v in UNIT_LINES.items()) + " ELSE line END"


@query(
    "fortran_units",
    f"""WITH m AS (SELECT *, regexp_matches(line, '{segment.UNIT_HEADER}') AS head, regexp_matches(line, '{segment.UNIT_END}') AS ends FROM (SELECT doc_id, line_no::INT AS no, last::INT AS last, {UNIT_LINES_SQL} AS line FROM {LINES_SQL})),
u AS (SELECT *, lead(no) OVER w AS next_no, lead(head) OVER w AS next_head FROM (SELECT * FROM m WHERE head OR ends) WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
b AS (SELECT doc_id, no AS line_start, coalesce(CASE WHEN next_head THEN next_no - 1 ELSE next_no END, last) AS line_end, last, upper(regexp_extract(line, '{segment.UNIT_HEADER}', 2)) AS name,
 regexp_replace(upper(regexp_extract(line, '{segment.UNIT_HEADER}', 1)), '\\s+', ' ', 'g') AS division FROM u WHERE head),
g AS (SELECT doc_id, coalesce(lag(line_end) OVER w, 0) + 1 AS line_start, line_start - 1 AS line_end FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_start)
 UNION ALL SELECT doc_id, max(line_end) + 1, max(last) FROM b GROUP BY doc_id UNION ALL SELECT doc_id, 1, max(last) FROM m GROUP BY doc_id HAVING NOT bool_or(head))
SELECT doc_id, line_start, line_end, lower(replace(division, ' ', '_')) AS chunk_type, name, division FROM b UNION ALL SELECT *, 'file_block', 'FILE-BLOCK', 'UNKNOWN' FROM g WHERE line_start <= line_end""",
)
def fortran_units(spark, d):
    def one(x, i):
        out, no = x, (i + 1).cast("string")
        for k, v in UNIT_LINES.items():
            out = F.when((i + 1) % 17 == k, F.replace(F.lit(v), F.lit("{n}"), no)).otherwise(out)
        return out

    own = table(spark, d, "documents").select("doc_id", F.transform(T.lines(F.coalesce("text", F.lit(""))), one).alias("lines"))
    return segment.fortran_blocks(own).select("doc_id", F.inline("blocks")).select("doc_id", "line_start", "line_end", "chunk_type", "name", "division")


SIGNAL_LINES = "CASE line_no % 5 WHEN 0 THEN 'c ' || line WHEN 1 THEN '     &' || line WHEN 2 THEN line || ' & ' WHEN 3 THEN 'x ! ' || line ELSE '     0' || line END"


@query(
    "form_signals",
    f"""SELECT doc_id, count(*) FILTER (WHERE l[1] IN ('C', 'c', '*')) + count(*) FILTER (WHERE l LIKE ' %' AND substr(l, 6, 1) NOT IN (' ', '0', '')) AS fixed,
 count(*) FILTER (WHERE contains(l, '!') AND {RTRIM("split_part(l, '!', 1)")} <> '') + count(*) FILTER (WHERE {RTRIM('l')} LIKE '%&') + count(*) FILTER (WHERE length({RTRIM('l')}) > 72) AS free
 FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM (SELECT doc_id, line_no, {SIGNAL_LINES} AS l FROM {LINES_SQL}) WHERE {RTRIM('l')} <> '') WHERE n <= 20 GROUP BY doc_id""",
)
def form_signals(spark, d):
    def one(x, i):
        k = (i + 1) % 5
        return F.when(k == 0, F.concat(F.lit("c "), x)).when(k == 1, F.concat(F.lit("     &"), x)).when(k == 2, F.concat(x, F.lit(" & "))).when(k == 3, F.concat(F.lit("x ! "), x)).otherwise(F.concat(F.lit("     0"), x))

    own = table(spark, d, "documents").where("text <> ''").select("doc_id", F.array_join(F.transform(T.lines(F.col("text")), one), "\n").alias("text"))
    found = own.select("doc_id", preprocess.form_signals(F.col("text")).alias("s"))
    return found.select("doc_id", F.col("s.fixed").cast("long").alias("fixed"), F.col("s.free").cast("long").alias("free"))


def _folded_sql(rows: str, joint: str) -> str:
    """(key, code_line by g) of rows (key, pos, piece, more): a later piece goes to the line before, whose blank end is dropped."""
    return f"""(SELECT key, g, CASE WHEN count(*) = 1 THEN max(piece) ELSE {RTRIM("arg_min(piece, pos)")} ||
 coalesce(string_agg('{joint}' || {RTRIM('piece')}, '' ORDER BY pos) FILTER (WHERE pos > lo AND pos < hi AND {RTRIM('piece')} <> ''), '') || '{joint}' || arg_max(piece, pos) END AS code_line
FROM (SELECT *, min(pos) OVER (PARTITION BY key, g) AS lo, max(pos) OVER (PARTITION BY key, g) AS hi FROM (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS g FROM {rows})) GROUP BY key, g)"""


def _free_sql(lines: str) -> str:
    """(key, pos, piece, more) of the lines (key, pos, line) of free-form files."""
    return f"""(SELECT key, pos, CASE WHEN body LIKE '&%' THEN {LTRIM('substr(body, 2)')} ELSE body END AS piece, coalesce(lag(code LIKE '%&') OVER (PARTITION BY key ORDER BY pos), false) AS more
FROM (SELECT *, CASE WHEN code LIKE '%&' THEN {RTRIM('left(code, -1)')} ELSE code END AS body
FROM (SELECT *, {RTRIM("split_part(line, '!', 1)")} AS code FROM {lines}) WHERE NOT (contains(line, '!') AND code = '')))"""


FREE = f"(SELECT doc_id AS key, line_no AS pos, CASE WHEN line_no % 3 = 1 THEN line || ' &' ELSE line END AS line FROM {LINES_SQL})"


@query("continuation_fold", f"SELECT key AS doc_id, md5(string_agg(code_line, chr(10) ORDER BY g)) AS code_md5 FROM {_folded_sql(_free_sql(FREE), ' ')} GROUP BY key")
def continuation_fold(spark, d):
    own = F.transform(T.lines(F.coalesce("text", F.lit(""))), lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit(" &"))).otherwise(x))
    files = table(spark, d, "documents").select("doc_id", F.array_join(own, "\n").alias("text"), F.lit("free").alias("form")).where("text <> ''")
    return preprocess.fold(files).where("code <> ''").select("doc_id", F.md5(F.col("code").cast("binary")).alias("code_md5"))


def line_chunks(spark, d) -> DataFrame:
    """One array of line chunks for each document with lines: the input of the size operators."""

    def one(x, i):
        no = (i + 1).cast("int")
        fields = {"content": x, "line_start": no, "line_end": no, "chunk_type": F.lit("line"), "name": F.concat(F.lit("L"), no.cast("string")), "division": F.lit("TEXT"), "token_count": T.word_count(x).cast("int")}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    return table(spark, d, "documents").select("doc_id", F.transform(T.lines(F.coalesce("text", F.lit(""))), one).alias("chunks"))


MERGE_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, line_no, last, len(regexp_extract_all(line, '[^\\s\\x1c-\\x1f\\x{{85}}\\x{{A0}}]+')) AS n FROM {LINES_SQL}),
m AS (SELECT doc_id, line_no, last, line_no AS line_start, n AS tokens, 0 AS seq FROM l WHERE line_no = 1
  UNION ALL SELECT l.doc_id, l.line_no, l.last, CASE WHEN m.tokens < 64 THEN m.line_start ELSE l.line_no END, CASE WHEN m.tokens < 64 THEN m.tokens + l.n ELSE l.n END, CASE WHEN m.tokens < 64 THEN m.seq ELSE m.seq + 1 END
  FROM m JOIN l ON l.doc_id = m.doc_id AND l.line_no = m.line_no + 1),
g AS (SELECT doc_id, seq, min(line_start) AS line_start, max(line_no) AS line_end, max(tokens) AS tokens, max(seq) OVER (PARTITION BY doc_id) AS top FROM m GROUP BY doc_id, seq),
t AS (SELECT *, (seq = top AND seq > 0 AND tokens < 64) AS joins FROM g),
u AS (SELECT doc_id, line_start, line_end, tokens, seq - joins::INT AS seq FROM t)
SELECT doc_id, min(line_start)::INT AS line_start, max(line_end)::INT AS line_end, sum(tokens)::INT AS token_count FROM u GROUP BY doc_id, seq"""


@query("merge_small_chunks", MERGE_SQL)
def merge_small_chunks(spark, d):
    merged = sizing.merge_small(line_chunks(spark, d), "MIXED").select("doc_id", F.explode("chunks").alias("c"))
    return merged.select("doc_id", "c.line_start", "c.line_end", "c.token_count")


SPLIT_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^{BLANK[1:]}+')) AS total FROM documents),
l AS (SELECT doc_id, line_no, last, len(regexp_extract_all(line, '[^{BLANK[1:]}+')) AS n FROM {LINES_SQL} WHERE doc_id IN (SELECT doc_id FROM d WHERE total > 768)),
m AS (SELECT doc_id, line_no, n, last, n <= 768 AS held, CASE WHEN n <= 768 THEN n ELSE 0 END AS size, 0 AS g FROM l WHERE line_no = 1
 UNION ALL SELECT l.doc_id, l.line_no, l.n, l.last, m.held OR l.n <= 768, CASE WHEN m.held AND m.size + l.n > 768 THEN l.n WHEN NOT m.held AND l.n > 768 THEN 0 ELSE m.size + l.n END,
  CASE WHEN m.held AND m.size + l.n <= 768 THEN m.g ELSE m.g + 1 END
 FROM m JOIN l ON l.doc_id = m.doc_id AND l.line_no = m.line_no + 1),
p AS (SELECT doc_id, g, 0 AS k, min(line_no)::INT AS line_start, max(line_no)::INT AS line_end, sum(n)::INT AS token_count FROM m WHERE held GROUP BY doc_id, g
 UNION ALL SELECT doc_id, g, k, line_no::INT, line_no::INT, least(768, n - 768 * k)::INT FROM (SELECT *, unnest(range(0, ceil(n / 768)::BIGINT)) AS k FROM m WHERE NOT held))
SELECT doc_id, 'DOC' || CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN '#' || row_number() OVER (PARTITION BY doc_id ORDER BY g, k) ELSE '' END AS name, line_start, line_end, token_count FROM p
UNION ALL SELECT d.doc_id, 'DOC', 1, coalesce(x.last, 0)::INT, total::INT FROM d LEFT JOIN (SELECT doc_id, max(last) AS last FROM {LINES_SQL} GROUP BY 1) x ON x.doc_id = d.doc_id WHERE total <= 768"""


@query("split_oversized", SPLIT_SQL)
def split_oversized(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    whole = docs.select("doc_id", F.col("text").alias("content"), F.lit(1).alias("line_start"), F.size(T.lines(F.col("text"))).alias("line_end"), F.lit("DOC").alias("name"), T.word_count(F.col("text")).cast("int").alias("token_count"))
    return sizing.split_oversized(whole).select("doc_id", "name", "line_start", "line_end", "token_count")


WORDCOUNT = "len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x1c-\\x1f\\x{85}\\x{A0}]+'))"


@query("token_count", f"SELECT doc_id, {WORDCOUNT}::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


@query("avg_chunk_tokens", f"SELECT source, round(avg({WORDCOUNT}), 6) AS mean_tokens, count(*) AS chunks, ceil(count(*) / 128.0::DOUBLE)::BIGINT AS calls, floor(10000 / avg({WORDCOUNT}))::BIGINT AS batch_size FROM documents GROUP BY source")
def avg_chunk_tokens(spark, d):
    chunks = table(spark, d, "documents").select("source", T.word_count(F.coalesce("text", F.lit(""))).alias("token_count"))
    return evaluation.chunk_sizes(chunks, "source").withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("chunk_sample_sizes", f"SELECT round(avg({WORDCOUNT}), 6) AS mean_tokens, count(*) AS chunks, ceil(count(*) / 128.0::DOUBLE)::BIGINT AS calls, floor(10000 / avg({WORDCOUNT}))::BIGINT AS batch_size FROM (SELECT text FROM documents ORDER BY string_split({PATH_SQL}, '/') LIMIT 200)")
def chunk_sample_sizes(spark, d):
    files_ = evaluation.first_files(with_path(table(spark, d, "documents")).select("path", "text"))
    return evaluation.chunk_sizes(files_.select(T.word_count(F.coalesce("text", F.lit(""))).alias("token_count"))).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("embedding_batches", "SELECT doc_id, (length(coalesce(text, '')) % 7)::DOUBLE AS v0, length(coalesce(text, ''))::DOUBLE AS v1 FROM documents")
def embedding_batches(spark, d):
    from strataseek.plans.ingest import embed

    chunks = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return embed(chunks, LengthEmbedder()).select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("v0"), F.get("embedding", F.lit(1)).cast("double").alias("v1"))


# ---------------------------------------------------------------- points

CHUNK_ID_SQL = f"concat_ws(':', source, {PATH_SQL}, (n_chars % 900)::VARCHAR)"
UUID_SQL = f"""(SELECT doc_id, cid, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ('89ab')[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20], h[21:32]) AS id
FROM (SELECT doc_id, {CHUNK_ID_SQL} AS cid, sha1(unhex('{NS_SQL}') || encode({CHUNK_ID_SQL})) AS h FROM documents))"""


def _ids(spark, d):
    cid = points.chunk_id(F.col("source"), F.col("path"), F.col("n_chars") % 900)
    return with_path(table(spark, d, "documents")).withColumn("cid", cid).withColumn("id", points.point_id(F.col("cid")))


@query("chunk_id", f"SELECT doc_id, {CHUNK_ID_SQL} AS chunk_id FROM documents")
def chunk_id(spark, d):
    return _ids(spark, d).select("doc_id", F.col("cid").alias("chunk_id"))


@query("point_uuid5", f"SELECT doc_id, id FROM {UUID_SQL}")
def point_uuid5(spark, d):
    return _ids(spark, d).select("doc_id", "id")


@query("upsert_last_wins", "SELECT conv_id AS id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def upsert_last_wins(spark, d):
    return points.last_of_each(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "role"), F.col("turn"))


def _chunk_frame(spark, d) -> DataFrame:
    n = F.col("n_chars")
    given = F.create_map(
        F.lit("paragraph_name"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")), F.lit("line_end"), F.when(F.col("doc_id") % 3 == 0, "none").otherwise((n % 500).cast("string"))
    )
    return with_path(table(spark, d, "documents")).select(
        "doc_id", "path", F.col("source").alias("codebase"), F.col("lang").alias("language"), F.col("text").alias("content"), (n % 900).cast("int").alias("line_start"), (n % 700).cast("int").alias("line_end"),
        F.lit("text").alias("chunk_type"), F.concat(F.lit("N"), (F.col("doc_id") % 11).cast("string")).alias("name"), F.lit("DATA").alias("division"), F.array("lang").alias("dependencies"),
        F.array(F.lit(1.0)).alias("embedding"), given.alias("metadata"),
    )


@query(
    "payload_projection",
    f"""SELECT u.id, u.cid AS chunk_id, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, ''), 'N' || doc_id % 11) AS paragraph_name, {PATH_SQL} AS file_path, (n_chars % 900)::INT AS line_start,
 greatest(CASE WHEN doc_id % 3 = 0 THEN n_chars % 700 ELSE n_chars % 500 END, n_chars % 900)::INT AS line_end, 'DATA' AS division, lang AS language, source AS codebase FROM documents JOIN {UUID_SQL} u USING (doc_id)""",
)
def payload_projection(spark, d):
    return points.to_points(_chunk_frame(spark, d)).select("id", "chunk_id", "paragraph_name", "file_path", "line_start", "line_end", "division", "language", "codebase")


@query(
    "metadata_string_map",
    f"""SELECT doc_id, unnest(['paragraph_name', 'division', 'file_path', 'line_start', 'line_end', 'chunk_type', 'language', 'codebase']) AS key,
 unnest(['N' || doc_id % 11, 'DATA', {PATH_SQL}, (n_chars % 900)::VARCHAR, (n_chars % 700)::VARCHAR, 'text', lang, source]) AS value FROM documents""",
)
def metadata_string_map(spark, d):
    return _chunk_frame(spark, d).select("doc_id", F.explode(chunking.metadata()).alias("key", "value"))


@query("collection_upserts", f"SELECT id, (CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END) AS content FROM {UUID_SQL}")
def collection_upserts(spark, d):
    path = scratch.new_path(spark, "collection")
    own = points.to_points(_chunk_frame(spark, d))
    points.upsert(spark, path, own.withColumn("content", F.lit("first")))
    points.upsert(spark, path, points.to_points(_chunk_frame(spark, d).where("doc_id % 3 = 0")).withColumn("content", F.lit("second")))
    return points.read_points(spark, path).select("id", "content")


VERSIONS_SQL = f"""SELECT {PATH_SQL} || '.cob' AS path, 'P-' || i AS name, (2 + 21 * (i - 1))::INT AS line_start
FROM (SELECT *, unnest(range(1, 2 + doc_id % 3 - (doc_id % 4 = 0)::INT)) AS i FROM documents)"""


def versions(docs: DataFrame, paragraphs: Column) -> DataFrame:
    """A program for each document: so many paragraphs of 21 lines, then its text as a note; none, and the file is empty."""
    one = lambda i: F.concat(F.lit("       P-"), i.cast("string"), F.lit(".\n"), F.repeat(F.lit("           MOVE A TO B.\n"), 20))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(paragraphs, F.lit(1))), one), "")
    note = F.concat(F.lit("      * "), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "))
    program = F.when(paragraphs > 0, F.concat(F.lit("       PROCEDURE DIVISION.\n"), body, note)).otherwise("")
    return docs.select(F.concat("path", F.lit(".cob")).alias("path"), program.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


@query("ingest_versions", VERSIONS_SQL)
def ingest_versions(spark, d):
    """All files come, then a half again: of these some have lost a paragraph, or all, and some are as they were."""
    docs = with_path(table(spark, d, "documents"))
    root, collection, checkpoint = (scratch.new_path(spark, label) for label in ("files", "collection", "stream"))
    count = (1 + F.col("doc_id") % 3).cast("int")
    rounds = [versions(docs, count), versions(docs.where("doc_id % 2 = 0"), count - (F.col("doc_id") % 4 == 0).cast("int"))]
    for no, files_ in enumerate(rounds):
        files_.withColumn("modified", F.timestamp_seconds(F.lit(no))).write.mode("append").parquet(root)
        stream = spark.readStream.schema("path string, content binary, error string, modified timestamp").parquet(root)
        keep_versions(stream, collection, checkpoint, LengthEmbedder()).awaitTermination()
    return points.read_points(spark, collection).select(F.col("file_path").alias("path"), "name", "line_start")


# ---------------------------------------------------------------- answers


@query("citation_string", f"SELECT doc_id, {PATH_SQL} || ':' || greatest(n_chars - 300, 0) || '-' || greatest(n_chars % 700, greatest(n_chars - 300, 0)) AS citation FROM documents")
def citation_string(spark, d):
    return with_path(table(spark, d, "documents")).select("doc_id", answers.citation(F.col("path"), F.col("n_chars") - 300, F.col("n_chars") % 700).alias("citation"))


@query(
    "context_block",
    "SELECT conv_id, string_agg('[Chunk ' || n || ']' || chr(10) || 'Source: c' || conv_id || ':' || turn || '-' || turn || chr(10) || 'Name: ' || role || chr(10) || 'Content:' || chr(10) || coalesce(nullif(text, ''), '(empty chunk content)'), chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id",
)
def context_block(spark, d):
    row = F.struct("turn", "role", "text")
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    chunks = F.transform(
        "t",
        lambda t: F.struct(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file_path"), t["turn"].alias("line_start"), t["turn"].alias("line_end"), F.when(t["turn"] % 4 == 0, " ").otherwise(t["role"]).alias("name"),
            F.lit("").alias("division"), t["text"].alias("content"), F.create_map(F.lit("paragraph_name"), t["role"]).alias("metadata"),
        ),
    )
    return turns.select("conv_id", answers.context_block(chunks).alias("context"))


@query("chat_messages", "SELECT conv_id, turn, p AS position, CASE p WHEN 0 THEN 'system' ELSE 'user' END AS role, CASE p WHEN 0 THEN 'rules' ELSE text END AS content FROM conversations, (VALUES (0), (1)) v(p)")
def chat_messages(spark, d):
    own = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(answers.messages(F.lit("rules"), F.col("text"))).alias("position", "m"))
    return own.select("conv_id", "turn", "position", "m.role", "m.content")


STATED = "text || CASE turn % 4 WHEN 0 THEN ' Confidence: high' WHEN 1 THEN ' confidence :LOW' WHEN 2 THEN ' CONFIDENCE: Medium; confidence: low' ELSE '' END"


@query("parse_confidence", f"SELECT conv_id, turn, coalesce(nullif(upper(regexp_extract({STATED}, '(?i)\\bconfidence\\s*:\\s*(HIGH|MEDIUM|LOW)\\b', 1)), ''), 'LOW') AS confidence FROM conversations")
def parse_confidence(spark, d):
    k = F.col("turn") % 4
    said = F.concat(F.col("text"), F.when(k == 0, " Confidence: high").when(k == 1, " confidence :LOW").when(k == 2, " CONFIDENCE: Medium; confidence: low").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.parse_confidence(said).alias("confidence"))


@query("extract_citations", "SELECT doc_id, array_to_string(list_distinct(list_sort(regexp_extract_all(coalesce(text, '') || ' ' || source || '.cob:12-30 and a/b.f90:7 ', '[A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9_]+:\\d+(?:-\\d+)?'))).list_sort(), ' ') AS citations FROM documents")
def extract_citations(spark, d):
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("source"), F.lit(".cob:12-30 and a/b.f90:7 "))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(answers.citations(said)), " ").alias("citations"))


# ---------------------------------------------------------------- evaluation and statistics


def _judged(spark, d):
    return evaluation.hits(*_results_and_wanted(spark, d))


def _results_and_wanted(spark, d):
    docs = with_path(table(spark, d, "documents"))
    results = docs.select(F.concat(F.lit("q"), (F.col("doc_id") / 7).cast("long").cast("string")).alias("id"), (F.col("doc_id") % 7 + 1).alias("rank"), F.col("path").alias("file_path"), F.col("lang").alias("name"))
    wanted = docs.where(F.col("doc_id") % 7 == 0).select(
        F.concat(F.lit("q"), (F.col("doc_id") / 7).cast("long").cast("string")).alias("id"),
        F.col("source").alias("codebase"),
        F.array(F.lit(".f"), F.lit("nothing")).alias("expected_files"),
        F.array(F.when(F.col("doc_id") % 2 == 0, "FR").otherwise("es").alias("n")).alias("expected_names"),
    )
    return results, wanted


HIT_SQL = f"""(SELECT w.id, w.codebase, coalesce(bool_or(contains(path, '.f') OR contains(path, 'nothing')), false) AS file_hit, coalesce(bool_or(contains(upper(lang), upper(w.name))), false) AS name_hit, count(path) AS returned
FROM (SELECT 'q' || doc_id // 7 AS id, source AS codebase, CASE WHEN doc_id % 2 = 0 THEN 'FR' ELSE 'es' END AS name FROM documents WHERE doc_id % 7 = 0) w
LEFT JOIN (SELECT 'q' || doc_id // 7 AS id, {PATH_SQL} AS path, lang FROM documents WHERE doc_id % 7 < 5) r USING (id) GROUP BY ALL)"""


@query("hit_at_5", f"SELECT *, file_hit OR name_hit AS hit FROM {HIT_SQL}")
def hit_at_5(spark, d):
    return _judged(spark, d)


@query("hit_at_5_by_automaton", f"SELECT *, file_hit OR name_hit AS hit FROM {HIT_SQL}")
def hit_at_5_by_automaton(spark, d):
    return evaluation.hits_of_many(*_results_and_wanted(spark, d))


@query("precision_rollup", f"SELECT codebase, count(*) FILTER (WHERE file_hit OR name_hit) AS hits, count(*) AS total, round(avg((file_hit OR name_hit)::INT), 6) AS rate FROM {HIT_SQL} GROUP BY ROLLUP (codebase)")
def precision_rollup(spark, d):
    return evaluation.hit_rates(_judged(spark, d)).withColumn("rate", F.round("rate", 6))


@query("ingest_stats", f"WITH {ROUTES} SELECT count(*) AS files_found, count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), '\\S')) AS files_processed, count(*) FILTER (WHERE NOT regexp_matches(coalesce(text, ''), '\\S')) AS skipped_empty, 0::BIGINT AS errors FROM (SELECT text, lower(regexp_extract({PATH_SQL}, '[^/](\\.[^./]+)$', 1)) AS extension FROM documents) JOIN routes USING (extension)")
def ingest_stats(spark, d):
    from strataseek.plans.ingest import file_counts

    own = files.with_route(with_path(table(spark, d, "documents"))).where("language IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("code"))
    counters = file_counts(own.count(), own)
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} long" for k in counters))


@query("distinct_codebases", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS codebases, count(DISTINCT source) > 1 AS several, bool_and(source = 'src1') AS all_match FROM documents GROUP BY lang")
def distinct_codebases(spark, d):
    results = table(spark, d, "documents").select("lang", F.col("source").alias("codebase"), F.lit("src1").alias("wanted"))
    return evaluation.codebases_found(results, "lang", wanted="wanted").withColumn("codebases", F.array_join("codebases", ","))


@query("codebases_by_rank", "SELECT lang, array_to_string(list(source ORDER BY best DESC, source), ',') AS codebases FROM (SELECT lang, source, max(n_chars) AS best FROM documents WHERE source <> '' GROUP BY ALL) GROUP BY lang")
def codebases_by_rank(spark, d):
    results = table(spark, d, "documents").select("lang", F.col("source").alias("codebase"), (-F.col("n_chars")).alias("rank"))
    return evaluation.codebases_in_order(results, "lang").withColumn("codebases", F.array_join("codebases", ","))


@query("smoke_verdict", "SELECT count(*) FILTER (WHERE passed) AS passed_count, count(*) AS total, count(*) FILTER (WHERE passed) >= 8 AS ok FROM (SELECT turn % 5 <> 0 AND coalesce(text, '') <> '' AS passed FROM conversations)")
def smoke_verdict(spark, d):
    said = table(spark, d, "conversations").select(F.when(F.col("turn") % 5 == 0, 500).otherwise(200).alias("status"), F.col("text").alias("answer"))
    return evaluation.smoke_verdict(evaluation.smoke_results(said))


@query("message_content", f"SELECT conv_id, turn, coalesce(trim(text, {CHARS}), '') AS said, CASE turn % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') || role ELSE '' END AS delta FROM conversations")
def message_content(spark, d):
    text = F.coalesce("text", F.lit(""))
    plain = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"), F.struct(text.alias("content")).alias("delta"))).alias("choices")))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text")), F.struct(F.col("role").alias("text"))).alias("content")).alias("delta"))).alias("choices")))
    event = F.when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, parts).otherwise("{}")
    return table(spark, d, "conversations").select("conv_id", "turn", answers.message_content(plain).alias("said"), answers.stream_delta(event).alias("delta"))


# ---------------------------------------------------------------- code fixtures: documents dressed as source files


def dressed(spark, d) -> DataFrame:
    """path, text, extension, language, codebase: each line of a document, at the columns of the language.

    Where columns have a width, a long line goes on in continuation lines of 60 characters. Each eleventh line has a paragraph or the head of a unit before it.
    """
    docs = files.with_route(with_path(table(spark, d, "documents"))).where("language IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    cobol, fixed = F.col("language") == "cobol", F.col("extension").isin(*preprocess.FIXED_EXTENSIONS)

    def one(x, i):
        note = i % 5 == 3
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / 60).cast("int") - 1, F.lit(0))), lambda k: F.substring(x, k * 60 + 1, F.lit(60)))
        more = lambda k: (k > 0) | (i % 7 == 5)
        as_cobol = lambda q, k: F.concat(F.lit("000100"), F.when(note, "*").when(more(k), "-    ").otherwise(" "), q)
        as_fixed = lambda q, k: F.concat(F.when(note, "C     ").when(more(k), "     &").otherwise("      "), q)
        as_free = F.array(F.when(note, F.concat(F.lit("! "), x)).when(i % 7 == 4, F.concat(x, F.lit(" &"))).otherwise(x))
        no = (i + 1).cast("string")
        head = F.when(cobol, F.concat(F.lit("       P-"), no, F.lit("."))).otherwise(F.concat(F.lit("      SUBROUTINE S"), no))
        own = F.when(cobol, F.transform(pieces, as_cobol)).when(fixed, F.transform(pieces, as_fixed)).otherwise(as_free)
        return F.when(i % 11 == 6, F.concat(F.array(head), own)).otherwise(own)

    return docs.withColumn("text", F.array_join(F.concat(F.array(F.lit("       PROCEDURE DIVISION.")), F.flatten(F.transform(T.lines(F.col("text")), one))), "\n"))


#: Pieces of the dressed lines of files whose columns have a width: key, pos, note, more, p (what stands behind the marks), form.
PIECES_SQL = f"""(SELECT doc_id AS key, 0 AS pos, false AS note, false AS more, 'PROCEDURE DIVISION.' AS p FROM documents
 UNION ALL SELECT doc_id, line_no * 10000, false, false, CASE WHEN doc_id % 8 IN (0, 5, 6) THEN 'P-' || line_no || '.' ELSE 'SUBROUTINE S' || line_no END FROM {LINES_SQL} WHERE line_no % 11 = 7
 UNION ALL SELECT doc_id, line_no * 10000 + k + 1, line_no % 5 = 4, k > 0 OR line_no % 7 = 6, substr(line, (k * 60 + 1)::BIGINT, 60)
  FROM (SELECT *, unnest(range(0, greatest(ceil(length(line) / 60), 1)::BIGINT)) AS k FROM {LINES_SQL}))"""
COBOL_SQL = f"(SELECT * FROM {PIECES_SQL} WHERE key % 8 IN (0, 5, 6))"
FIXED_SQL = f"(SELECT * FROM {PIECES_SQL} WHERE key % 8 IN (2, 7))"
FREE_LINES = f"""(SELECT doc_id AS key, 0 AS pos, '       PROCEDURE DIVISION.' AS line FROM documents WHERE doc_id % 8 = 1
 UNION ALL SELECT doc_id, line_no * 10, '      SUBROUTINE S' || line_no FROM {LINES_SQL} WHERE line_no % 11 = 7 AND doc_id % 8 = 1
 UNION ALL SELECT doc_id, line_no * 10 + 1, CASE WHEN line_no % 5 = 4 THEN '! ' || line WHEN line_no % 7 = 5 THEN line || ' &' ELSE line END FROM {LINES_SQL} WHERE doc_id % 8 = 1)"""
INLINE = "NOT note AND NOT more AND contains(p, '*>')"
COBOL_PIECES = f"(SELECT key, pos, more, CASE WHEN more THEN {LTRIM('p')} WHEN contains(p, '*>') THEN {RTRIM("split_part(p, '*>', 1)")} ELSE p END AS piece FROM {COBOL_SQL} WHERE NOT note)"
FIXED_PIECES = f"(SELECT key, pos, more AND p <> '' AS more, CASE WHEN pos = 0 THEN ' ' || p WHEN more AND p = '' THEN '&' ELSE {RTRIM('p')} END AS piece FROM {FIXED_SQL} WHERE NOT note)"
AFTER = "substr({x}, instr({x}, '{m}') + {n})"
NOTES_SQL = f"""(SELECT key, count(*) AS n FROM (
 SELECT key, CASE WHEN note THEN p ELSE {AFTER.format(x='p', m='*>', n=2)} END AS c FROM {COBOL_SQL} WHERE note OR ({INLINE})
 UNION ALL SELECT key, p FROM {FIXED_SQL} WHERE note
 UNION ALL SELECT key, {AFTER.format(x='line', m='!', n=1)} FROM {FREE_LINES} WHERE contains(line, '!')) WHERE {RTRIM('c')} <> '' GROUP BY key)"""


@query(
    "preprocess_files",
    f"""WITH code AS (SELECT 'cobol' AS language, NULL AS source_format, * FROM {_folded_sql(COBOL_PIECES, '')} UNION ALL SELECT 'fortran', 'fixed', * FROM {_folded_sql(FIXED_PIECES, '')}
 UNION ALL SELECT 'fortran', 'free', * FROM {_folded_sql(_free_sql(FREE_LINES), ' ')}),
f AS (SELECT key, language, source_format, string_agg(code_line, chr(10) ORDER BY g) AS code FROM code GROUP BY ALL)
SELECT {PATH_SQL} AS path, language, source_format, md5(code) AS code_md5, coalesce(n, 0)::INT AS n_comments,
 CASE WHEN language = 'cobol' THEN array_to_string(list_filter({list(preprocess.DIVISIONS)}, lambda v: contains(upper(code), v || ' DIVISION')), ',') END AS divisions
FROM f JOIN documents ON doc_id = f.key LEFT JOIN {NOTES_SQL} notes ON notes.key = f.key""",
)
def preprocess_files(spark, d):
    out = preprocess.preprocess(dressed(spark, d))
    return out.select("path", "language", "source_format", F.md5(F.col("code").cast("binary")).alias("code_md5"), F.size("comments").alias("n_comments"), F.when(F.col("language") == "cobol", F.col("found")).alias("divisions"))


STRIPPED = "trim({x}, " + CHARS + ")"
WORDS_OF = f"'[^{BLANK[1:]}+'"
STRIPPED_LINE = STRIPPED.format(x="line")
HEADED = "upper(" + STRIPPED.format(x=f"left({STRIPPED_LINE}, -1)") + ")"
KIND = f"regexp_replace(upper(regexp_extract(line, '{segment.UNIT_HEADER}', 1)), '\\s+', ' ', 'g')"
JOINED = STRIPPED.format(x="{a} || chr(10) || {b}")


def _names_sql(pattern: str, text: str = "content", fold: str = "upper") -> str:
    """Names that a pattern's group finds, without marks around them."""
    found = f"regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 1)"
    bare = f"regexp_replace(regexp_replace({STRIPPED.format(x='x')}, '^[.,;:]+|[.,;:]+$', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g')"
    return f"list_filter(list_transform({found}, lambda x: {fold}({bare})), lambda x: x <> '')"


PERFORMED = f"""list_transform(list_filter(regexp_extract_all(regexp_replace(content, '{dependencies.THRU}', ' ', 'g'), '(?i)\\bPERFORM\\s+[A-Z0-9-]+\\b(?:\\s+THRU\\b)?'),
 lambda x: NOT regexp_matches(x, '(?i)\\sTHRU$')), lambda x: upper(regexp_extract(x, '\\s([A-Za-z0-9-]+)$', 1)))"""
RANGES = f"list_transform(list_zip(regexp_extract_all(content, '{dependencies.THRU}', 1), regexp_extract_all(content, '{dependencies.THRU}', 2)), lambda z: upper(z[1] || ' THRU ' || z[2]))"
COBOL_NAMES = f"list_concat(list_concat({RANGES}, {PERFORMED}), list_concat({_names_sql(dependencies.COBOL_CALL)}, {_names_sql(dependencies.COPY)}))"
FORTRAN_NAMES = f"list_concat(list_concat({_names_sql(dependencies.USE)}, {_names_sql(dependencies.INCLUDE, fold='')}), {_names_sql(dependencies.CALL)})"
#: Clean lines of the dressed files: key, language, code_line by g.
CODE_SQL = f"""(SELECT 'cobol' AS language, * FROM {_folded_sql(COBOL_PIECES, '')}
 UNION ALL SELECT 'fortran', * FROM {_folded_sql(FIXED_PIECES, '')}
 UNION ALL SELECT 'fortran', * FROM {_folded_sql(_free_sql(FREE_LINES), ' ')})"""
#: Blocks from marked lines, merging by recursion over a file's blocks, cutting by recursion over a chunk's lines, names in the parts.
CHUNKS_SQL = f"""WITH RECURSIVE numbered AS (
 SELECT key, language, code_line AS line, row_number() OVER (PARTITION BY key ORDER BY g) AS no FROM {CODE_SQL}),
ends AS (SELECT key, any_value(language) AS language, count(*) - (arg_max(line, no) = '')::INT AS last FROM numbered GROUP BY key),
lines AS MATERIALIZED (SELECT numbered.*, last FROM numbered JOIN ends USING (key) WHERE no <= last),
files AS MATERIALIZED (SELECT key, any_value(language) AS language, any_value(last) AS last,
  min(no) FILTER (WHERE contains(upper(line), ' DIVISION.') AND upper({STRIPPED_LINE}) = 'PROCEDURE DIVISION.') AS opens FROM lines GROUP BY key),
heads AS (SELECT key, no, {HEADED} AS name FROM lines JOIN files USING (key)
 WHERE lines.language = 'cobol' AND no > opens AND NOT regexp_matches(line, '^{BLANK}') AND {STRIPPED_LINE} LIKE '%.' AND regexp_full_match({HEADED}, '[A-Z0-9-]+')),
marks AS (SELECT key, no, {KIND} AS kind, upper(regexp_extract(line, '{segment.UNIT_HEADER}', 2)) AS name FROM lines
 WHERE language = 'fortran' AND (regexp_matches(line, '{segment.UNIT_HEADER}') OR regexp_matches(line, '{segment.UNIT_END}'))),
units AS (SELECT key, no AS a, coalesce(CASE WHEN next_kind <> '' THEN next_no - 1 ELSE next_no END, last) AS b, lower(replace(kind, ' ', '_')) AS chunk_type, name, kind AS division
 FROM (SELECT *, lead(kind) OVER (PARTITION BY key ORDER BY no) AS next_kind, lead(no) OVER (PARTITION BY key ORDER BY no) AS next_no FROM marks) JOIN files USING (key) WHERE kind <> ''),
gaps AS (SELECT key, coalesce(lag(b) OVER (PARTITION BY key ORDER BY a), 0) + 1 AS a, a - 1 AS b
 FROM (SELECT key, a, b FROM units UNION ALL SELECT key, last + 1, last + 1 FROM files WHERE language = 'fortran')),
blocks AS (SELECT key, no AS a, coalesce(lead(no) OVER (PARTITION BY key ORDER BY no) - 1, last) AS b, 'paragraph' AS chunk_type, name, 'PROCEDURE' AS division FROM heads JOIN files USING (key)
 UNION ALL SELECT key, coalesce(opens, 1), last, 'paragraph', CASE WHEN opens IS NULL THEN 'FILE-BLOCK' ELSE 'PROCEDURE-BLOCK' END, CASE WHEN opens IS NULL THEN 'UNKNOWN' ELSE 'PROCEDURE' END
  FROM files WHERE language = 'cobol' AND key NOT IN (SELECT key FROM heads)
 UNION ALL SELECT * FROM units
 UNION ALL SELECT key, a, b, 'file_block', 'FILE-BLOCK', 'UNKNOWN' FROM gaps WHERE a <= b),
held AS (SELECT blocks.key, a, any_value(language) AS language, any_value(b) AS b, any_value(chunk_type) AS chunk_type, any_value(name) AS name, any_value(division) AS division,
  string_agg(line, chr(10) ORDER BY no) AS content
 FROM blocks JOIN lines ON lines.key = blocks.key AND no BETWEEN a AND b GROUP BY blocks.key, a),
own AS MATERIALIZED (SELECT *, len(regexp_extract_all(content, {WORDS_OF})) AS n, CASE WHEN language = 'cobol' THEN 'UNKNOWN' ELSE 'MIXED' END AS mixed,
  row_number() OVER (PARTITION BY key ORDER BY a) AS nth FROM held WHERE name <> 'FILE-BLOCK' OR {STRIPPED.format(x='content')} <> ''),
merging AS (SELECT key, language, mixed, nth, 0 AS seq, a, b, chunk_type, [name] AS names, division, content, n FROM own WHERE nth = 1
 UNION ALL SELECT o.key, o.language, o.mixed, o.nth, CASE WHEN m.n < 64 THEN m.seq ELSE m.seq + 1 END, CASE WHEN m.n < 64 THEN m.a ELSE o.a END, o.b, CASE WHEN m.n < 64 THEN m.chunk_type ELSE o.chunk_type END,
  CASE WHEN m.n >= 64 THEN [o.name] WHEN list_contains(m.names, o.name) THEN m.names ELSE list_append(m.names, o.name) END,
  CASE WHEN m.n >= 64 OR m.division = o.division THEN o.division ELSE o.mixed END,
  CASE WHEN m.n < 64 THEN {JOINED.format(a='m.content', b='o.content')} ELSE o.content END, CASE WHEN m.n < 64 THEN m.n + o.n ELSE o.n END
 FROM merging m JOIN own o ON o.key = m.key AND o.nth = m.nth + 1),
run AS MATERIALIZED (SELECT *, seq > 0 AND n < 64 AND seq = max(seq) OVER (PARTITION BY key) AS joins FROM merging QUALIFY row_number() OVER (PARTITION BY key, seq ORDER BY nth DESC) = 1),
merged AS MATERIALIZED (SELECT row_number() OVER () AS id, g.key, g.language, g.a, coalesce(t.b, g.b) AS b, g.chunk_type, CASE WHEN t.key IS NULL OR t.division = g.division THEN g.division ELSE g.mixed END AS division,
  array_to_string(CASE WHEN t.key IS NULL THEN g.names ELSE list_concat(g.names, list_filter(t.names, lambda x: NOT list_contains(g.names, x))) END, '+') AS name,
  CASE WHEN t.key IS NULL THEN g.content ELSE {JOINED.format(a='g.content', b='t.content')} END AS content, g.n + coalesce(t.n, 0) AS n
 FROM run g LEFT JOIN run t ON t.joins AND t.key = g.key AND t.seq = g.seq + 1 WHERE NOT g.joins),
split AS (SELECT id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no, len(ls) AS last
 FROM (SELECT id, CASE WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS ls FROM merged WHERE n > 768)),
l AS MATERIALIZED (SELECT *, len(regexp_extract_all(line, {WORDS_OF})) AS n FROM split),
cut AS (SELECT id, no, n, n <= 768 AS held, CASE WHEN n <= 768 THEN n ELSE 0 END AS size, 0 AS g FROM l WHERE no = 1
 UNION ALL SELECT l.id, l.no, l.n, c.held OR l.n <= 768, CASE WHEN c.held AND c.size + l.n > 768 THEN l.n WHEN NOT c.held AND l.n > 768 THEN 0 ELSE c.size + l.n END,
  CASE WHEN c.held AND c.size + l.n <= 768 THEN c.g ELSE c.g + 1 END
 FROM cut c JOIN l ON l.id = c.id AND l.no = c.no + 1),
parts AS (SELECT id, g, 0 AS k, min(no) AS lo, CASE WHEN max(no) = any_value(last) THEN NULL ELSE max(no) END AS hi, string_agg(line, chr(10) ORDER BY no) AS content, sum(cut.n) AS n
  FROM cut JOIN l USING (id, no) WHERE held GROUP BY id, g
 UNION ALL SELECT id, g, k, no, no, array_to_string(regexp_extract_all(line, {WORDS_OF})[768 * k + 1 : 768 * k + 768], ' '), least(768, n - 768 * k)
  FROM (SELECT cut.*, line, unnest(range(0, ceil(cut.n / 768)::BIGINT)) AS k FROM cut JOIN l USING (id, no) WHERE NOT held)),
chunks AS (SELECT key, language, name || CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN '#' || row_number() OVER (PARTITION BY id ORDER BY g, k) ELSE '' END AS name, division, chunk_type,
  a + lo - 1 AS line_start, coalesce(a + hi - 1, b) AS line_end, p.n AS token_count, p.content FROM parts p JOIN merged USING (id)
 UNION ALL SELECT key, language, name, division, chunk_type, a, b, n, content FROM merged WHERE n <= 768),
named AS (SELECT *, CASE WHEN language = 'cobol' THEN {COBOL_NAMES} ELSE {FORTRAN_NAMES} END AS found FROM chunks)
SELECT {PATH_SQL} AS path, language, name, division, chunk_type, line_start::INT AS line_start, line_end::INT AS line_end, token_count::INT AS token_count,
 array_to_string(list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: upper(y)), upper(x)) = i), ',') AS dependencies
FROM named JOIN documents ON doc_id = key"""


@query("chunk_files", CHUNKS_SQL)
def chunk_files(spark, d):
    from strataseek.operators.chunking import chunk

    own = chunk(preprocess.preprocess(dressed(spark, d)), plain_names=True)
    return own.select("path", "language", "name", "division", "chunk_type", "line_start", "line_end", "token_count", F.array_join("dependencies", ",").alias("dependencies"))


DEP_TEXT = "text || ' PERFORM ' || upper(source) || '-A THRU ' || upper(source) || '-Z. perform X-' || doc_id % 9 || chr(10) || 'CALL \"SUB' || doc_id % 5 || '\" COPY BOOK' || doc_id % 3 || '.'"


def _called(spark, d):
    t = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" PERFORM "), F.upper("source"), F.lit("-A THRU "), F.upper("source"), F.lit("-Z. perform X-"), (F.col("doc_id") % 9).cast("string"),
        F.lit('\nCALL "SUB'), (F.col("doc_id") % 5).cast("string"), F.lit('" COPY BOOK'), (F.col("doc_id") % 3).cast("string"), F.lit("."),
    )
    return table(spark, d, "documents").select("doc_id", t.alias("t"))


@query(
    "deps_cobol",
    f"""SELECT doc_id, array_to_string(list_concat(list_concat([upper(source) || '-A THRU ' || upper(source) || '-Z'], ['X-' || doc_id % 9]), ['SUB' || doc_id % 5, 'BOOK' || doc_id % 3]), ',') AS dependencies FROM documents""",
)
def deps_cobol(spark, d):
    return _called(spark, d).select("doc_id", F.array_join(dependencies.cobol_dependencies(F.col("t")), ",").alias("dependencies"))


@query("deps_fortran", "SELECT doc_id, 'MOD_' || doc_id % 7 || ',Inc/File' || doc_id % 3 || '.h,SUB' || doc_id % 5 || ',MOD_X' AS dependencies FROM documents")
def deps_fortran(spark, d):
    no = lambda k: (F.col("doc_id") % k).cast("string")
    t = F.concat(
        F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)use|include|call", "-"), F.lit("\n USE mod_"), no(7), F.lit(", only: x\n include 'Inc/File"), no(3), F.lit(".h'\n  call Sub"), no(5), F.lit("(a)\n CALL sub"), no(5),
        F.lit("\n call mod_x\n call MOD_"), no(7), F.lit("\n"),
    )
    return table(spark, d, "documents").select("doc_id", F.array_join(dependencies.fortran_dependencies(t), ",").alias("dependencies"))


@query("reverse_deps", "SELECT target, count(DISTINCT doc_id) AS n_users FROM (SELECT doc_id, unnest(['X-' || doc_id % 9, 'SUB' || doc_id % 5, 'BOOK' || doc_id % 3, upper(source) || '-A', upper(source) || '-Z']) AS target FROM documents) GROUP BY target")
def reverse_deps(spark, d):
    own = _called(spark, d).select(F.col("doc_id").alias("name"), dependencies.cobol_dependencies(F.col("t")).alias("dependencies"))
    return dependencies.reverse(dependencies.edges(own))
