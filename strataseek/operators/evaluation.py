"""Hit rates of retrieval against expected files and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.config import EMBEDDING_BATCH
from strataseek.errors import StrataseekError, ValidationError
from strataseek.operators.answers import looks_grounded
from strataseek.operators.patterns import holding
from strataseek.scratch import materialize

TOP = 5


def load_ground_truth(spark, path: str) -> DataFrame:
    """One row for each query of a JSON file with a list ``queries``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """id, codebase, file_hit, name_hit, hit, returned: any expected file or name in any of the first five results.

    results: id, rank (from 1), file_path, name. expected: id, codebase, expected_files, expected_names. A query without results is a miss.
    """
    first = results.where(F.col("rank") <= TOP).groupBy("id").agg(F.collect_list("file_path").alias("paths"), F.collect_list("name").alias("names"), F.count(F.lit(1)).alias("returned"))
    both = expected.join(first, "id", "left")
    within = lambda wanted, found, fold: F.coalesce(F.exists(wanted, lambda w: F.exists(found, lambda x: F.contains(fold(x), fold(w)))), F.lit(False))
    out = both.select(
        "id",
        "codebase",
        within(F.col("expected_files"), F.col("paths"), lambda x: x).alias("file_hit"),
        within(F.col("expected_names"), F.col("names"), F.upper).alias("name_hit"),
        F.coalesce("returned", F.lit(0)).alias("returned"),
    )
    return out.withColumn("hit", F.col("file_hit") | F.col("name_hit"))


def hits_of_many(results: DataFrame, expected: DataFrame) -> DataFrame:
    """As ``hits``, for many queries with many expected texts: each path and name is read once, by an automaton over all that is expected, instead of once for each expected text."""
    first = materialize(results.where(F.col("rank") <= TOP).select("id", F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("file_path").alias("said")), F.struct(F.lit("name").alias("kind"), F.upper("name").alias("said")))).alias("x")).select("id", "x.kind", "x.said"), "first-results")
    texts_of = lambda kind, column, fold: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda w: F.struct(F.lit(kind).alias("kind"), fold(w).alias("pattern")))
    wanted = expected.select("id", F.explode(F.concat(texts_of("file", "expected_files", lambda w: w), texts_of("name", "expected_names", F.upper))).alias("x"))
    wanted = wanted.select("id", "x.kind", "x.pattern").distinct()
    # A text that several results share is read once.
    texts = first.select("kind", "said").distinct()
    held = holding(texts.withColumn("text", F.col("said")), wanted, "text")
    met = first.join(held, ["kind", "said"]).select("id", "kind", "pattern").join(wanted, ["id", "kind", "pattern"], "left_semi")
    found = met.groupBy("id").agg(F.bool_or(F.col("kind") == "file").alias("__file"), F.bool_or(F.col("kind") == "name").alias("__name"))
    returned = first.where("kind = 'file'").groupBy("id").agg(F.count(F.lit(1)).alias("returned"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = expected.select("id", "codebase").join(found, "id", "left").join(returned, "id", "left")
    return out.select("id", "codebase", yes("__file").alias("file_hit"), yes("__name").alias("name_hit"), F.coalesce("returned", F.lit(0)).alias("returned"), (yes("__file") | yes("__name")).alias("hit"))


def hit_rates(scored: DataFrame) -> DataFrame:
    """codebase (null: all), hits, total, rate."""
    n = F.count_if("hit")
    return scored.rollup("codebase").agg(n.alias("hits"), F.count(F.lit(1)).alias("total"), F.when(F.count(F.lit(1)) > 0, n / F.count(F.lit(1))).otherwise(F.lit(0.0)).alias("rate"))


def load_smoke_queries(spark, path: str) -> DataFrame:
    """id, feature, query, codebase (of the file) of a JSON file with a list ``queries``."""
    read = spark.read.option("multiLine", True).json(path)
    own = F.col("codebase") if "codebase" in read.columns else F.lit("gnucobol")
    return read.select(F.coalesce(own, F.lit("gnucobol")).alias("codebase"), F.explode("queries").alias("q")).select("q.id", "q.feature", "q.query", "codebase")


def smoke_results(answers: DataFrame) -> DataFrame:
    """answers (id, feature, status, answer) with passed and has_citations. A query passes with status 200 and an answer."""
    said = F.coalesce("answer", F.lit(""))
    return answers.withColumns({"passed": (F.col("status") == 200) & (said != ""), "has_citations": looks_grounded(said)})


def smoke_verdict(results: DataFrame, least: int = 8) -> DataFrame:
    """passed_count, total, ok: enough of the queries passed."""
    n = F.count_if("passed")
    return results.agg(n.alias("passed_count"), F.count(F.lit(1)).alias("total"), (n >= least).alias("ok"))


def run_smoke(client, queries: DataFrame) -> DataFrame:
    """Ask a running service each of a smoke file's queries (a handful of rows) and judge the answers. Errors have status 0."""
    from strataseek.plans.search import SearchRequest

    def ask(r) -> tuple:
        try:
            return (r["id"], r["feature"], 200, client.query(SearchRequest(r["query"], r["feature"], r["codebase"]))["answer"])
        except StrataseekError as e:
            return (r["id"], r["feature"], getattr(e, "status", 0) if isinstance(e, ValidationError) else 0, None)

    rows = [ask(r) for r in queries.orderBy("id").collect()]
    return smoke_results(queries.sparkSession.createDataFrame(rows, f"id {queries.schema['id'].dataType.simpleString()}, feature string, status int, answer string"))


def codebases_found(results: DataFrame, *keys: str, wanted: str | None = None) -> DataFrame:
    """keys, codebases (sorted), several and, for a filter's codebase, all_match: the codebases that the results of each key come from. Rows without one don't count."""
    own = F.nullif("codebase", F.lit(""))
    match = [F.coalesce(F.bool_and(own == F.col(wanted)), F.lit(True)).alias("all_match")] if wanted else []
    return results.groupBy(*keys).agg(F.array_sort(F.collect_set(own)).alias("codebases"), (F.count_distinct(own) > 1).alias("several"), *match)


def codebases_in_order(results: DataFrame, *keys: str) -> DataFrame:
    """keys, codebases: each codebase once, in the order of its best rank (of equal ranks by name). Rows without one don't count."""
    best = results.where(F.nullif("codebase", F.lit("")).isNotNull()).groupBy(*keys, "codebase").agg(F.min("rank").alias("rank"))
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "codebase"))), lambda x: x["codebase"]).alias("codebases"))


def codebase_counts(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, chunks of each registered codebase, those without any too."""
    n = chunks.groupBy(F.col("codebase").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return registry.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("chunks"))


def chunk_sizes(chunks: DataFrame, *keys: str, budget: int = 10_000) -> DataFrame:
    """keys, mean_tokens, chunks, calls (of the embedding provider), batch_size (chunks whose tokens fit ``budget``)."""
    mean, n = F.avg("token_count"), F.count(F.lit(1))
    return chunks.groupBy(*keys).agg(mean.alias("mean_tokens"), n.alias("chunks"), F.ceil(n / EMBEDDING_BATCH).alias("calls"), F.floor(F.lit(budget) / mean).alias("batch_size"))


def first_files(files: DataFrame, n: int = 200) -> DataFrame:
    """The first n files by the components of their paths: the sample that ``chunk_sizes`` is estimated on."""
    return files.orderBy(F.split("path", "/")).limit(n)
