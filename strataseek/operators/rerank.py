"""Metadata boosts, optional cross-encoder blend, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataseek import config as C
from strataseek.functions.text import bound, strip, tokens
from strataseek.operators.many import normalised
from strataseek.operators.retrieval import confidence, minmax
from strataseek.scratch import materialize

ORDER = ("file_path", "line_start", "line_end", "name")


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def boost(query_tokens: list[str] | Column, feature: str | Column) -> Column:
    """Over columns name, division, file_path, dependencies, codebase, language. Added in a fixed order, for equal doubles.

    Tokens and feature are a question's own, or columns where rows belong to different questions. A column's tokens are computed once.
    """
    asked = query_tokens if isinstance(query_tokens, Column) else _literal(query_tokens)
    about = feature if isinstance(feature, Column) else F.lit(feature)
    add = lambda when, x: F.when(F.coalesce(when, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    overlap = lambda c: F.arrays_overlap(tokens(c), asked)
    division = F.upper(F.trim("division"))
    hinted = [(division == d) & F.arrays_overlap(asked, _literal(list(hints))) for d, hints in C.DIVISION_HINTS.items()]
    division_hit = (division != "") & reduce(lambda x, y: x | y, hinted, F.array_contains(F.transform(asked, F.upper), division))
    named = bound(tokens(F.col("name")), lambda n: (F.size(n) > 0) & (F.size(F.array_except(n, asked)) == 0))
    total = add(named, C.NAME_BOOST)
    total = total + add(division_hit, C.DIVISION_BOOST)
    total = total + add(overlap(F.col("file_path")), C.PATH_BOOST)
    twice = lambda hit: total + add(hit, C.DEPENDENCY_BOOST) + add(hit & (about == "dependency_mapping"), C.FEATURE_DEPENDENCY_BOOST)
    total = bound(overlap(F.array_join("dependencies", ",")), twice)
    total = total + add(F.array_contains(asked, F.lower("codebase")), C.CODEBASE_BOOST)
    total = total + add(F.array_contains(asked, F.lower("language")), C.LANGUAGE_BOOST)
    return F.least(total, F.lit(C.MAX_BOOST))


def rerank(chunks: DataFrame, query_tokens: list[str], feature: str = "code_explanation", provider_scores: DataFrame | None = None, *, large: bool = False) -> DataFrame:
    """``chunks`` (with score) with score and confidence anew, in order. provider_scores: id, relevance; a missing one counts 0.

    large: for rows of any number, not just a top-k. Boosts are then computed once and written; the rows have id, score, confidence and what they are sorted by, and the rest is joined by id where it is wanted.
    """
    boosted = with_list(chunks).withColumn("score", F.col("score") + boost(query_tokens, feature))
    if large:
        boosted = materialize(boosted.select("id", "score", *ORDER), "boosted")
    out = minmax(boosted, C.EQUAL_RERANK, out="score", large=large)
    if provider_scores is not None:
        joined = out.join(provider_scores.select("id", F.col("relevance").alias("__ce")), "id", "left")
        blended = joined.withColumn("score", F.col("score") * C.METADATA_SHARE + F.coalesce("__ce", F.lit(0.0)) * C.CROSS_ENCODER_SHARE).drop("__ce")
        out = minmax(materialize(blended, "blended") if large else blended, C.EQUAL_RERANK, out="score", large=large)
    return out.withColumn("confidence", confidence(F.col("score"))).orderBy(F.col("score").desc(), *ORDER)


def with_list(chunks: DataFrame) -> DataFrame:
    """``chunks`` with dependencies as a list, also where they are a text with commas between the names."""
    if isinstance(chunks.schema["dependencies"].dataType, StringType):
        names = F.filter(F.transform(F.split("dependencies", ","), strip), lambda x: x != "")
        return chunks.withColumn("dependencies", F.coalesce(names, F.array().cast("array<string>")))
    return chunks


def rerank_many(chunks: DataFrame, provider_scores: DataFrame | None = None) -> DataFrame:
    """``chunks`` of many questions (with question, tokens, feature and score) with score, confidence and rank anew, by each question's rows alone.

    provider_scores: question, id, relevance. A question whose provider failed has none, and keeps the order by metadata.
    """
    out = normalised(with_list(chunks).withColumn("score", F.col("score") + boost(F.col("tokens"), F.col("feature"))), C.EQUAL_RERANK)
    if provider_scores is not None:
        given = provider_scores.select("question", "id", F.col("relevance").alias("__ce"), F.lit(True).alias("__any"))
        asked = Window.partitionBy("question")
        blend = F.col("score") * C.METADATA_SHARE + F.coalesce("__ce", F.lit(0.0)) * C.CROSS_ENCODER_SHARE
        joined = out.join(given, ["question", "id"], "left").withColumn("__any", F.max("__any").over(asked))
        out = normalised(joined.withColumn("score", F.when(F.col("__any"), blend).otherwise(F.col("score"))), C.EQUAL_RERANK).drop("__ce", "__any")
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), *ORDER)
    return out.withColumn("confidence", confidence(F.col("score"))).withColumn("rank", F.row_number().over(order))


def provider_rows(ids: list[str], given: list) -> list[tuple[str, float]]:
    """(id, relevance) of a cross-encoder's answer: scores in order, or pairs (index, score). Indices out of range and scores that aren't numbers are left out."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    pairs = [x if isinstance(x, (tuple, list)) and len(x) == 2 else (i, x) for i, x in enumerate(given)]
    return [(ids[i], float(x)) for i, x in pairs if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < len(ids) and number(x)]
