"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Counts that every row returns are computed for all rows. The other rules only decide,
so they stand in one CASE expression, which stops at the first that rejects. Their order
comes from a sample of rows drawn before anything is counted: each rule's seconds and share of rejected rows are measured, and
rules go by rejections per second. The order changes the cost, never the verdict.

Repeated passages are found inside a row: five-word windows are 64-bit hashes, sorted
with their positions, and equal neighbours mark words. Nothing is exploded or shuffled.

Cases: a null or empty text has no words and fails; repeated rows give repeated
results; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.llm.scratch import fence, materialize

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
#: Rows, about, of the sample that orders the rules.
SAMPLE_ROWS = 2000
#: Frequent words of the four languages.
STOP_WORDS = "the of and to in a is that for with der die das und ein ist von mit le la les de et des que un est el los las en y del por"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Over the columns of ``measure``."""
    stop = "|".join(STOP_WORDS.split())
    words = F.col("n_words")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > words),
        Rule("word length", (F.col("word_chars") > 14 * words) | (F.col("word_chars") < 2 * words)),
        Rule("repeated lines", F.col("n_dup_lines") * 10 > F.col("__n_lines") * 3),
        Rule("capitals", F.regexp_count("__text", F.lit(r"\p{Lu}")) * 10 > F.col("word_chars") * 4),
        Rule("exclamations", F.regexp_count("__text", F.lit(r"[!?]")) * 4 > words),
        Rule("no frequent word", ~F.col("__text").rlike(rf"(?i)(?<!\p{{L}})(?:{stop})(?!\p{{L}})")),
        Rule("no letters", F.regexp_count("__text", F.lit(r"\p{L}")) * 10 < F.col("word_chars") * 6),
        Rule("ellipses", F.regexp_count("__text", F.lit(r"(?m)(?:\.\.\.|…)$")) * 10 > F.col("__n_lines") * 3),
        Rule("bullets", F.regexp_count("__text", F.lit(r"(?m)^[\x20\t]*[-*•]")) * 10 > F.col("__n_lines") * 9),
    ]


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from __words: words in windows that occur twice or more."""
    h = F.col("__h")
    window = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
    many = F.size(h) >= WINDOW
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    df = df.withColumn("__w", F.when(many, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))).drop("__h")
    # Rows without a repeated window, most of them, stop here.
    twice = F.size(F.array_distinct("__w")) < F.size("__w")
    pairs = F.sort_array(F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("__s", F.when(twice, pairs)).drop("__w")
    s = F.col("__s")
    equal = lambda x, k: x["w"].eqNullSafe(F.get(s, k - 1)["w"]) | x["w"].eqNullSafe(F.get(s, k + 1)["w"])
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter(s, equal), lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    steps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)).cast("long"))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b) + WINDOW
    return df.withColumn("n_repeat_words", F.when(p.isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("__p")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and __text and __n_lines for the rules."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    df = df.withColumn("__words", F.array_remove(F.split("__text", BLANK + "+", -1), ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)))
    df = df.select(
        "doc_id",
        "__text",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("__n_lines"),
    )
    df = _repeats(df)
    return fence(df.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)))


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, *, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """By rejections per second on those of about ``sample_rows`` rows, from all of the table, that pass the base."""
    # Rows are drawn first, so only theirs is measured, where it lies.
    drawn = docs.sample(min(1.0, sample_rows / max(1, docs.count())), seed=42)
    sample = materialize(measure(drawn, id_col=id_col, text_col=text_col), "rule-sample").where(~F.col("base_failed"))

    def seconds(*columns: Column) -> float:
        began = time.perf_counter()
        sample.select(F.length("__text"), *columns).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds()
    floor = seconds()
    shares = sample.agg(F.count(F.lit(1)), *(F.avg(rule.rejects.cast("double")) for rule in rules)).first()
    worth = [(share or 0.0) / max(seconds(rule.rejects) - floor, 1e-3) for rule, share in zip(rules, shares[1:], strict=True)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row for each row of ``docs``."""
    measured = measure(docs, id_col=id_col, text_col=text_col)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in order_rules(docs, default_rules() if rules is None else rules, id_col=id_col, text_col=text_col):
        verdict = verdict.when(rule.rejects, F.lit(False))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(F.lit(True)).alias("kept"))
