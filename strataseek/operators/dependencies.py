"""Names that a chunk depends on, as column expressions; edges and closures as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import bare_name

# Fixed values.
THRU = r"(?i)\bPERFORM\b\s+([A-Z0-9-]+)\s+\bTHRU\b\s+([A-Z0-9-]+)"
PERFORM = r"(?i)\bPERFORM\b\s+([A-Z0-9-]+)\b(?!\s+\bTHRU\b)"
COBOL_CALL = r"(?i)\bCALL\b\s+[\"']?([A-Z0-9_-]+)[\"']?"
COPY = r"(?i)\bCOPY\b\s+([A-Z0-9_-]+)"
USE, INCLUDE, CALL = r"(?i)\bUSE\s+(\w+)", r"(?i)\bINCLUDE\s+['\"]([^'\"]+)['\"]", r"(?i)\bCALL\s+(\w+)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _clean(names: Column, keep_case: bool = False) -> Column:
    fold = (lambda x: bare_name(x)) if keep_case else (lambda x: F.upper(bare_name(x)))
    return F.filter(F.transform(names, fold), lambda x: x != "")


def cobol_dependencies(text: Column) -> Column:
    """Ranges, then paragraphs performed outside them, calls and copybooks; each name once."""
    ranges = F.zip_with(_all(text, THRU, 1), _all(text, THRU, 2), lambda a, b: F.concat_ws(" THRU ", a, b))
    rest = F.regexp_replace(text, THRU, " ")
    return F.array_distinct(F.concat(_clean(ranges), _clean(_all(rest, PERFORM)), _clean(_all(text, COBOL_CALL)), _clean(_all(text, COPY))))


def fortran_dependencies(text: Column) -> Column:
    """Modules, included files (case kept) and calls; each name once, whatever its case."""
    found = F.concat(_clean(_all(text, USE)), _clean(_all(text, INCLUDE), keep_case=True), _clean(_all(text, CALL)))
    first = lambda seen, x: F.when(F.exists(seen, lambda y: F.upper(y) == F.upper(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(found, F.array().cast("array<string>"), first)


def dependencies(language: Column, text: Column) -> Column:
    return F.when(language == "cobol", cobol_dependencies(text)).when(language == "fortran", fortran_dependencies(text)).otherwise(F.array().cast("array<string>"))


def edges(chunks: DataFrame) -> DataFrame:
    """source, target: one row for each dependency of each chunk. A range depends on both of its ends."""
    each = chunks.select(F.col("name").alias("source"), F.explode("dependencies").alias("d"))
    return each.select("source", F.explode(F.split("d", " THRU ")).alias("target")).distinct()


def reverse(edge_table: DataFrame) -> DataFrame:
    """target, n_users. Who they are is what ``edge_table`` tells, row by row: a name may have any number of users."""
    return edge_table.groupBy("target").agg(F.count_distinct("source").alias("n_users"))
