"""Source files: registry routes, recursive scan, encoding rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.config import codebases
from strataseek.functions.text import suffix


def routes(spark: SparkSession) -> DataFrame:
    """extension, language, codebase, preprocessor, chunker: the first codebase registered for each extension."""
    each = codebases(spark).withColumn("extension", F.explode("extensions"))
    first = F.min_by(F.struct("language", F.col("name").alias("codebase"), "preprocessor", "chunker"), "ord")
    return each.groupBy("extension").agg(first.alias("r")).select("extension", "r.*")


def with_route(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds extension, language, codebase, preprocessor and chunker; all null for a path that no route takes."""
    known = routes(df.sparkSession)
    return df.withColumn("extension", F.nullif(suffix(F.col(path_col)), F.lit(""))).join(F.broadcast(known), "extension", "left")


def is_supported(spark: SparkSession, path: Column) -> Column:
    found = [e for row in codebases(spark).select("extensions").collect() for e in row[0]]  # the registry: a handful of rows
    return suffix(path).isin(sorted(set(found)))


def looks_binary(content: Column) -> Column:
    """A NUL byte, or under 75 % of printable bytes. Every byte is one character of Latin-1."""
    text = F.decode(content, "ISO-8859-1")
    printable = F.regexp_count(text, F.lit(r"[\t\n\r\x20-\x7e]"))
    return (F.octet_length(content) > 0) & (text.contains("\x00") | (printable < F.octet_length(content) * 0.75))


#: The part of characters outside ASCII that may be control characters, for a text to count as Latin-1 with confidence.
MOST_CONTROLS = 0.3


def encoding(content: Column, language: Column) -> Column:
    """utf-8, iso-8859-1, or null for a file to skip: the rule of the offline detector.

    Empty and valid UTF-8 contents are utf-8. Binary COBOL files are skipped. Anything else is Latin-1, unless so many of its
    characters outside ASCII are control characters (0x80 to 0x9f) that this isn't likely. UTF-7, being ASCII, counts as utf-8.
    """
    text = F.decode(content, "ISO-8859-1")
    high, controls = F.regexp_count(text, F.lit(r"[\x80-\xff]")), F.regexp_count(text, F.lit(r"[\x80-\x9f]"))
    return (
        F.when((language == "cobol") & looks_binary(content), F.lit(None).cast("string"))
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .when(controls <= high * MOST_CONTROLS, "iso-8859-1")
    )


def decoded(content: Column, language: Column) -> Column:
    """The text of a file; empty if it is skipped."""
    kind = encoding(content, language)
    return F.when(kind == "utf-8", content.cast("string")).when(kind == "iso-8859-1", F.decode(content, "ISO-8859-1")).otherwise("")


def scan(spark: SparkSession, root: str, language: str | None = None, max_files: int = 0) -> DataFrame:
    """path, text, extension, language, codebase, ...: supported files under ``root``, ordered by path components if limited.

    Files that are skipped have an empty text; files that can't be read have no row, but are counted if only paths are asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    found = with_route(reader.load(root).select("path", "content")).where(F.col("language").isNotNull())
    if language:
        found = found.where(F.col("language") == language)
    if max_files:
        found = found.orderBy(F.split("path", "/")).limit(max_files)
    return found.withColumn("text", decoded(F.col("content"), F.col("language"))).drop("content")
