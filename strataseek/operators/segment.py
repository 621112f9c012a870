"""Structural blocks of clean code, and the chunks made of them. A file is one row: its lines are an array, and blocks come from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import bound, is_blank, lines, strip, word_count
from strataseek.scratch import fence

# Fixed values.
UNIT_HEADER = (
    r"(?i)^\s*(?:(?:RECURSIVE|PURE|ELEMENTAL|IMPURE)\s+)?(?:(?:INTEGER|REAL|DOUBLE\s+PRECISION|COMPLEX|CHARACTER|LOGICAL)\s+)?"
    r"(SUBROUTINE|FUNCTION|PROGRAM|MODULE|BLOCK\s+DATA)\s+([A-Z_]\w*)"
)
UNIT_END = r"(?i)^\s*END\s*(?:(SUBROUTINE|FUNCTION|PROGRAM|MODULE|BLOCK\s+DATA)\s*\w*)?\s*$"
CHUNK = "content string, line_start int, line_end int, chunk_type string, name string, division string, token_count int"


def division_header(line: Column) -> Column:
    """The division that a line opens, or null."""
    named = bound(F.upper(line), lambda x: F.when(x.contains(" DIVISION."), F.regexp_extract(strip(x), r"^(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE) DIVISION\.$", 1)))
    return F.nullif(named, F.lit(""))


def paragraph_name(line: Column, plain: bool = False) -> Column:
    """The paragraph that a line opens, or null. plain: a letter whose capital is two, as ß, is none of a name."""
    fits = lambda x, bare: bare.rlike(r"\A[A-Z0-9-]+\z") & ((F.length(bare) == F.length(x)) if plain else F.lit(True))
    named = lambda x: bound(strip(F.left(x, F.length(x) - 1)), lambda own: bound(F.upper(own), lambda bare: F.when(fits(own, bare), bare)))
    return bound(strip(line), lambda x: F.when(x.endswith(".") & line.rlike(r"\A\S"), named(x)))


BLOCK = ("line_start", "line_end", "chunk_type", "name", "division")


def _block(line_start: Column, line_end: Column, chunk_type: Column | str, name: Column | str, division: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    values = (line_start.cast("int"), line_end.cast("int"), lit(chunk_type), lit(name), lit(division))
    return F.struct(*(v.alias(n) for v, n in zip(values, BLOCK, strict=True)))


def cobol_blocks(files: DataFrame, lines_col: str = "lines", out: str = "blocks", *, plain_names: bool = False) -> DataFrame:
    """Adds blocks, an array by line, to files with lines (if they aren't null): paragraphs of the procedure division, or one block for the file."""
    names, files = files.columns, fence(files)
    heads = F.transform(lines_col, lambda x, i: F.struct((i + 1).alias("no"), paragraph_name(x, plain_names).alias("name"), (division_header(x) == "PROCEDURE").alias("opens")))
    df = files.select(*names, F.filter(heads, lambda h: h["name"].isNotNull() | h["opens"]).alias("__marks"))
    df = df.select(*names, "__marks", F.get(F.filter("__marks", lambda h: h["opens"]), F.lit(0))["no"].alias("__procedure"))
    df = df.select(*names, "__procedure", F.filter("__marks", lambda h: h["name"].isNotNull() & (h["no"] > F.col("__procedure"))).alias("__heads"), F.size(lines_col).alias("__n"))
    procedure, n = F.col("__procedure"), F.col("__n")
    each = F.transform("__heads", lambda h, i: _block(h["no"], F.coalesce(F.get("__heads", i + 1)["no"] - 1, n), "paragraph", h["name"], "PROCEDURE"))
    none = procedure.isNull()
    one = _block(F.coalesce(procedure, F.lit(1)), n, "paragraph", F.when(none, "FILE-BLOCK").otherwise("PROCEDURE-BLOCK"), F.when(none, "UNKNOWN").otherwise("PROCEDURE"))
    return fence(df.select(*names, F.when(F.size("__heads") > 0, each).otherwise(F.array(one)).alias(out)))


def fortran_blocks(files: DataFrame, lines_col: str = "lines", out: str = "blocks") -> DataFrame:
    """Adds blocks (null without lines): program units, and the lines before, between and behind them.

    A unit ends with the first END behind its header, or before the next header, or with the file.
    """
    names, files = files.columns, fence(files)
    kind = lambda x: F.nullif(F.regexp_replace(F.upper(F.regexp_extract(x, UNIT_HEADER, 1)), r"\s+", " "), F.lit(""))
    mark = lambda x: F.struct(x["no"].alias("no"), kind(x["line"]).alias("kind"), F.upper(F.regexp_extract(x["line"], UNIT_HEADER, 2)).alias("name"), x["line"].rlike(UNIT_END).alias("ends"))
    # One look at each line; what is not a mark, most lines, isn't parsed further.
    some = F.filter(F.transform(lines_col, lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"))), lambda x: x["line"].rlike(UNIT_HEADER) | x["line"].rlike(UNIT_END))
    df = files.select(*names, F.transform(some, mark).alias("__marks"), F.size(lines_col).alias("__n"))

    def unit(m: Column, i: Column) -> Column:
        following = F.get("__marks", i + 1)
        end = F.when(following["kind"].isNotNull(), following["no"] - 1).otherwise(following["no"])
        return _block(m["no"], F.coalesce(end, F.col("__n")), F.lower(F.regexp_replace(m["kind"], " ", "_")), m["name"], m["kind"])

    units = F.filter(F.transform("__marks", unit), lambda u: u["division"].isNotNull())
    df = df.select(*names, "__n", units.alias("__units"))

    def gap(i: Column) -> Column:
        before, after = F.get("__units", i - 1), F.get("__units", i)
        return _block(F.coalesce(F.when(i > 0, before["line_end"]), F.lit(0)) + 1, F.coalesce(after["line_start"] - 1, F.col("__n")), "file_block", "FILE-BLOCK", "UNKNOWN")

    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size("__units")), gap), lambda g: g["line_start"] <= g["line_end"])
    return fence(df.select(*names, F.array_sort(F.concat("__units", gaps)).alias(out)))


def block_chunks(processed: DataFrame, *keys: str, plain_names: bool = False) -> DataFrame:
    """keys, chunks (array, by line): one row for each file, and nothing is shuffled. Blank gaps are dropped. processed: keys (language among them), code."""
    cobol = F.col("language") == "cobol"
    files = processed.select(*keys, lines(F.col("code")).alias("lines"))
    files = files.select(*keys, "lines", F.when(cobol, F.col("lines")).alias("__cobol"), F.when(~cobol, F.col("lines")).alias("__fortran"))
    files = fortran_blocks(cobol_blocks(files, "__cobol", "__b1", plain_names=plain_names), "__fortran", "__b2")
    files = fence(files.select(*keys, "lines", F.when(cobol, F.col("__b1")).otherwise(F.col("__b2")).alias("blocks")))

    def chunk(b: Column) -> Column:
        content = F.array_join(F.slice("lines", b["line_start"], b["line_end"] - b["line_start"] + 1), "\n")
        return F.struct(content.alias("content"), *(b[n].alias(n) for n in BLOCK))

    files = fence(files.select(*keys, F.transform("blocks", chunk).alias("chunks")))
    kept = F.filter("chunks", lambda c: (c["name"] != "FILE-BLOCK") | ~is_blank(c["content"]))
    counted = F.transform(kept, lambda c: F.struct(c["content"].alias("content"), *(c[n].alias(n) for n in BLOCK), word_count(c["content"]).cast("int").alias("token_count")))
    return fence(files.select(*keys, counted.alias("chunks")))
