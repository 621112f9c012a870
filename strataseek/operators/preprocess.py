"""Raw source text to clean code and comments. A file is one row, its lines an array: no shuffle, and files are the unit of parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import area, bound, is_blank, lines, lstrip, rstrip, strip
from strataseek.scratch import fence

DIVISIONS = ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")
UNIT_WORDS = r"(?i)\b(PROGRAM|SUBROUTINE|FUNCTION|MODULE|BLOCK\s+DATA)\b"
FIXED_EXTENSIONS = (".f", ".f77")
#: Marks in front of a line's code and of a continuation: noncharacters, which no text has.
LINE, MORE = "\ufdd1", "\ufdd0"


def number_lines(files: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """keys, line_no (from 1), line. Files without lines have none."""
    return files.select(*keys, F.posexplode(lines(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


NAMES = ("role", "piece", "comment", "goes_on")


def _line(role: Column, piece: Column, comment: Column, goes_on: Column | None = None) -> Column:
    """role is code, more (of the line before) or null. goes_on: into the next line."""
    values = (role, piece, comment, F.lit(False) if goes_on is None else goes_on)
    return F.struct(*(v.alias(n) for v, n in zip(values, NAMES, strict=True)))


def _cobol(line: Column) -> Column:
    mark, body = F.substring(line, 7, 1), area(line, 7, 72)
    none = F.lit(None).cast("string")
    plain = lambda b: F.when(
        b.contains("*>"), _line(F.lit("code"), rstrip(F.substring_index(b, "*>", 1)), strip(F.right(b, F.length(b) - F.instr(b, "*>") - 1)))
    ).otherwise(_line(F.lit("code"), b, none))
    return (
        F.when(F.length(line) < 7, _line(F.lit("code"), line, none))
        .when(mark.isin("*", "/", "D", "d"), _line(none, none, strip(body)))
        .when(mark == "-", _line(F.lit("more"), lstrip(area(line, 11, 72)), none))
        .otherwise(bound(body, plain))
    )


def _fixed(line: Column) -> Column:
    none = F.lit(None).cast("string")
    more = ~F.substring(line, 6, 1).isin(" ", "0", "")
    return (
        F.when(F.substring(line, 1, 1).isin("C", "c", "*"), _line(none, none, strip(area(line, 1))))
        .when(F.length(line) < 7, _line(F.lit("code"), strip(line), none))
        .otherwise(_line(F.when(more, "more").otherwise("code"), rstrip(area(line, 6, 72)), none))
    )


def _free(line: Column) -> Column:
    """A line that only has a comment is nothing to the continuation around it."""
    none = F.lit(None).cast("string")
    inner = lambda body: F.when(body.startswith("&"), lstrip(area(body, 1))).otherwise(body)

    def coded(code: Column, comment: Column) -> Column:
        goes_on = code.endswith("&")
        return _line(F.lit("code"), bound(F.when(goes_on, rstrip(F.left(code, F.length(code) - 1))).otherwise(code), inner), comment, goes_on)

    def noted(x: Column) -> Column:
        comment = strip(F.right(x, F.length(x) - F.instr(x, "!")))
        return bound(rstrip(F.substring_index(x, "!", 1)), lambda code: F.when(code == "", _line(none, none, comment)).otherwise(coded(code, comment)))

    return bound(rstrip(line), lambda x: F.when(x.contains("!"), noted(x)).otherwise(coded(x, none)))


def _parsed(line: Column, form: Column) -> Column:
    return F.when(form == "cobol", _cobol(line)).when(form == "fixed", _fixed(line)).otherwise(_free(line))


def fold(files: DataFrame) -> DataFrame:
    """Adds code (its lines joined) and comments to files with a column text and form (cobol, fixed or free).

    A continuation goes to the code line before, whose blank end is dropped; without one it is a line (Fortran) or lost (COBOL).
    Pieces are joined to one text with marks before them, and the marks are then replaced: what is linear in a file stays so.
    """
    names = files.columns
    form = F.col("form")
    df = files.select(*names, F.transform(lines(F.coalesce("text", F.lit(""))), lambda x: _parsed(x, form)).alias("__p"))
    df = df.select(
        *names,
        F.filter("__p", lambda x: x["role"].isNotNull()).alias("__kept"),
        F.filter(F.transform("__p", lambda x: x["comment"]), lambda c: c != "").alias("comments"),
    )

    def more(i: Column) -> Column:
        goes_on = F.when(form == "free", F.get("__kept", i - 1)["goes_on"]).otherwise(F.get("__kept", i)["role"] == "more")
        return F.coalesce(goes_on, F.lit(False)) & ((form == "cobol") | (i > 0))

    def marked(x: Column, i: Column) -> Column:
        """A piece that another continues loses its blank end; a continuation that is blank then leaves nothing."""
        inner = lambda piece, own: F.when(own & (piece == ""), "").otherwise(F.concat(F.when(own, MORE).otherwise(LINE), piece))
        plain = F.concat(F.when(more(i), MORE).otherwise(LINE), x["piece"])
        return F.when(more(i + 1), bound(rstrip(x["piece"]), lambda piece: inner(piece, more(i)))).otherwise(plain)

    joined = F.array_join(F.transform("__kept", marked), "")
    # What stands before the first line are continuations of nothing.
    own = bound(joined, lambda t: F.when(t.startswith(MORE), F.regexp_replace(t, rf"\A[^{LINE}]+", "")).otherwise(t))
    code = F.replace(F.translate(area(own, 1), LINE, "\n"), F.lit(MORE), F.when(form == "free", F.lit(" ")).otherwise(F.lit("")))
    return fence(df.select(*names, code.alias("code"), "comments"))


def divisions_found(code: Column) -> Column:
    """Of the four divisions, in their order, those that are named in the code."""
    return bound(F.upper(code), lambda c: F.filter(F.array(*map(F.lit, DIVISIONS)), lambda d: F.contains(c, F.concat(d, F.lit(" DIVISION")))))


def units_found(code: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(UNIT_WORDS), F.lit(1)), lambda x: F.regexp_replace(F.upper(x), r"\s+", " ")))


def form_signals(text: Column, first: int = 20) -> Column:
    """fixed, free: how many of the first non-blank lines look like either form. A diagnosis only; the extension decides."""
    some = F.slice(F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: ~is_blank(x)), 1, first)
    count = lambda *tests: F.aggregate(some, F.lit(0), lambda n, x: n + sum((t(x).cast("int") for t in tests), F.lit(0)))
    fixed = count(lambda x: F.substring(x, 1, 1).isin("C", "c", "*"), lambda x: x.startswith(" ") & ~F.substring(x, 6, 1).isin(" ", "0", ""))
    free = count(
        lambda x: x.contains("!") & ~is_blank(F.substring_index(x, "!", 1)),
        lambda x: rstrip(x).endswith("&"),
        lambda x: F.length(rstrip(x)) > 72,
    )
    return F.struct(fixed.alias("fixed"), free.alias("free"))


def looks_otherwise(form: Column, signals: Column) -> Column:
    """The signals speak for the other form than the extension's."""
    fixed, free = signals["fixed"], signals["free"]
    return F.when(form == "fixed", (free > fixed) & (fixed > 0)).when(form == "free", (fixed > free) & (free > 0)).otherwise(F.lit(False))


def source_form(language: Column, extension: Column) -> Column:
    return F.when(language == "cobol", "cobol").when(extension.isin(*FIXED_EXTENSIONS), "fixed").otherwise("free")


def preprocess(files: DataFrame, *also: str) -> DataFrame:
    """path, codebase, language, code, comments, source_format, found: one row for each file of a language. files: path, text, extension, language, codebase.

    also: more columns that go along. Everything happens inside a file's row: nothing is shuffled.
    """
    own = files.where(F.col("language").isin("cobol", "fortran")).select("path", "codebase", "language", *also, "text", source_form(F.col("language"), F.col("extension")).alias("form"))
    out = fold(own)
    found = F.when(F.col("language") == "cobol", divisions_found(F.col("code"))).otherwise(units_found(F.col("code")))
    return out.select("path", "codebase", "language", *also, "code", "comments", F.nullif("form", F.lit("cobol")).alias("source_format"), F.array_join(found, ",").alias("found"))
