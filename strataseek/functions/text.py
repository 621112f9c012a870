"""Column functions on text, with the exact white-space and line rules the operators rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\R|[\x1c-\x1e]"
#: A word. Runs of plain characters go by one range; only the others are held against all kinds of space.
WORD = rf"(?:[!-~]++|[^{SPACE[1:]})++"
#: The same characters, one by one, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_-]*"


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def bound(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` looks at it: inside lambdas nothing else shares work."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[!-~]|[^{SPACE[1:]}")


def lines(c: Column) -> Column:
    """Without an empty line after the last line end; an empty text has no lines."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return bound(F.split(c, LINE_END, -1), whole)


def word_count(c: Column) -> Column:
    """White-space words: the default token counter."""
    return F.regexp_count(c, F.lit(WORD))


def tokens(c: Column) -> Column:
    """Distinct lower-case identifier tokens, in the order of their first places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower))


def area(c: Column, start: int, end: int | None = None) -> Column:
    """Characters from ``start`` (0-based) up to ``end``."""
    return F.substring(c, start + 1, (end - start) if end is not None else 1 << 30)


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"{SPACE}+", " ")


def bare_name(c: Column) -> Column:
    """A dependency's name, without the marks around it."""
    no_marks = F.regexp_replace(collapse(c), r"\A[.,;:]+|[.,;:]+\z", "")
    return F.regexp_replace(no_marks, r"\A[\"']+|[\"']+\z", "")


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 name-based UUID, version 5, of a text in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; a dot file has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
