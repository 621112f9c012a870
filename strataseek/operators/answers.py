"""Prompt context, citations and parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataseek.functions.text import strip

# Fixed value.
CITATION = r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+:\d+(?:-\d+)?"
# Fixed value: the first sentence and the words "insufficient evidence".
NO_CONTEXT = "No retrieved context was provided. An answer without sources has insufficient evidence: say so."


def _or(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))


def citation(path: Column, start: Column, end: Column) -> Column:
    first = F.greatest(start, F.lit(0))
    return F.concat(_or(path, "unknown-file"), F.lit(":"), first.cast("string"), F.lit("-"), F.greatest(end, first).cast("string"))


def context_block(chunks: Column) -> Column:
    """One text of an array of (file_path, line_start, line_end, name, division, content, metadata), a map that names and divisions fall back to."""

    def one(c: Column, i: Column) -> Column:
        given = lambda field, key: F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (c[field], F.try_element_at(c["metadata"], F.lit(key)))))
        division = given("division", "division")
        return F.concat_ws(
            "\n",
            F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]")),
            F.concat(F.lit("Source: "), citation(c["file_path"], c["line_start"], c["line_end"])),
            F.concat(F.lit("Name: "), F.coalesce(given("name", "paragraph_name"), F.lit("(unknown)"))),
            F.concat(F.lit("Division: "), division),
            F.lit("Content:"),
            F.coalesce(F.nullif(c["content"], F.lit("")), F.lit("(empty chunk content)")),
        )

    return F.when(F.size(chunks) == 0, F.lit(NO_CONTEXT)).otherwise(F.array_join(F.transform(chunks, one), "\n\n"))


def parse_confidence(answer: Column) -> Column:
    """The first stated level; LOW if none is."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(answer, r"(?i)\bconfidence\s*:\s*(HIGH|MEDIUM|LOW)\b", 1)), F.lit("")), F.lit("LOW"))


def citations(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0)))


def looks_grounded(answer: Column) -> Column:
    """The smoke test's rule: a colon and a digit."""
    return answer.contains(":") & answer.rlike(r"[0-9]")


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def _content(response: Column, path: str) -> Column:
    """The text at ``path`` of a JSON response: a string, or a list whose strings and objects with a text are put together; null for anything else."""
    whole = F.try_parse_json(response)
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    text = lambda v, at: F.when(is_text(F.try_variant_get(v, at, "variant")), F.try_variant_get(v, at, "string"))
    parts = F.transform(F.try_variant_get(whole, path, "array<variant>"), lambda x: F.coalesce(text(x, "$"), text(x, "$.text"), F.lit("")))
    return F.coalesce(text(whole, path), F.array_join(parts, ""))


def message_content(response: Column) -> Column:
    """Of a chat completion: the message's text without blanks around it, null if there is none."""
    return strip(_content(response, "$.choices[0].message.content"))


def stream_delta(event: Column) -> Column:
    """Of an event of a streamed completion: its text, empty if there is none."""
    return F.coalesce(_content(event, "$.choices[0].delta.content"), F.lit(""))
