"""Chunk sizes: small neighbours merge (inside a file's row), oversized chunks split (a greedy pass in Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from strataseek.config import MAX_CHUNK_TOKENS, MIN_CHUNK_TOKENS
from strataseek.functions.bytepairs import BytePairs, Growing
from strataseek.functions.text import SPACE, bound, strip
from strataseek.scratch import fence


#: In front of a joint whose blanks are dropped: a noncharacter.
JOINT = "\ufdd0"


def _merged(group: Column, mixed: Column) -> Column:
    """One chunk of an array of neighbours, as if each had gone to those before it: ends are stripped after each but the first."""
    parts = lambda c: F.filter(F.transform(F.split(c["name"], r"\+"), strip), lambda x: x != "")

    def content(g: Column) -> Column:
        joined = F.array_join(F.transform(g, lambda c, i: F.concat(F.when(i > 1, JOINT + "\n").when(i == 1, "\n").otherwise(""), c["content"])), "")
        unjoined = lambda t: F.when(t.contains(JOINT), F.regexp_replace(t, rf"(?:(?<!{SPACE}){SPACE}++{JOINT}|{JOINT})", "")).otherwise(t)
        return strip(bound(joined, unjoined))

    def name(named: Column) -> Column:
        # Two without a name become one that has one.
        nameless = F.size(F.flatten(F.slice(named, 1, 2))) == 0
        return F.array_join(F.array_distinct(F.concat(F.when(nameless, F.array(F.lit("MERGED"))).otherwise(F.array().cast("array<string>")), F.flatten(named))), "+")

    def several(g: Column) -> Column:
        return F.struct(
            content(g).alias("content"),
            F.array_min(F.transform(g, lambda c: c["line_start"])).alias("line_start"),
            F.array_max(F.transform(g, lambda c: c["line_end"])).alias("line_end"),
            F.get(g, F.lit(0))["chunk_type"].alias("chunk_type"),
            bound(F.transform(g, parts), name).alias("name"),
            bound(F.array_distinct(F.transform(g, lambda c: c["division"])), lambda d: F.when(F.size(d) == 1, F.get(d, F.lit(0))).otherwise(mixed)).alias("division"),
            F.aggregate(g, F.lit(0), lambda n, c: n + c["token_count"]).alias("token_count"),
        )

    return bound(group, lambda g: F.when(F.size(g) == 1, F.get(g, F.lit(0))).otherwise(several(g)))


def _merge_ends(contents: list[str], least: int, pairs: BytePairs) -> tuple[list[int], bool, list[int]]:
    """Where groups after the first begin, whether the last joins the one before, and the tokens of the groups after that."""
    ends: list[int] = []
    tokens: list[int] = []
    texts: list[str] = []
    for at, text in enumerate(contents):
        if at and tokens[-1] < least:
            texts[-1] = f"{texts[-1]}\n{text}".strip()
            tokens[-1] = pairs.count(texts[-1])
        else:
            texts.append(text)
            tokens.append(pairs.count(text))
            ends += [at] if at else []
    tail = bool(tokens) and tokens[-1] < least
    if tail and len(tokens) > 1:
        tokens[-2:] = [pairs.count("\n".join(texts[-2:]).strip())]
    return ends, tail, tokens


def _with_ends(df: DataFrame, col: str, least: int, pairs: BytePairs) -> DataFrame:
    names = df.columns
    out = StructType([*df.schema.fields, StructField("__ends", ArrayType(IntegerType())), StructField("__tail", BooleanType()), StructField("__tokens", ArrayType(IntegerType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [_merge_ends([c["content"] or "" for c in own or []], least, pairs) for own in batch.column(names.index(col)).to_pylist()]
            more = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32())))]
            yield pa.record_batch([*batch.columns, *more], names=out.names)

    return df.mapInArrow(batches, out)


def merge_small(df: DataFrame, mixed: Column | str, *, col: str = "chunks", least: int = MIN_CHUNK_TOKENS, pairs: BytePairs | None = None) -> DataFrame:
    """``df`` with its array of chunks merged: one under ``least`` tokens takes in the next, again and again; a small last one joins the one before.

    Tokens are white-space words, so those of a merged chunk are the sum. Where groups begin is found on counts alone; contents are put together once.
    With ``pairs``, tokens are byte pairs, which don't add up: each merged content is counted anew. ``mixed`` names unequal divisions.
    """
    names = [c for c in df.columns if c != col]
    mixed = F.lit(mixed) if isinstance(mixed, str) else mixed
    df = fence(df.select(*names, F.col(col).alias("__c")))
    if pairs is not None:
        found = fence(_merged_at(_with_ends(df, "__c", least, pairs).withColumn("__b", F.concat(F.array(F.lit(0)), "__ends")), names, mixed, col, "__tokens"))
        return found.select(*names, F.transform(col, lambda c, i: c.withField("token_count", F.get("__tokens", i))).alias(col))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("open"), F.lit(0).alias("at"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["at"] > 0) & (acc["open"] >= least)
        return F.struct(
            F.when(full, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"]).alias("ends"),
            F.when(full, n).otherwise(acc["open"] + n).alias("open"),
            (acc["at"] + 1).alias("at"),
        )

    df = df.select(*names, "__c", F.aggregate(F.transform("__c", lambda c: c["token_count"]), start, step).alias("__a"))
    df = df.select(*names, "__c", F.concat(F.array(F.lit(0)), "__a.ends").alias("__b"), (F.col("__a.open") < least).alias("__tail"))
    return _merged_at(df, names, mixed, col)


def _merged_at(df: DataFrame, names: list[str], mixed: Column, col: str, *more: str) -> DataFrame:
    """Chunks __c put together from each place in __b on; with __tail, the last two of these too."""
    names = [*names, *more]
    group = lambda at, k: F.slice(F.col("__c"), at + 1, F.coalesce(F.get("__b", k + 1), F.size("__c")) - at)
    df = fence(df.select(*names, "__tail", F.when(F.size("__c") > 0, F.transform("__b", lambda at, k: _merged(group(at, k), mixed))).otherwise(F.col("__c")).alias("__m")))
    last = F.concat(F.slice("__m", F.lit(1), F.size("__m") - 2), F.array(_merged(F.slice("__m", -2, 2), mixed)))
    return fence(df.select(*names, F.when(F.col("__tail") & (F.size("__m") > 1), last).otherwise(F.col("__m")).alias(col)))


def split_by_pairs(content: str, first_line: int, last_line: int, name: str, most: int, pairs: BytePairs) -> list[tuple[str, int, int, str, int]]:
    """As ``split_text``, by byte pairs: what a part would have with one more line is counted on the text as it grows."""
    total = pairs.count(content)
    rows = content.splitlines()
    if total <= most or not rows:
        return [(content, first_line, last_line, name, total)]
    parts: list[tuple[str, int, int, str]] = []
    held: list[str] = []
    start, grown = first_line, Growing(pairs)
    for at, line in enumerate(rows, first_line):
        n, more = grown.after(f"\n{line}" if held else line)
        if held and n > most:
            parts.append(("\n".join(held), start, at - 1, name))
            held, start = [], at
            n, more = Growing(pairs).after(line)
            held, grown = [line], more
        elif not held and n > most:
            words: list[str] = []
            grown = Growing(pairs)
            for word in line.split():
                n, more = grown.after(f" {word}" if words else word)
                if words and n > most:
                    parts.append((" ".join(words), at, at, f"{name}#{len(parts) + 1}"))
                    words, (_, more) = [], Growing(pairs).after(word)
                words.append(word)
                grown = more
            if words:
                parts.append((" ".join(words), at, at, f"{name}#{len(parts) + 1}"))
            start, grown = at + 1, Growing(pairs)
        else:
            held.append(line)
            grown = more
    if held:
        parts.append(("\n".join(held), start, last_line, name))
    several = len(parts) > 1
    return [(c, a, b, f"{own}#{i}" if several and "#" not in own else own, pairs.count(c)) for i, (c, a, b, own) in enumerate(parts, 1)]


def split_text(content: str, first_line: int, last_line: int, name: str, most: int) -> list[tuple[str, int, int, str, int]]:
    """(content, line_start, line_end, name, tokens) of the parts. Words are white-space words, so counts of lines add up.

    Lines go together while they fit. A line over the limit is cut by words if it begins a part, and stays whole otherwise.
    """
    rows = [(line, len(line.split())) for line in content.splitlines()]
    if sum(n for _, n in rows) <= most or not rows:
        return [(content, first_line, last_line, name, sum(n for _, n in rows))]
    parts: list[tuple[str, int, int, str, int]] = []
    held: list[str] = []
    size, start = 0, first_line
    for at, (line, n) in enumerate(rows, first_line):
        if held and size + n > most:
            parts.append(("\n".join(held), start, at - 1, name, size))
            held, size, start = [line], n, at
        elif not held and n > most:
            words = line.split()
            for i in range(0, n, most):
                own = words[i : i + most]
                parts.append((" ".join(own), at, at, f"{name}#{len(parts) + 1}", len(own)))
            start = at + 1
        else:
            held.append(line)
            size += n
    if held:
        parts.append(("\n".join(held), start, last_line, name, size))
    if len(parts) > 1:
        parts = [(c, a, b, own if "#" in own else f"{own}#{i}", n) for i, (c, a, b, own, n) in enumerate(parts, 1)]
    return parts


def split_oversized(chunks: DataFrame, most: int = MAX_CHUNK_TOKENS, *, pairs: BytePairs | None = None) -> DataFrame:
    """The rows of ``chunks`` (with content, line_start, line_end, name, token_count), cut to the limit. No shuffle. pairs: tokens are byte pairs, not words."""
    names = chunks.columns
    at = {n: names.index(n) for n in ("content", "line_start", "line_end", "name", "token_count")}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            index: list[int] = []
            new: list[tuple[str, int, int, str, int]] = []
            own = [batch.column(at[n]).to_pylist() for n in ("content", "line_start", "line_end", "name")]
            for i, row in enumerate(zip(*own, strict=True)):
                parts = split_by_pairs(row[0] or "", *row[1:], most, pairs) if pairs else split_text(row[0] or "", *row[1:], most)
                index += [i] * len(parts)
                new += parts
            out = batch.take(pa.array(index, pa.int64()))
            columns = list(out.columns)
            for name, values in zip(("content", "line_start", "line_end", "name", "token_count"), zip(*new, strict=True) if new else ([],) * 5, strict=True):
                columns[at[name]] = pa.array(list(values), batch.schema.field(at[name]).type)
            yield pa.record_batch(columns, names=names)

    return chunks.mapInArrow(batches, chunks.schema)
