"""Processed files to sized chunks with dependencies."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.bytepairs import BytePairs
from strataseek.functions.text import is_blank
from strataseek.operators.dependencies import dependencies
from strataseek.operators.segment import block_chunks
from strataseek.operators.sizing import merge_small, split_oversized

KEYS = ("path", "codebase", "language")


def metadata() -> Column:
    """The eight fields of a chunk that retrieval and points rely on, as texts."""
    fields = {"paragraph_name": "name"} | {k: k for k in ("division", "line_start", "line_end", "chunk_type", "language", "codebase")} | {"file_path": "path"}
    return F.create_map(*chain.from_iterable((F.lit(k), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in fields.items()))


def chunk(processed: DataFrame, pairs: BytePairs | None = None, *, also: tuple[str, ...] = (), keep_files: bool = False, plain_names: bool = False) -> DataFrame:
    """path, codebase, language, content, line_start, line_end, chunk_type, name, division, token_count, part, dependencies, metadata.

    processed: path, codebase, language, code. part: the place among the file's chunks. pairs: tokens are byte pairs by this table, else white-space words.
    also: more columns of ``processed`` that go with each chunk. keep_files: a file without chunks has a row without lines.
    plain_names: of ``segment.paragraph_name``.
    """
    keys = (*KEYS, *also)
    files = processed.select(*keys, "code")
    if not keep_files:
        files = files.where(~is_blank(F.col("code")))
    each = F.posexplode_outer if keep_files else F.posexplode
    merged = merge_small(block_chunks(files, *keys, plain_names=plain_names), F.when(F.col("language") == "cobol", "UNKNOWN").otherwise("MIXED"), pairs=pairs)
    chunks = merged.select(*keys, each("chunks").alias("part", "c")).select(*keys, "c.*", "part")
    return split_oversized(chunks, pairs=pairs).withColumn("dependencies", dependencies(F.col("language"), F.col("content"))).withColumn("metadata", metadata())
