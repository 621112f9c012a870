"""Lines that many documents share: kept in one document, dropped from the others.

Lines are normalised and hashed to 128 bits, one row for each distinct line of a
document goes to a count of documents by hash (combined before the shuffle), lines
over the threshold are looked up again, and the rest is put together by position.
Texts themselves are shuffled once at most, to meet the positions that they lose.

Cases: a null or empty text is one empty line; each row counts as a document; a row
without an id never keeps a shared line unless no row with an id has it; rows that
share the largest id all keep theirs; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.llm.scratch import discard, materialize
from strataseek.llm.slices import slices

#: Stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"

_LINES = "doc_id long, text_hash long, h1 long, h2 long, positions array<int>"


def _line_hashes(min_chars: int):
    low = (1 << 64) - 1

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, lambda b: b.column(2)):
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, own, text in zip(ids, hashes, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                found: dict[int, list[int]] = {}
                for at, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip(BLANKS).lower()  # bytes.lower() is A-Z alone
                    if len(key) >= min_chars and len(key.decode()) >= min_chars:
                        found.setdefault(xxhash.xxh3_128_intdigest(key), []).append(at)
                for h, positions in found.items():
                    for column, value in zip(out, (doc, own, signed(h >> 64), signed(h & low), positions), strict=True):
                        column.append(value)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "h1", "h2", "positions"],
            )

    return batches


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """__row (struct of all columns of ``docs``), doc_id, kept_text, n_lines, n_dropped: one row for each row of ``docs``."""
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), own.alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    # Written once: it is smaller than the texts, and both the count and the lookup read it.
    lines = materialize(read.mapInArrow(_line_hashes(min_chars), _LINES), "lines")
    shared = (
        lines.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # As a table of its own: it has one row for each hash, so the join can split the documents of a hot line.
    shared = materialize(shared, "shared-lines")
    # The text's hash is part of the key: rows that share an id may differ in their lines.
    lost = (
        lines.join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("__lost_id"), F.col("text_hash").alias("__lost_hash"))
        .agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("__lost"))
    )
    # As a table, so that its size decides whether the texts are shuffled to meet it.
    lost = materialize(lost, "lost-lines")
    discard(lines)
    discard(shared)
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), own.alias("__hash"))
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__lost_id")) & (F.col("__hash") == F.col("__lost_hash")), "left")
    rows = rows.select("__row", "doc_id", _lines(F.col("__text")).alias("__lines"), "__lost")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost")),
        lambda i: F.element_at(F.col("__lines"), i + 1),
    )
    return rows.select(
        "__row",
        "doc_id",
        F.when(F.col("__lost").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
