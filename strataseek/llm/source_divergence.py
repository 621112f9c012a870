"""How far the sources of a language differ in their words: chi-square divergences of all pairs, and the terms that stand out.

Terms are counted by (language, source, term) in each task before anything is shuffled, with the number of documents beside
the occurrences. Terms of at least ``min_docs`` documents of their language are kept. Their counts are dealt into blocks by the
term's hash; a block of a language is a dense int64 tile, groups by terms, of about ``CELLS`` cells, which meets the totals of all
of the language's groups (a group counts in every block, also where it has none of its terms). A tile gives the pairs of groups by
broadcasting one group's row against all, and the best terms of each group; partial pair sums are added up, and the best of
the tiles are merged to the best of all.

A share is p = 1 + floor(10^9 (count + 1) / (N + V)): N occurrences of kept terms in the group, V kept terms of the language. The part of
a term in the divergence from p to q is floor((p - q)^2 / q). All of it is exact in 64 bits up to 9 * 10^15 occurrences: the quotient is
taken in three steps of a factor 1000, and the parts of a pair sum to at most (10^9 + V)^2 + 10^9 + V.

Cases: null text, language and source are empty; repeated rows are documents of their own; a group without terms has a count of 0 for each
kept term; a language without kept terms has value 0 for each pair and no term rows; of the input only the three columns are read; an
empty table gives no rows. A very long text is counted in a block of its own, whose memory grows with its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.scratch import materialize

#: Bytes of texts that are counted together, about.
TEXT_BYTES = 4 << 20
#: Cells of a tile, about.
CELLS = 1 << 20
SCALE = 10**9

#: What is no letter becomes a blank; A-Z become small. Bytes from 0x80 on belong to letters of more bytes.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_TILE = pa.schema([(n, pa.string()) for n in ("part", "lang", "source", "item")] + [("value", pa.int64())])
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.RecordBatch:
    """lang, source, term, n, docs of some documents. A row without a term for each group, so that none is lost."""
    words = [t.translate(_LETTERS).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for own in words for w in own]
    codes, terms = pd.factorize(flat)
    names = sorted(set(groups))
    number = {g: i for i, g in enumerate(names)}
    group = np.array([number[g] for g in groups], np.int64)
    wide = max(1, len(terms))
    # Occurrences by (document, term), then documents and occurrences by (group, term).
    pairs, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * wide + codes, return_counts=True)
    kinds, at = np.unique(group[pairs // wide] * wide + pairs % wide, return_inverse=True)
    at = at.reshape(-1)
    total, docs = np.zeros(len(kinds), np.int64), np.bincount(at, minlength=len(kinds))
    np.add.at(total, at, n)
    of, none = kinds // wide, np.zeros(len(names), np.int64)
    return pa.record_batch(
        [
            *(pa.array([names[g][k] for g in of] + [g[k] for g in names], pa.string()) for k in (0, 1)),
            pa.array([terms[i].decode() for i in kinds % wide] + [None] * len(names), pa.string()),
            pa.array(np.concatenate([total, none])),
            pa.array(np.concatenate([docs, none])),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and the group's documents that have it. A null term: the group is there."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            start, held = 0, 0
            for i in range(len(texts) + 1):
                if i > start and (i == len(texts) or held + len(texts[i]) > TEXT_BYTES):
                    yield _count(groups[start:i], texts[start:i])
                    start, held = i, 0
                held += len(texts[i]) if i < len(texts) else 0

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(*(text(c).alias(f"c{i}") for i, c in enumerate((lang_col, source_col, text_col))))
    return read.mapInArrow(batches, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- tiles


def shares(counts: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kinds)), exact: the quotient's digits to base 1000."""
    whole = (total + kinds).reshape(-1, 1)
    rest = counts + 1
    found = rest // whole
    for _ in range(3):
        rest = rest % whole * 1000
        found = found * 1000 + rest // whole
    return found + 1


def parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def tile(lang: str, groups: pa.Table, rows: pa.Table, top: int, whole: bool) -> pa.Table:
    """The rows part, lang, source, item, value of a block. groups: source, total, kinds, lang_total of all groups. whole: give pairs although there is no term."""
    names = np.array(groups["source"].to_pylist(), object)
    terms = sorted(rows["term"].unique().to_pylist(), key=lambda t: t.encode())
    out: list[tuple] = []
    if terms or whole:
        row, column = {n: i for i, n in enumerate(names)}, {t: i for i, t in enumerate(terms)}
        counts = np.zeros((len(names), len(terms)), np.int64)
        counts[[row[s] for s in rows["source"].to_pylist()], [column[t] for t in rows["term"].to_pylist()]] = rows["n"].to_numpy()
        kinds = max(1, groups["kinds"][0].as_py())
        p = shares(counts, groups["total"].to_numpy(), kinds)
        q = shares(counts.sum(axis=0, keepdims=True), groups["lang_total"].to_numpy()[:1], kinds)[0]
        for i, name in enumerate(names):
            against = parts(p[i], p).sum(axis=1)  # one group against all, over the block's terms
            out += [("pair", lang, name, other, int(v)) for j, (other, v) in enumerate(zip(names, against, strict=True)) if j != i]
            loud = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = parts(p[i, loud], q[loud])
            best = np.argsort(-value, kind="stable")[:top]  # terms are sorted: ties in the order of their bytes
            out += [("term", lang, name, terms[loud[k]], int(value[k])) for k in best]
    columns = list(zip(*out, strict=True)) or [()] * len(_TILE)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _TILE, strict=True)], schema=_TILE)


def audit_sources(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence from each other source of the language. Part ``term``: the ``top`` terms by their part in the divergence from the language."""
    counts = materialize(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    in_lang = Window.partitionBy("lang", "term")
    marked = counts.where("term IS NOT NULL").withColumns({"__docs": F.sum("docs").over(in_lang), "__first": F.row_number().over(in_lang.orderBy("source")) == 1})
    kept = materialize(marked.where(F.col("__docs") >= min_docs).select("lang", "source", "term", "n", "__first"), "kept-terms")
    by_lang = kept.groupBy("lang").agg(F.count_if("__first").alias("kinds"), F.sum("n").alias("lang_total"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    totals = materialize(totals, "group-totals")
    # Enough blocks for the language with the most cells.
    most = totals.groupBy("lang").agg((F.count(F.lit(1)) * F.max("kinds")).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // cells))
    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    each = totals.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def of_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return tile(key[0].as_py(), right, left, top, key[1].as_py() == 0)

    found = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(of_block, "part string, lang string, source string, item string, value long")
    found = materialize(found, "tiles")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
