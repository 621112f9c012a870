"""Corpus preparation: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes all rows that the one before kept and returns the columns of ``documents``
(the last: places of pieces). ``run`` writes each stage's result to the shared folder and
reads it again for the next. Nulls, repeated rows and empty tables are treated as the
operators' docstrings say; all columns of the input are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.llm.decontamination import drop_contaminated
from strataseek.llm.line_dedup import drop_shared_lines
from strataseek.llm.near_copies import near_copies
from strataseek.llm.packing import cut_documents, place_pieces
from strataseek.llm.quality_model import score_quality
from strataseek.llm.scratch import materialize

#: SQL can't express the classifier, the fingerprints or the packing.
ORACLE_SQL = None
CAPACITY = 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes to be good."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where("predicted = 1").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, but for the one that keeps them. n_chars follows the text."""
    kept = drop_shared_lines(docs)
    text = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(text.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    Fingerprints within 9 of 64 and 22 of 128 bits, and equal bands of min-hashes, are candidates only; each link is confirmed on the shingles.
    """
    return near_copies(docs, shingle=5, similarity=0.8, threshold=9, all_bits=22).where("is_first").select("__row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    pieces = cut_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), CAPACITY)
    return place_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
