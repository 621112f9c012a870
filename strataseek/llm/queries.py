"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.packing import cut_documents, place_pieces

    capacity = 2048
    pieces = cut_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place_pieces(digests, capacity)


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, threshold=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.token_counts import count_tokens

    limit = 4096
    counts = count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=limit)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars", "limit_chars")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.quality_model import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.quality_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.pii import BASE_KINDS, find_pii

    found = find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.scratch import new_path
    from strataseek.llm.warc import archive_pages, read_archives

    path = new_path(spark, "warc")
    archive_pages(_table(spark, sf_dir, "pages"), path)
    # Each kind by a filter on the header that is pushed down to its own reader (two scans of one relation would share theirs).
    responses, revisits = (read_archives(spark, path, payload=False).where(F.col("warc_type") == kind) for kind in ("response", "revisit"))
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.decontamination import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op9_weighted_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.sharding import Tree, assign_shards

    tree = Tree.even(2, 3, 4)
    return assign_shards(_table(spark, sf_dir, "documents"), tree, tree.grown(1, 2))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.line_dedup import drop_shared_lines

    kept = drop_shared_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.periodic_runs import find_runs
    from strataseek.llm.scratch import fence

    # A tenth of the documents, by the id's hash, goes round in a period from some word on.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = fence(_table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")))
    n, g = F.size("w"), F.col("g")
    docs = fence(docs.select("doc_id", "text", "w", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).alias("a")))
    a = F.col("a")
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - a) / (3 + g % 8)))
    around = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % F.col("p")).cast("int")))
    found = find_runs(docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(around, " ")).otherwise(F.col("text")).alias("text")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = fence(found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), listed.alias("listed"), "collapsed"))
    length = -F.col("b.l")
    return found.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.floor(1000 * length / F.col("b.period")).alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A conversation that holds the template's own marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op12_chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.reply_trees import format_replies, read_back, turns_as_replies

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    replies = turns_as_replies(turns.unionByName(marked))
    found = read_back(format_replies(replies, tree_col="conv_id", checked=True))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataseek.llm.source_divergence import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from strataseek.llm import oracles

    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}
