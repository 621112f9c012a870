"""Postings in blocks with bounds, so that a search skips blocks that can't matter; segments for upserts.

Documents of about one length form a block of about ``block_docs``. For each term and block there is one row: the documents with the term, their frequencies and
lengths, and what bounds their scores: the greatest frequency and the least length. A search reads the bounds of its terms alone, adds them up for each block and scores
the blocks with the highest sums; then only blocks whose bound reaches the k-th score found so far are read as well. No other can hold one of the k best, so the result is that
of scoring all.

Each ``add`` writes a segment of the new documents alone, with the term counts of the documents that they replace, so that frequencies are those of what is
there now. Documents of older segments that a newer one holds too are dropped from a search's candidates. ``remove`` writes a segment that holds documents as
gone. ``merge`` puts all segments into one. A segment counts once it is whole.
Ids are unique among the documents of one ``add``, as they are in a collection.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.config import BM25_B, BM25_K1
from strataseek.operators.commits import ABANDONED_MS, claims, listed, move, try_claim
from strataseek.operators.retrieval import dealt, files_of, query_terms, term_lists, top
from strataseek.scratch import delete, materialize

#: Length of a document that is gone.
GONE = -1
#: Bounds are compared with so much room, for sums that are added up in another order.
ROOM = 1e-9


@dataclass
class Statistics:
    docs: float
    mean: float
    df: dict[str, int] = field(default_factory=dict)


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64, files: int = 8, block_docs: int = 128, merge_after: int = 8):
        """buckets: of terms, one folder each. files: of a bucket, so that several tasks write the postings of a frequent term; more where a bucket has many."""
        self.spark, self.path, self.buckets, self.files, self.block_docs, self.merge_after = spark, path.rstrip("/"), buckets, files, block_docs, merge_after
        self.read, self.held = 0, 0

    # ------------------------------------------------------------ segments

    def _segments(self) -> list[str]:
        """Whole segments that count, from the oldest: the last merge and what came after."""
        names = [n for n in listed(self.spark, self.path, "totals/_SUCCESS") if n[:1] in "ms" and n[1:].isdigit()]
        base = max((int(n[1:]) for n in names if n[0] == "m"), default=0)
        return ([f"m{base}"] if base else []) + [f"s{n}" for n in sorted(int(n[1:]) for n in names if n[0] == "s") if n > base]

    def _of(self, segments: list[str], name: str) -> DataFrame | None:
        """Table ``name`` of the segments, with the place of its segment as ``age``."""
        out, reader = None, self.spark.read
        if name == "blocks":  # documents without any term leave no file to take a schema from
            kind = self.spark.read.parquet(f"{self.path}/{segments[0]}/forward").schema["id"].dataType.simpleString()
            reader = reader.schema(f"term string, block long, df int, max_tf long, min_n int, p array<struct<id:{kind},tf:bigint,n:int>>, bucket int")
        for age, segment in enumerate(segments):
            own = reader.parquet(f"{self.path}/{segment}/{name}").withColumn("age", F.lit(age))
            out = own if out is None else out.unionByName(own)
        return out

    def _live(self, rows: DataFrame, segments: list[str]) -> DataFrame:
        """The rows (id, age) whose document no newer segment holds."""
        if len(segments) < 2:
            return rows
        newer = self._of(segments, "forward").where("age > 0").groupBy(F.col("id").alias("__id")).agg(F.max("age").alias("__age"))
        return rows.join(newer, (F.col("id") == F.col("__id")) & (F.col("age") < F.col("__age")), "left_anti")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, forward: DataFrame) -> str:
        """The documents and blocks of a segment, in a folder that doesn't count yet."""
        target = f"{self.path}/new-{uuid.uuid4().hex}"
        forward.write.parquet(f"{target}/forward")
        forward = self.spark.read.schema(forward.schema).parquet(f"{target}/forward").where(F.col("n_terms") > GONE)
        # Bands of length, a quarter of a doubling each, cut by hash into blocks.
        band = F.floor(4 * F.log2(F.col("n_terms") + 1)).cast("long")
        sizes = {r["band"]: -(-r["n"] // self.block_docs) for r in forward.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each band: a hundred or so
        cuts = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.create_map(F.lit(0), F.lit(1)).cast("map<bigint,int>")
        block = band * (1 << 32) + F.pmod(F.xxhash64("id"), F.element_at(cuts, band))
        each = forward.select("id", "n_terms", block.alias("block"), F.explode("t").alias("x")).select("x.term", "block", "id", "x.tf", F.col("n_terms").alias("n"))
        files = files_of(forward, self.buckets, self.files)
        keyed = each.withColumns({"bucket": self._bucket(F.col("term")), "file": F.pmod(F.xxhash64("block"), F.lit(files))})
        rows = dealt(keyed, self.buckets, files, self.files, "bucket", "file").groupBy("bucket", "file", "term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "n"))).alias("p"), F.max("tf").alias("max_tf"), F.min("n").alias("min_n"))
        rows = rows.select("bucket", "term", "block", F.size("p").alias("df"), "max_tf", "min_n", "p").sortWithinPartitions("bucket", "term", "block")
        rows.write.partitionBy("bucket").parquet(f"{target}/blocks")
        return target

    def _count(self, target: str, lost: DataFrame | None, lost_docs: int = 0, lost_terms: int = 0) -> None:
        """What the segment adds to the numbers of the collection, and what it takes away."""
        if lost is not None:
            lost.write.mode("overwrite").parquet(f"{target}/lost")
        totals = self.spark.read.parquet(f"{target}/forward").where(F.col("n_terms") > GONE).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms"))
        totals.select((F.col("docs") - lost_docs).alias("docs"), (F.col("terms") - lost_terms).alias("terms")).write.mode("overwrite").parquet(f"{target}/totals")

    def _replaced(self, forward: DataFrame, segments: list[str]) -> tuple[DataFrame | None, int, int]:
        """Terms, documents and lengths that ``forward`` takes the place of."""
        if not segments:
            return None, 0, 0
        before = self._live(self._of(segments, "forward"), segments)
        gone = materialize(before.where(F.col("n_terms") > GONE).join(forward.select("id"), "id", "left_semi").select("n_terms", "t"), "replaced")
        n = gone.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
        return gone.select(F.explode("t.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), n["docs"], n["terms"]

    def add(self, docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> "PostingIndex":
        """Index ``docs``; those whose id is there already take its place."""
        forward = materialize(term_lists(docs, id_col=id_col, text_col=text_col), "term-lists")
        return self if forward.isEmpty() else self._put(forward)

    def remove(self, ids: DataFrame, *, id_col: str = "id") -> "PostingIndex":
        """Documents that a search doesn't find any more, nor counts; ids that aren't there do nothing."""
        segments = self._segments()
        if not segments:
            return self
        known = self._of(segments, "forward").drop("age").schema
        blank = {"id": F.col(id_col), "n_terms": F.lit(GONE), "t": F.array()}
        gone = materialize(ids.where(F.col(id_col).isNotNull()).select(*(blank[f.name].cast(f.dataType).alias(f.name) for f in known)).dropDuplicates(["id"]), "gone")
        return self if gone.isEmpty() else self._put(gone)

    def _put(self, forward: DataFrame) -> "PostingIndex":
        """A new segment of rows of ``forward``."""
        target = self._write(forward)
        number = 0
        while True:
            segments = self._segments()
            number = max(number, 1 + max((int(n[1:]) for n in segments), default=0))
            self._count(target, *self._replaced(forward, segments))
            if try_claim(self.spark, self.path, f"s{number}"):
                move(self.spark, target, f"{self.path}/s{number}")
                break
            # Another writer has this number: what we replace has to be counted anew once its segment is there. One that broke off loses its number.
            if claims(self.spark, self.path, "s").get(number, 0) < time.time() * 1000 - ABANDONED_MS:
                number += 1
            time.sleep(0.2)
        if len(segments) >= self.merge_after:
            self.merge()
        return self

    def merge(self) -> None:
        """One segment of all. Those that it replaces stay until the next merge, for searches that read them."""
        segments = self._segments()
        if len(segments) < 2 or not try_claim(self.spark, self.path, f"m{segments[-1][1:]}"):  # or another writer merges them
            return
        target = self._write(self._live(self._of(segments, "forward"), segments).where(F.col("n_terms") > GONE).drop("age"))
        self._count(target, None)
        move(self.spark, target, f"{self.path}/m{segments[-1][1:]}")
        for name in listed(self.spark, self.path):
            if name[:1] in "ms" and name[1:].isdigit() and int(name[1:]) < int(segments[0][1:]):
                delete(self.spark, f"{self.path}/{name}")

    # ------------------------------------------------------------ search

    def _statistics(self, segments: list[str], found: DataFrame, wanted: list[str]) -> Statistics:
        n = self._of(segments, "totals").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
        counts = found.groupBy("term").agg(F.sum("df").alias("df"))
        late = [s for s in segments[1:]]
        if late:
            lost = self._of(late, "lost").where(F.col("term").isin(wanted)).select("term", (-F.col("df")).alias("df"))
            counts = found.select("term", F.col("df").cast("long").alias("df")).unionByName(lost).groupBy("term").agg(F.sum("df").alias("df"))
        docs = float(n["docs"] or 0)
        return Statistics(docs, max(1e-9, (n["terms"] or 0) / docs if docs else 1.0), {r["term"]: r["df"] for r in counts.collect()})  # as many rows as the query has terms

    def topk(self, query: str, k: int, *, within: DataFrame | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
        """id, score of the k best by (score, id). within: ids that a search is restricted to; frequencies stay those of all.

        ``read`` and ``held`` then tell how many (term, block) rows were read and how many the terms have.
        """
        segments, wanted = self._segments(), query_terms(self.spark, query)
        if not segments or not wanted:
            kind = self._of(segments, "forward").schema["id"].dataType.simpleString() if segments else "string"
            self.read = self.held = 0
            return self.spark.createDataFrame([], f"id {kind}, score double")
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(self._bucket(F.col("t"))).collect()]
        rows = self._of(segments, "blocks").where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
        bounds = materialize(rows.select("age", "term", "block", "df", "max_tf", "min_n"), "bounds")
        s = self._statistics(segments, bounds, wanted)
        idf = F.lit(0.0)
        for term, df in s.df.items():
            idf = F.when(F.col("term") == term, F.log(1 + (F.lit(s.docs) - df + 0.5) / (df + 0.5))).otherwise(idf)
        part = lambda tf, n: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / F.lit(s.mean)))
        most = bounds.groupBy("age", "block").agg(F.sum(part(F.col("max_tf"), F.col("min_n"))).alias("bound"), F.count(F.lit(1)).alias("rows"))
        most = materialize(most, "block-bounds")

        def scored(keys: DataFrame) -> DataFrame:
            each = rows.join(keys, ["age", "block"], "left_semi").select("age", "term", F.explode("p").alias("x")).select("age", "term", "x.id", "x.tf", "x.n")
            found = self._live(each.groupBy("age", "id").agg(F.sum(part(F.col("tf"), F.col("n"))).alias("score")), segments).select("id", "score")
            return found.join(within.select("id"), "id", "left_semi") if within is not None else found

        few = 8 + -(-2 * k // self.block_docs)
        first = most.orderBy(F.col("bound").desc(), "age", "block").limit(few)  # by the bound alone: what is best by it comes first
        first = materialize(first, "first-blocks")
        best = materialize(top(scored(first), k), "first-hits")
        reached = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
        least = reached["score"] - ROOM if reached["n"] >= k else float("-inf")
        rest = most.where(F.col("bound") >= least).join(first.select("age", "block"), ["age", "block"], "left_anti")
        counted = most.agg(F.sum("rows").alias("held")).crossJoin(first.unionByName(rest).agg(F.sum("rows").alias("read"))).first()  # one row each
        self.held, self.read = counted["held"] or 0, counted["read"] or 0
        return top(best.unionByName(scored(rest)), k)
