"""Postings in blocks against scores of all texts, over upserts and merges; writers at the same time."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strataseek.operators import points, retrieval
from strataseek.operators.postings import PostingIndex


def corpus(rnd, ids):
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([0, 3, 8, 40, 150])))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def shown(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


QUERIES = ["w0 w250 w299", "w200", "w3 W3 w4", "absent", "", "w0"]


def test_upserts_and_merges_score_as_all_texts(spark, tmp_path):
    rnd = random.Random(6)
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=4, files=2, block_docs=16, merge_after=3)
    held = {}
    for ids in (range(0, 400), range(300, 500), [7, 8, 450, None], [], range(0, 30)):
        rows = [r for r in corpus(rnd, ids) if r[0] is not None] + ([(900, None)] if 7 in ids else [])
        index.add(frame(spark, rows))
        held |= dict(rows)
        docs = frame(spark, list(held.items()))
        for query in QUERIES[:3] if len(ids) != 30 else QUERIES:
            assert shown(index.topk(query, 10)) == shown(retrieval.bm25(docs, query, 10)), query
    assert index._segments()[0].startswith("m")
    even = docs.where("id % 2 = 0").select("id")
    want = retrieval.top(retrieval.bm25_scores(docs, "w0 w250").join(even, "id", "left_semi"), 12)
    assert shown(index.topk("w0 w250", 12, within=even)) == shown(want)


def test_removed_documents_neither_count_nor_come(spark, tmp_path):
    rnd = random.Random(9)
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=2, files=1, block_docs=16)
    ids = lambda *found: spark.createDataFrame([(i,) for i in found], "id long")
    assert index.remove(ids(1))._segments() == []
    held = dict(corpus(rnd, range(200)))
    index.add(frame(spark, list(held.items())))

    def check():
        docs = frame(spark, list(held.items()))
        for query in ("w0 w250 w299", "w3 w4"):
            assert shown(index.topk(query, 10)) == shown(retrieval.bm25(docs, query, 10)), query

    index.remove(ids(*range(0, 200, 3), 999, 999, None))
    held = {i: t for i, t in held.items() if i % 3}
    check()
    index.remove(ids(*range(0, 50)))  # some are gone already
    held = {i: t for i, t in held.items() if i >= 50}
    back = dict(corpus(rnd, range(0, 20)))
    index.add(frame(spark, list(back.items())))
    held |= back
    check()
    index.merge()
    check()
    assert len(index._segments()) == 1
    index.remove(ids(*held))
    assert index.topk("w0", 5).count() == 0
    index.merge()
    assert index.topk("w0", 5).count() == 0
    held = dict(corpus(rnd, range(5)))
    index.add(frame(spark, list(held.items())))
    check()


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(["common"] * rnd.randrange(1, 3) + ["other"] * rnd.choice([2, 30, 200, 900]))) for i in range(3000)] + [(5000 + i, "rare common common") for i in range(12)]
    docs = frame(spark, rows)
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=2, files=2, block_docs=32).add(docs)
    assert shown(index.topk("common rare", 5)) == shown(retrieval.bm25(docs, "common rare", 5))
    assert 0 < index.read < index.held / 4


def test_an_empty_index_and_one_that_fails(spark, tmp_path):
    index = PostingIndex(spark, f"file://{tmp_path}/i")
    assert index.topk("any", 3).collect() == [] and index.add(frame(spark, [])).topk("any", 3).collect() == []
    assert index.add(frame(spark, [(1, ""), (2, None)])).topk("any", 3).collect() == [] and index.topk("", 3).collect() == []

    class Broken:
        def topk(self, *_, **__):
            raise OSError("gone")

    docs = spark.createDataFrame([("a", "move it"), ("b", "none")], "id string, content string")
    assert [r["id"] for r in retrieval.sparse(docs, "move", 5, index=Broken()).collect()] == ["a"]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/c"

    def write(k):
        rows = [(f"{k}-{i}", "a", f"{k}", 1) for i in range(5)] + [("shared", "a", f"{k}", 1)]
        return points.upsert(spark, path, spark.createDataFrame(rows, "id string, codebase string, content string, part int"), compact_after=4)

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(write, range(12))) == [6] * 12
    got = {r["id"]: r["content"] for r in points.read_points(spark, path).collect()}
    assert len(got) == 61 and all(got[f"{k}-{i}"] == str(k) for k in range(12) for i in range(5))
    points.compact(spark, path)
    assert points.read_points(spark, path).count() == 61

    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=2, files=1, merge_after=99)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: index.add(frame(spark, [(k, f"word{k} both")])), range(3)))
    assert sorted(r["id"] for r in index.topk("both", 9).collect()) == [0, 1, 2]


def test_a_late_writer_isn_t_lost_to_a_base(spark, tmp_path, monkeypatch):
    """A base passes over a claim whose writer seemed to have broken off; when its table comes after all, it gets another number."""
    path, kind = f"file://{tmp_path}/c", "id string, codebase string, content string, part int"
    put = lambda i, text: points.upsert(spark, path, spark.createDataFrame([(i, "a", text, 1)], kind), compact_after=99)
    put("1", "first")
    taken = points.move

    def slow(session, source, target):
        monkeypatch.setattr(points, "move", taken)
        monkeypatch.setattr(points, "ABANDONED_MS", -1000)
        put("2", "meanwhile")
        points.compact(spark, path)
        taken(session, source, target)

    monkeypatch.setattr(points, "move", slow)
    put("3", "late")
    assert sorted((r["id"], r["content"]) for r in points.read_points(spark, path).collect()) == [("1", "first"), ("2", "meanwhile"), ("3", "late")]


def test_filters_prune_what_a_collection_reads(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = [(f"{c}{i}", c, f"{c}/{i % 50:02}.cob", "x", 1) for c in ("blas", "lapack", "gnucobol") for i in range(300)]
    points.upsert(spark, path, spark.createDataFrame(rows, "id string, codebase string, file_path string, content string, part int"))
    from strataseek.plans.search import within

    found = within(points.read_points(spark, path), "blas").where(F.col("file_path") == "blas/07.cob")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(codebase" in plan and "EqualTo(file_path,blas/07.cob)" in plan
    assert found.count() == 6 and {p.split("codebase=")[1].split("/")[0] for p in (r[0] for r in found.select(F.input_file_name()).distinct().collect())} == {"blas"}


@pytest.mark.parametrize("bad", [[1.0] * 3, None])
def test_points_of_another_width_are_refused(spark, bad):
    kind = "codebase string, path string, line_start int, line_end int, content string, name string, division string, chunk_type string, language string, dependencies array<string>, embedding array<float>"
    rows = spark.createDataFrame([("a", "p", 1, 2, "t", "N", "D", "c", "cobol", ["x"], bad)], kind)
    with pytest.raises(Exception, match="2 dimensions"):
        points.to_points(rows, 2).select("vector").collect()
