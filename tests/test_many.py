"""A table of questions against the same questions one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataseek.operators import evaluation, many
from strataseek.plans.many import evaluate, search_many
from strataseek.plans.search import Engine, SearchRequest
from strataseek.providers import HashEmbedder, OverlapCrossEncoder

POINT = "id string, vector array<float>, content string, file_path string, line_start int, line_end int, name string, paragraph_name string, division string, language string, codebase string, dependencies array<string>"


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(1)
    words = ["move", "perform", "calc", "INTEREST", "rate", "table", "file", "dgemm", "call", "matrix", "été", "add-one"]
    embedder = HashEmbedder(32)
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25)))
        text = rows[-1][2] if rows and i % 10 == 3 else text
        vector = None if i == 7 else embedder.embed([text])[0]
        rows.append((f"p{i:03}", vector, text, f"src/f{i % 9}.cob", i, i + 3, f"N-{i % 5}", rnd.choice(["", "MAIN-LOGIC", None]), rnd.choice(["PROCEDURE", "DATA", ""]), "cobol", ["blas", "gnucobol"][i % 2], rnd.sample(words, 2)))
    return spark.createDataFrame(rows, POINT).repartition(5).cache()


QUESTIONS = [
    (1, "where is interest calculated", "code_explanation", None), (2, "DGEMM", "dependency_mapping", "blas"), (3, "perform table flow", "code_explanation", "gnucobol"), (4, "nothing known here", "code_explanation", None),
    (5, "été matrix", "impact_analysis", " "), (6, "   ", "code_explanation", None), (7, "move", "dependency_mapping", "absent"), (8, None, "code_explanation", None),
]


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "question int, query string, feature string, codebase string")


@pytest.mark.parametrize("encoder", [None, OverlapCrossEncoder()])
def test_many_questions_find_what_one_finds(spark, points, encoder):
    got = search_many(points, asked(spark), embedder=HashEmbedder(32), top_k=6, cross_encoder=encoder).orderBy("question", "rank").collect()
    engine = Engine(spark, points, embedder=HashEmbedder(32), cross_encoder=encoder)
    for q, query, feature, codebase in QUESTIONS:
        own = [(r["id"], round(r["score"], 5), r["confidence"]) for r in got if r["question"] == q]
        if not (query or "").strip():
            assert own == []
            continue
        want = [(r["id"], round(r["score"], 5), r["confidence"]) for r in engine.search(SearchRequest(query, feature, codebase, top_k=6)).collect()]
        assert own == want, q
    assert {r["rank"] for r in got if r["question"] == 1} == set(range(1, 7))


def test_a_cross_encoder_that_fails_for_a_question_leaves_its_order(spark, points):
    class Breaks(OverlapCrossEncoder):
        def scores(self, query, texts):
            if "interest" in query:
                raise TimeoutError
            return super().scores(query, texts)

    run = lambda e: {q: [r["id"] for r in rows] for q, rows in _by(search_many(points, asked(spark).where("question IN (1, 3)"), embedder=HashEmbedder(32), top_k=6, cross_encoder=e)).items()}
    plain, broken, sound = run(None), run(Breaks()), run(OverlapCrossEncoder())
    assert broken[1] == plain[1] and broken[3] == sound[3]


def _by(df):
    out = {}
    for r in df.orderBy("question", "rank").collect():
        out.setdefault(r["question"], []).append(r)
    return out


def test_blocks_of_questions(spark, points, monkeypatch):
    whole = (many.dense_many, many.bm25_many)
    ask = asked(spark).where("query IS NOT NULL").withColumn("vector", F.lit(HashEmbedder(32).embed(["move table"])[0]).cast("array<double>")).withColumnRenamed("codebase", "scope")
    wide = [sorted(map(tuple, f(points, ask, 7).collect())) for f in whole]
    monkeypatch.setattr(many, "QUESTIONS", 2)
    monkeypatch.setattr(many, "SCORES", 40)
    assert [sorted(map(tuple, f(points, ask, 7).collect())) for f in whole] == wide
    assert all(f(points.limit(0), ask, 7).count() == 0 and f(points, ask.limit(0), 7).count() == 0 for f in whole)


def test_equal_points_do_not_crowd_a_task(spark):
    rows = [(i, [1.0, 0.0], "same words") for i in range(3000)] + [(5000, [0.0, 1.0], "other"), (5001, None, None), (5002, [1.0], "short vector"), (5003, [0.0, 0.0], "")]
    docs = spark.createDataFrame(rows, "id long, vector array<double>, content string").repartition(2)
    ask = spark.createDataFrame([("a", "same", [1.0, 0.1]), ("b", "other", [0.0, 2.0]), ("c", "", [0.0, 0.0])], "question string, query string, vector array<double>")
    got = many.dense_many(docs, ask, 4, scope_col=None).collect()
    assert sorted((r["question"], r["id"]) for r in got if r["question"] == "a") == [("a", i) for i in range(4)]
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["question"] == "b"][:2] == [5000, 0] and not any(r["question"] == "c" for r in got)
    got = many.bm25_many(docs, ask, 4, scope_col=None).collect()
    assert sorted((r["question"], r["id"]) for r in got) == [*(("a", i) for i in range(4)), ("b", 5000)]


def test_best_keeps_what_a_full_sort_keeps():
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    best, every = many.Best(5, 3), []
    for part in range(40):
        scores = np.round(rnd.random((30, 5)), 2)
        scores[rnd.random((30, 5)) < 0.3] = np.nan
        ids = rnd.permutation(30) + 30 * part
        best.add(scores, pa.array(ids))
        best.cut()
        every.append((scores, ids))
    scores, ids = np.concatenate([s for s, _ in every]), np.concatenate([i for _, i in every])
    got = pa.Table.from_batches(list(best.rows(pa.array(range(5))))).to_pylist()
    for q in range(5):
        want = sorted((-s, i) for s, i in zip(scores[:, q], ids, strict=True) if not np.isnan(s))[:3]
        assert [(-r["score"], r["id"]) for r in got if r["question"] == q] == want


def test_evaluation_run(spark, points):
    truth = spark.createDataFrame([("t1", "dgemm call", "blas", ["f0.cob", "f2.cob"], ["none"]), ("t2", "move", "gnucobol", ["absent"], ["main-logic"]), ("t3", "words nobody has", "other", ["f1"], ["N-1"])], "id string, query string, codebase string, expected_files array<string>, expected_names array<string>")
    got = {r["id"]: r for r in evaluate(points, truth, embedder=HashEmbedder(32)).collect()}
    engine = Engine(spark, points, embedder=HashEmbedder(32))
    for r in truth.collect():
        found = engine.search(SearchRequest(r["query"], codebase=r["codebase"])).collect()[:5]
        file_hit = any(w in x["file_path"] for w in r["expected_files"] for x in found)
        name_hit = any(w.upper() in x["name"].upper() for w in r["expected_names"] for x in found)
        own = got[r["id"]]
        assert (own["file_hit"], own["name_hit"], own["hit"], own["returned"]) == (file_hit, name_hit, file_hit or name_hit, len(found))
    rates = {r["codebase"]: (r["hits"], r["total"]) for r in evaluation.hit_rates(evaluate(points, truth, embedder=HashEmbedder(32))).collect()}
    assert rates[None][1] == 3 and rates["other"] == (0, 1)


def test_dependencies_as_text(spark):
    from strataseek.operators import rerank

    rows = [("A", "A", 0.5, "", "a.cob", 1, 1, "INIT-DATA, OTHER ,", "x", "cobol"), ("B", "B", 0.52, "", "b.cob", 1, 1, None, "x", "cobol"), ("C", "C", 0.1, "", "c.cob", 1, 1, "", "x", "cobol")]
    df = spark.createDataFrame(rows, "id string, name string, score double, division string, file_path string, line_start int, line_end int, dependencies string, codebase string, language string")
    got = rerank.rerank(df, ["init-data"]).collect()
    assert [r["name"] for r in got] == ["A", "B", "C"] and got[0]["dependencies"] == ["INIT-DATA", "OTHER"] and got[1]["dependencies"] == []
