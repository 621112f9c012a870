"""Fusion, rerank, upsert, ingest and answers end to end."""

import pytest
from pyspark.sql import functions as F

from strataseek.errors import ProviderError, ValidationError
from strataseek.operators import points, rerank, retrieval
from strataseek.plans.ingest import ingest
from strataseek.plans.search import Engine, SearchRequest
from strataseek.providers import HashEmbedder, complete, embed_batches


def hits(spark, **scores):
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "id string, score double")


def test_fusion(spark):
    got = [(r.id, round(r.fused, 6)) for r in retrieval.fuse(hits(spark, A=0.8, B=0.3), hits(spark, A=0.2, C=0.95), retrieval.channel_weights(True), 5).collect()]
    assert got == [("C", 0.6), ("A", 0.4), ("B", 0.0)]
    got = [(r.id, round(r.fused, 6)) for r in retrieval.fuse(hits(spark, X=0.4), hits(spark, Y=3), retrieval.channel_weights(False), 5).collect()]
    assert got == [("X", 0.7), ("Y", 0.3)]


@pytest.mark.parametrize(("query", "want"), [("CALCULATE-INTEREST", True), ("ABC", True), ("year 2024 totals", True), ("what does this paragraph do", False), ("What does ABC do?", False)])
def test_identifier(spark, query, want):
    assert spark.range(1).select(retrieval.is_identifier_query(F.lit(query))).first()[0] is want


def chunk_row(name, score, division="", deps=(), path="a.cob", line=1):
    return (name, name, score, division, path, line, line, list(deps), "gnucobol", "cobol")


KIND = "id string, name string, score double, division string, file_path string, line_start int, line_end int, dependencies array<string>, codebase string, language string"


@pytest.mark.parametrize(
    ("query", "rows", "first"),
    [
        ("what does main-logic do", [chunk_row("MAIN-LOGIC", 0.5), chunk_row("INIT-DATA", 0.58)], "MAIN-LOGIC"),
        ("trace procedure flow", [chunk_row("P", 0.4, "PROCEDURE"), chunk_row("D", 0.45, "DATA")], "P"),
        ("where is init-data used", [chunk_row("LOWER", 0.5, deps=["INIT-DATA"]), chunk_row("HIGHER", 0.53)], "LOWER"),
    ],
)
def test_boosts(spark, query, rows, first):
    assert rerank.rerank(spark.createDataFrame(rows, KIND), query.split()).first()["name"] == first


def test_rerank_ties_and_cross_encoder(spark):
    rows = spark.createDataFrame([chunk_row("B", 0.5, path="b"), chunk_row("A", 0.5, path="a")], KIND)
    got = rerank.rerank(rows, ["nothing"]).collect()
    assert [(r["name"], r["score"], r["confidence"]) for r in got] == [("A", 0.5, "MEDIUM"), ("B", 0.5, "MEDIUM")]
    rows = spark.createDataFrame([chunk_row("FIRST", 0.8), chunk_row("SECOND", 0.7)], KIND)
    scores = spark.createDataFrame([("FIRST", 0.1), ("SECOND", 0.95)], "id string, relevance double")
    assert rerank.rerank(rows, [], provider_scores=scores).first()["name"] == "SECOND"


def test_upsert_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = spark.createDataFrame([("1", "a", "x", 1), ("2", "a", "y", 1), ("1", "a", "z", 2)], "id string, codebase string, content string, part int")
    assert points.upsert(spark, path, rows) == 3
    for _ in range(2):
        assert sorted((r.id, r.content) for r in points.read_points(spark, path).collect()) == [("1", "z"), ("2", "y")]
        points.upsert(spark, path, rows)


def test_ingest_and_answer(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "a.cob").write_text("       PROCEDURE DIVISION.\n       MAIN-LOGIC.\n           PERFORM INIT-DATA.\n           DISPLAY 'HELLO'.\n")
    (root / "sub" / "b.f").write_text("      SUBROUTINE DGEMM(A)\n      CALL XERBLA\n      END\n")
    (root / "c.txt").write_text("no source")
    n = ingest(spark, str(root), f"file://{tmp_path}/col", embedder=HashEmbedder(64))
    assert (n["files_found"], n["chunks_indexed"], n["skipped_empty"]) == (2, 2, 0)
    engine = Engine(spark, points.read_points(spark, f"file://{tmp_path}/col"), embedder=HashEmbedder(64))
    got = engine.answer(SearchRequest("MAIN-LOGIC", top_k=5))
    assert got["chunks"][0]["name"] == "MAIN-LOGIC" and got["confidence"] == "MEDIUM" and "a.cob:2-4" in got["answer"]
    assert [r["codebase"] for r in engine.search(SearchRequest("dgemm", codebase="gfortran")).collect()] == ["gfortran"]


def test_requests_are_checked():
    for bad in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "feature": "none"}, {"query": "x", "language": "fortran"}):
        with pytest.raises(ValidationError):
            SearchRequest(**bad)
    assert SearchRequest("x", codebase=" ").codebase is None


def test_providers():
    sizes = []

    class Probe(HashEmbedder):
        def embed(self, texts, kind="document"):
            sizes.append(len(texts))
            return super().embed(texts, kind)

    assert len(embed_batches(Probe(8), ["a"] * 257)) == 257 and sizes == [128, 128, 1]
    with pytest.raises(ValueError):
        embed_batches(Probe(8), ["a"], size=0)

    class Broken:
        def stream(self, messages, model):
            if model == "late":
                yield "some"
            raise TimeoutError

    with pytest.raises(ProviderError):
        list(complete(Broken(), [], ["late", "next"]))


def test_stream_ingest(spark, tmp_path):
    from strataseek.streaming.ingest import stream_ingest

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.cob").write_text("       PROCEDURE DIVISION.\n       P-1.\n           STOP RUN.\n")
    for _ in range(2):
        stream_ingest(spark, str(root), f"file://{tmp_path}/col", f"{tmp_path}/ckpt", HashEmbedder(16)).awaitTermination(120)
    assert [r["name"] for r in points.read_points(spark, f"file://{tmp_path}/col").collect()] == ["P-1"]
