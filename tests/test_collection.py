"""Collections, ingest, indexes and the vector channel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataseek.errors import ConfigError
from strataseek.operators import points, retrieval
from strataseek.plans.ingest import file_counts, ingest
from strataseek.providers import HashEmbedder
from strataseek.sources import files

KIND = "id string, codebase string, content string, part int"


def held(spark, path):
    return sorted((r.id, r.content) for r in points.read_points(spark, path).collect())


def test_upserts_are_put_together(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert points.read_points(spark, path) is None
    want = {}
    for i in range(10):
        rows = [(str(k), "ab"[k % 2], f"{i}-{k}", 1) for k in range(i, i + 3)]
        want |= {r[0]: r[2] for r in rows}
        assert points.upsert(spark, path, spark.createDataFrame(rows, KIND), compact_after=4) == 3
        assert held(spark, path) == sorted(want.items())
    names = {p.name for p in (tmp_path / "c").iterdir()}
    assert "b8" in names and "d3" not in names and "d1" not in names
    assert points.upsert(spark, path, spark.createDataFrame([], KIND)) == 0 and held(spark, path) == sorted(want.items())


def test_an_upsert_that_broke_off_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    points.upsert(spark, path, spark.createDataFrame([("1", "a", "x", 1)], KIND))
    points.upsert(spark, path, spark.createDataFrame([("1", "a", "y", 1)], KIND))
    (tmp_path / "c" / "d2" / "_SUCCESS").unlink()
    assert held(spark, path) == [("1", "x")]


def test_collections_are_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    points.create_collection(spark, path, 8)
    points.create_collection(spark, path, 8)
    with pytest.raises(ConfigError):
        points.create_collection(spark, path, 16)


def test_each_chunk_is_embedded_once(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for i in range(5):
        (root / f"p{i}.cob").write_text(f"       PROCEDURE DIVISION.\n       MAIN-{i}.\n           PERFORM X.\n")
    (root / "empty.cob").write_text("\n")
    (root / "binary.cob").write_bytes(b"\x00\x01" * 50)
    calls = tmp_path / "calls"

    class Counting(HashEmbedder):
        """Notes each text in a file, as it runs in other processes."""

        def embed(self, texts, kind="document"):
            with open(calls, "a") as f:
                f.write("x" * len(texts))
            return super().embed(texts, kind)

    for times in (1, 2):
        n = ingest(spark, str(root), f"file://{tmp_path}/col", embedder=Counting(8))
        assert n == {"files_found": 7, "files_processed": 5, "skipped_empty": 2, "errors": 0, "chunks_created": 5, "chunks_embedded": 5, "chunks_indexed": 5}
        assert len(calls.read_text()) == 5 * times
    assert points.read_points(spark, f"file://{tmp_path}/col").count() == 5
    assert ingest(spark, str(root), f"file://{tmp_path}/col", estimate=True)["embedding_calls"] == 1
    assert len(calls.read_text()) == 10


def test_files_that_cannot_be_read_are_errors(spark, tmp_path):
    for name in ("a.cob", "b.cob"):
        (tmp_path / name).write_text("       PROCEDURE DIVISION.\n")
    found = files.scan(spark, str(tmp_path))
    n = found.select("path").count()
    (tmp_path / "b.cob").unlink()
    counts = file_counts(n, found.select(F.col("text").alias("code")))
    assert (counts["files_found"], counts["files_processed"], counts["errors"]) == (2, 1, 1)


def test_encodings(spark):
    rows = [
        (b"", "cobol", "utf-8"), (b"plain", "cobol", "utf-8"), ("é".encode(), "fortran", "utf-8"), ("caf\xe9 na\xefve".encode("latin-1"), "fortran", "iso-8859-1"),
        (b"a\x00b", "cobol", None), (b"+AGE-", "fortran", "utf-8"), (bytes(range(0x80, 0xA0)) + b"text", "fortran", None), (b"\x01\x02\x03ab", "cobol", None),
    ]
    df = spark.createDataFrame([(i, bytearray(c), lang) for i, (c, lang, _) in enumerate(rows)], "i int, c binary, l string")
    got = {r.i: (r.e, r.t) for r in df.select("i", files.encoding(F.col("c"), F.col("l")).alias("e"), files.decoded(F.col("c"), F.col("l")).alias("t")).collect()}
    assert [got[i][0] for i in range(len(rows))] == [want for *_, want in rows]
    assert got[3][1] == "café naïve" and got[4][1] == "" and got[6][1] == ""


def test_index_scores_are_those_of_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "MOVE a TO b. Move it"), (2, "PERFORM calc-interest"), (3, None), (4, ""), (5, "move MOVE Été été"), (6, "nothing here")], "id long, content string")
    index = retrieval.TextIndex(spark, f"file://{tmp_path}/i", buckets=3, files=2).write(docs, text_col="content")
    for text in ("move été", "interest", "absent", ""):
        want = {r.id: round(r.score, 9) for r in retrieval.bm25_scores(docs, text, text_col="content").collect()}
        assert {r.id: round(r.score, 9) for r in index.scores(text).collect()} == want
        assert {r.id for r in retrieval.sparse(docs.where("id < 5"), text, 10, index=index, filtered=True).collect()} == {i for i in want if i < 5}
    assert retrieval.sparse(docs.select("id"), "move", 5).collect() == []


@pytest.mark.parametrize("dim", [3, 1536])
def test_vectors(spark, dim):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(50, dim))
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0]), (102, v[3].tolist())]
    q = rnd.normal(size=dim)
    got = [(r.id, r.score) for r in retrieval.dense(spark.createDataFrame(rows, "id long, vector array<float>").repartition(3), q.tolist(), 5).collect()]
    score = {i: float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)) for i, x in [*enumerate(v), (102, v[3])] if x.any()}
    assert [i for i, _ in got] == sorted(score, key=lambda i: (-round(score[i], 5), i))[:5]
    assert all(abs(s - score[i]) < 1e-5 for i, s in got)
