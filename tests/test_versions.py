"""A stream that keeps a collection as its tree is: versions of files, chunks that go, failures in the middle."""

import os

import pytest

from strataseek.operators import points
from strataseek.operators.postings import PostingIndex
from strataseek.providers import HashEmbedder
from strataseek.streaming.ingest import stream_versions

PARAGRAPH = "       {0}.\n" + "           MOVE {0} TO X.\n" * 40


def program(*names):
    return "       PROCEDURE DIVISION.\n" + "".join(PARAGRAPH.format(n) for n in names)


def noting(log, broken=None):
    """An embedder that notes the texts it gets, and fails while a file is there."""

    class Noting(HashEmbedder):
        def embed(self, texts, kind="document"):
            if self.broken and os.path.exists(self.broken):
                raise ValueError("no vectors today")
            with open(self.log, "a") as f:
                f.write("x" * len(texts))
            return super().embed(texts, kind)

    own = Noting(8)
    own.log, own.broken = str(log), str(broken) if broken else None
    return own


@pytest.fixture
def tree(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    clock = iter(range(1_000, 100_000, 10))

    class Tree:
        collection = f"file://{tmp_path}/col"
        log = tmp_path / "log"

        def put(self, name, text):
            (root / name).write_text(text)
            at = next(clock)
            os.utime(root / name, (at, at))

        def run(self, own, **more):
            self.log.write_text("")
            stream_versions(spark, str(root), self.collection, f"file://{tmp_path}/ck", own, **more).awaitTermination(200)
            return len(self.log.read_text())

        def held(self):
            rows = points.read_points(spark, self.collection).collect()
            assert len({r["id"] for r in rows}) == len(rows) and all(len(r["vector"]) == 8 for r in rows)
            return sorted((os.path.basename(r["file_path"]), r["name"]) for r in rows)

    return Tree()


def test_unchanged_changed_shrunk_and_emptied_files(spark, tree):
    own = noting(tree.log)
    tree.put("same.cob", program("A-1", "A-2"))
    tree.put("other.cob", program("B-1", "B-2"))
    tree.put("less.cob", program("C-1", "C-2", "C-3"))
    tree.put("none.cob", program("D-1"))
    tree.put("blank.cob", "\n  \n")
    assert tree.run(own) == 8
    first = tree.held()
    assert len(first) == 8 and ("less.cob", "C-3") in first
    assert tree.run(own) == 0 and tree.held() == first
    tree.put("same.cob", program("A-1", "A-2"))  # touched
    tree.put("other.cob", program("B-1", "B-9"))
    tree.put("less.cob", program("C-1"))
    tree.put("none.cob", "")
    tree.put("new.cob", program("E-1"))
    assert tree.run(own) == 4
    want = [("less.cob", "C-1"), ("new.cob", "E-1"), ("other.cob", "B-1"), ("other.cob", "B-9"), ("same.cob", "A-1"), ("same.cob", "A-2")]
    assert tree.held() == want
    tree.put("none.cob", program("D-5"))
    assert tree.run(own) == 1 and tree.held() == sorted([*want, ("none.cob", "D-5")])
    points.compact(spark, tree.collection)
    assert tree.held() == sorted([*want, ("none.cob", "D-5")])


def test_a_batch_that_fails_is_run_again(spark, tree, tmp_path):
    own = noting(tree.log, tmp_path / "broken")
    tree.put("a.cob", program("A-1", "A-2"))
    assert tree.run(own) == 2
    tree.put("a.cob", program("A-1"))
    (tmp_path / "broken").write_text("")
    with pytest.raises(Exception, match="no vectors today"):
        tree.run(own)
    assert tree.held() == [("a.cob", "A-1"), ("a.cob", "A-2")]
    (tmp_path / "broken").unlink()
    assert tree.run(own) == 1 and tree.held() == [("a.cob", "A-1")]


def test_kept_chunks_are_not_embedded_again(spark, tree, tmp_path):
    own, store = noting(tree.log), f"file://{tmp_path}/vectors"
    tree.put("a.cob", program("A-1", "A-2"))
    assert tree.run(own, store=store) == 2
    tree.put("a.cob", program("A-1", "A-2", "A-3"))
    assert tree.run(own, store=store) == 1 and [n for _, n in tree.held()] == ["A-1", "A-2", "A-3"]


def test_an_index_goes_along(spark, tree, tmp_path):
    own, index = noting(tree.log), PostingIndex(spark, f"file://{tmp_path}/index", buckets=2, files=1)
    names = lambda word: {r["name"] for r in points.read_points(spark, tree.collection).join(index.topk(word, 9), "id").collect()}
    tree.put("a.cob", program("ALPHA", "BETA"))
    tree.put("b.cob", program("GAMMA"))
    tree.run(own, index=index)
    assert names("move") == {"ALPHA", "BETA", "GAMMA"} and names("beta") == {"BETA"}
    tree.put("a.cob", program("DELTA"))
    tree.run(own, index=index)
    assert names("move") == {"DELTA", "GAMMA"} and index.topk("beta", 9).count() == 0 and index.topk("move", 9).count() == 2


def test_points_are_removed(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    held = lambda: sorted(r["id"] for r in points.read_points(spark, path).collect())
    points.upsert(spark, path, spark.createDataFrame([("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z")], "id string, codebase string, content string"))
    assert points.remove(spark, path, spark.createDataFrame([("2", "a"), ("9", "a")], "id string, codebase string")) == 2
    assert held() == ["1", "3"] and "deleted" not in points.read_points(spark, path).columns
    points.upsert(spark, path, spark.createDataFrame([("2", "a", "again")], "id string, codebase string, content string"))
    assert held() == ["1", "2", "3"]
    points.remove(spark, path, points.read_points(spark, path))
    assert held() == []
    points.compact(spark, path)
    assert held() == []
    points.upsert(spark, path, spark.createDataFrame([("4", "a", "x")], "id string, codebase string, content string"), compact_after=1)
    assert held() == ["4"] and set(points.read_points(spark, path).columns) == {"id", "codebase", "content"}
