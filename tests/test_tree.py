"""The source tree: rows for all files, pushed-down filters, streams, and the counters of an ingest."""

import os
import stat

import pytest

from strataseek.plans.ingest import ingest
from strataseek.providers import HashEmbedder
from strataseek.sources import tree

PROGRAM = "       PROCEDURE DIVISION.\n       MAIN-1.\n           STOP RUN.\n"


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "src"
    (base / "deep" / "er").mkdir(parents=True)
    (base / "a.cob").write_text(PROGRAM)
    (base / "deep" / "B.CBL").write_text(PROGRAM)
    (base / "deep" / "er" / "c.f90").write_text("subroutine s\nend\n")
    (base / "empty.f90").write_text("")
    (base / "blank.cob").write_text("\n  \n")
    os.mknod(base / "gone.cob", stat.S_IFSOCK | 0o644)  # no one can open a socket as a file
    for name in ("main.c", ".cob", "noext"):
        (base / name).write_text("int main() {}")
    return base


def rows(df):
    return {os.path.basename(r["path"]): r for r in df.collect()}


def test_every_supported_file_is_a_row(spark, root):
    tree.register(spark)
    got = rows(spark.read.format("source_tree").option("path", str(root)).option("partition_bytes", "70000").load())
    assert set(got) == {"a.cob", "B.CBL", "c.f90", "empty.f90", "blank.cob", "gone.cob"}
    assert got["a.cob"]["content"].decode() == PROGRAM and got["a.cob"]["error"] is None and got["a.cob"]["size"] == len(PROGRAM)
    assert got["empty.f90"]["error"] == tree.EMPTY and got["gone.cob"]["error"].startswith(tree.UNREADABLE) and got["gone.cob"]["content"] is None
    assert (got["B.CBL"]["extension"], got["B.CBL"]["language"], got["c.f90"]["codebase"]) == (".cbl", "cobol", "gfortran")


def test_filters_reach_the_listing(spark, root):
    reader = tree.TreeReader({"path": str(root)})
    rest = list(reader.pushFilters([tree.EqualTo(("language",), "fortran"), tree.In(("extension",), (".f90", ".f")), tree.IsNotNull(("language",)), tree.EqualTo(("size",), 3)]))
    assert [type(f) for f in rest] == [tree.EqualTo] and rest[0].attribute == ("size",)
    assert [os.path.basename(f.path) for p in reader.partitions() for f in p.files] == ["c.f90", "empty.f90"]
    tree.register(spark)
    df = spark.read.format("source_tree").option("path", str(root)).load().where("language = 'cobol' AND extension IN ('.cob', '.x')")
    assert set(rows(df)) == {"a.cob", "blank.cob", "gone.cob"}


def test_partitions_hold_about_as_many_bytes_as_asked(tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02}.cob").write_bytes(b"x" * 30_000)
    parts = tree.TreeReader({"path": str(tmp_path), "partition_bytes": "400000"}).partitions()
    assert sum(len(p.files) for p in parts) == 40 and all(len(p.files) <= 5 for p in parts) and len(parts) == 10
    assert [len(p.files) for p in tree.TreeReader({"path": str(tmp_path / "..")}).parts([])] == [0]


def test_counters_of_an_ingest(spark, root, tmp_path):
    n = ingest(spark, str(root), f"file://{tmp_path}/c", embedder=HashEmbedder(8))
    assert n == {"files_found": 6, "files_processed": 3, "skipped_empty": 2, "errors": 1, "chunks_created": 3, "chunks_embedded": 3, "chunks_indexed": 3}


def test_only_an_empty_file_and_no_file(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "empty.f90").write_text("")
    n = ingest(spark, str(tmp_path / "s"), f"file://{tmp_path}/c", codebase="gfortran", language="fortran", embedder=HashEmbedder(8))
    assert (n["files_found"], n["files_processed"], n["skipped_empty"], n["errors"], n["chunks_created"]) == (1, 0, 1, 0, 0)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "main.c").write_text("int main() {}")
    n = ingest(spark, str(tmp_path / "t"), f"file://{tmp_path}/d", language="fortran", embedder=HashEmbedder(8))
    assert (n["files_found"], n["errors"]) == (0, 0)


def test_files_of_one_instant_are_streamed_once(root):
    (root / "gone.cob").unlink()
    reader = tree.TreeStreamReader({"path": str(root)})
    names = lambda a, b: sorted(os.path.basename(f.path) for p in reader.partitions(a, b) for f in p.files)
    for f in root.rglob("*.*"):
        if f.is_file():
            os.utime(f, (1000, 1000))
    first = reader.latestOffset()
    seen = names(reader.initialOffset(), first)
    (root / "late.cob").write_text(PROGRAM)
    os.utime(root / "late.cob", (1000, 1000))
    second = reader.latestOffset()
    assert names(first, second) == ["late.cob"] and names(second, second) == [] and "a.cob" in seen
    (root / "a.cob").write_text(PROGRAM + " ")
    assert names(second, reader.latestOffset()) == ["a.cob"]


def test_stream(spark, root, tmp_path):
    tree.register(spark)
    stream = spark.readStream.format("source_tree").option("path", str(root)).load()
    query = stream.select("path", "error").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").start()
    try:
        query.processAllAvailable()
        (root / "new.cob").write_text(PROGRAM)
        query.processAllAvailable()
    finally:
        query.stop()
    got = [os.path.basename(r[0]) for r in spark.read.parquet(f"{tmp_path}/out").select("path").collect()]
    assert sorted(got) == sorted(["a.cob", "B.CBL", "c.f90", "empty.f90", "blank.cob", "gone.cob", "new.cob"])


def test_a_file_that_goes_away_after_the_listing(root):
    reader = tree.TreeReader({"path": str(root)})
    parts = reader.partitions()
    (root / "a.cob").unlink()
    got = {os.path.basename(r[0]): r[7] for p in parts for r in reader.read(p)}
    assert got["a.cob"].startswith(tree.UNREADABLE) and got["blank.cob"] is None
