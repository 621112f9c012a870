"""Preprocessing, segmentation, sizes and dependencies on small sources."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataseek.functions import text as T
from strataseek.operators import dependencies, preprocess, sizing
from strataseek.operators.chunking import chunk
from strataseek.sources import files


def source(spark, *rows):
    return files.with_route(spark.createDataFrame(list(rows), "path string, text string"))


def processed(spark, path, text):
    return preprocess.preprocess(source(spark, (path, text))).collect()[0]


def pad(line):
    return f"{line:<72}PROG0001"


def test_routes(spark):
    rows = [(p,) for p in ("a/x.CBL", "a/x.f", "x.F90", "x.txt", "x", "d/.cob", "a.b/c")]
    got = {r.path: (r.language, r.codebase) for r in files.with_route(spark.createDataFrame(rows, "path string")).collect()}
    assert got == {
        "a/x.CBL": ("cobol", "gnucobol"), "a/x.f": ("fortran", "gfortran"), "x.F90": ("fortran", "gfortran"),
        "x.txt": (None, None), "x": (None, None), "d/.cob": (None, None), "a.b/c": (None, None),
    }


def test_cobol_lines(spark):
    text = "\n".join([pad("000100 IDENTIFICATION DIVISION."), pad("000200* a note"), pad('000300     MOVE "ABC'), pad('000400-    "DEF" TO X.'), pad("000500 MOVE 1 TO Y. *> set it"), "AB"])
    r = processed(spark, "p.cob", text)
    assert r.code.split("\n")[0].rstrip() == "IDENTIFICATION DIVISION."
    assert '    MOVE "ABC"DEF" TO X.' in r.code
    assert r.code.endswith("MOVE 1 TO Y.\nAB")
    assert r.comments == ["a note", "set it"]
    assert r.found == "IDENTIFICATION"


def test_cobol_orphan_continuation_is_dropped(spark):
    assert processed(spark, "p.cob", "000100-    LOST\n000200 KEPT").code == "KEPT"


def test_fortran_fixed(spark):
    r = processed(spark, "p.f", "C a\n* b\n      X = 1\n      CALL F(\n     &   A,\n     &   B)\n")
    assert r.code == "X = 1\nCALL F(   A,   B)"
    assert r.comments == ["a", "b"]
    assert r.source_format == "fixed"


def test_fortran_free_continuation_over_a_comment(spark):
    r = processed(spark, "p.f90", "program p\nx = a + &\n! in between\n  b ! tail\nend program")
    assert r.code == "program p\nx = a +   b\nend program"
    assert r.comments == ["in between", "tail"]
    assert r.found == "PROGRAM"


def test_cobol_chunks(spark):
    code = "IDENTIFICATION DIVISION.\nPROGRAM-ID. X.\nPROCEDURE DIVISION.\nMAIN-LOGIC.\n    PERFORM A-1 THRU A-2.\n    CALL 'RATE'.\nINIT.\n    COPY BOOK."
    df = spark.createDataFrame([("x.cob", "blas", "cobol", code)], "path string, codebase string, language string, code string")
    (r,) = chunk(df).collect()
    assert (r.name, r.line_start, r.line_end, r.division) == ("MAIN-LOGIC+INIT", 4, 8, "PROCEDURE")
    assert r.dependencies == ["A-1 THRU A-2", "RATE", "BOOK"]


@pytest.mark.parametrize(("code", "want"), [("JUST TEXT.", ("FILE-BLOCK", 1, 1, "UNKNOWN")), ("DATA DIVISION.\nPROCEDURE DIVISION.\n  STOP RUN.", ("PROCEDURE-BLOCK", 2, 3, "PROCEDURE"))])
def test_cobol_fallbacks(spark, code, want):
    df = spark.createDataFrame([("x.cob", "b", "cobol", code)], "path string, codebase string, language string, code string")
    (r,) = chunk(df).collect()
    assert (r.name, r.line_start, r.line_end, r.division) == want


def test_fortran_units_and_gaps(spark):
    word = "a " * 70
    code = f"! {word}\nSUBROUTINE A\n{word}\nCALL B\nEND\n\nREAL FUNCTION C(X)\n{word}\nEND FUNCTION C\n{word}"
    df = spark.createDataFrame([("x.f90", "b", "fortran", code)], "path string, codebase string, language string, code string")
    got = [(r.name, r.line_start, r.line_end, r.chunk_type) for r in chunk(df).orderBy("line_start").collect()]
    assert got == [("FILE-BLOCK", 1, 1, "file_block"), ("A", 2, 5, "subroutine"), ("C", 7, 9, "function"), ("FILE-BLOCK", 10, 10, "file_block")]


def test_split_names_and_lines():
    parts = sizing.split_text("\n".join(["w " * 100] * 10), 1, 10, "BIG", 256)
    assert [(p[1], p[2], p[3], p[4]) for p in parts] == [(1, 2, "BIG#1", 200), (3, 4, "BIG#2", 200), (5, 6, "BIG#3", 200), (7, 8, "BIG#4", 200), (9, 10, "BIG#5", 200)]
    assert [p[4] for p in sizing.split_text("w " * 600, 3, 3, "L", 256)] == [256, 256, 88]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30), st.integers(5, 40))
def test_split_keeps_all_words(sizes, most):
    text = "\n".join(" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate(sizes))
    parts = sizing.split_text(text, 1, max(1, len(sizes)), "N", most)
    assert " ".join(p[0] for p in parts).split() == text.split()


def test_dependencies(spark):
    row = spark.createDataFrame([("PERFORM. CALL . COPY. perform init-data CALL 'INIT-DATA'",)], "t string").select(dependencies.cobol_dependencies(F.col("t"))).first()[0]
    assert row == ["INIT-DATA"]
    row = spark.createDataFrame([("USE blas\nINCLUDE 'Some/file.h'\ncall XERBLA(1)\nCall xerbla",)], "t string").select(dependencies.fortran_dependencies(F.col("t"))).first()[0]
    assert row == ["BLAS", "Some/file.h", "XERBLA"]


def test_dressed_lines_are_whole(spark, tmp_path):
    from strataseek.queries import dressed

    lines = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(8)]
    lines[1], lines[2] = "y" * 200, "  short " + "z" * 130 + " tail" + " " * 70 + "end"
    rows = [(i, "s", "\n".join(lines)) for i in (0, 1, 2)]  # .cob, .F90, .f
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path.split(".")[-1]: r for r in preprocess.preprocess(dressed(spark, str(tmp_path))).collect()}
    assert set(got) == {"cob", "F90", "f"}
    bare = lambda t: "".join(t.split()).replace("&", "")
    for kind, head in (("cob", "P-7."), ("f", "SUBROUTINES7"), ("F90", "SUBROUTINES7")):
        whole = ["PROCEDUREDIVISION.", *(bare(x) for i, x in enumerate(lines) if i != 3)]
        whole.insert(6, head)
        assert bare(got[kind].code) == "".join(whole)
        assert bare(" ".join(got[kind].comments)) == bare(lines[3])


def plain_chunks(code, language):
    """(line_start, line_end, name, chunk_type, content) of a file, step by step."""
    import re

    lines = code.split("\n")
    if not code.strip():
        return []
    blocks = []
    if language == "cobol":
        opens = next((i for i, x in enumerate(lines) if x.strip().upper() == "PROCEDURE DIVISION."), None)
        heads = [i for i, x in enumerate(lines) if opens is not None and i > opens and re.match(r"\S", x) and x.strip().endswith(".") and re.fullmatch(r"[A-Z0-9-]+", x.strip()[:-1].strip().upper())]
        for i, h in enumerate(heads):
            blocks.append((h + 1, heads[i + 1] if i + 1 < len(heads) else len(lines), lines[h].strip()[:-1].strip().upper(), "paragraph", "PROCEDURE"))
        if not heads:
            blocks.append(((opens or 0) + 1, len(lines), "FILE-BLOCK" if opens is None else "PROCEDURE-BLOCK", "paragraph", "UNKNOWN" if opens is None else "PROCEDURE"))
    else:
        at, free = 0, 0
        while at < len(lines):
            m = re.match(r"(?i)\s*(SUBROUTINE)\s+([A-Z_]\w*)", lines[at])
            if not m:
                at += 1
                continue
            end = at + 1
            while end < len(lines) and not re.match(r"(?i)\s*SUBROUTINE\s+[A-Z_]", lines[end]) and not re.fullmatch(r"(?i)\s*END\s*", lines[end]):
                end += 1
            last = end + 1 if end < len(lines) and re.fullmatch(r"(?i)\s*END\s*", lines[end]) else end
            if at > free:
                blocks.append((free + 1, at, "FILE-BLOCK", "file_block", "UNKNOWN"))
            blocks.append((at + 1, last, m[2].upper(), "subroutine", "SUBROUTINE"))
            at = free = last
        if free < len(lines):
            blocks.append((free + 1, len(lines), "FILE-BLOCK", "file_block", "UNKNOWN"))
    mixed = "UNKNOWN" if language == "cobol" else "MIXED"
    chunks = [[a, b, n, t, v, "\n".join(lines[a - 1 : b])] for a, b, n, t, v in sorted(blocks)]
    chunks = [c for c in chunks if c[2] != "FILE-BLOCK" or c[5].strip()]

    def join(x, y):
        names = list(dict.fromkeys(p.strip() for p in f"{x[2]}+{y[2]}".split("+") if p.strip()))
        return [min(x[0], y[0]), max(x[1], y[1]), "+".join(names), x[3], x[4] if x[4] == y[4] else mixed, f"{x[5]}\n{y[5]}".strip()]

    done, held = [], None
    for c in chunks:
        if held is None:
            held = c
        elif len(held[5].split()) < 64:
            held = join(held, c)
        else:
            done.append(held)
            held = c
    if held is not None:
        if done and len(held[5].split()) < 64:
            done[-1] = join(done[-1], held)
        else:
            done.append(held)
    return [(first, last, name, c[3], content) for c in done for content, first, last, name, _ in sizing.split_text(c[5], c[0], c[1], c[2], 768)]


def test_chunks_are_those_of_a_plain_version(spark):
    import random

    rnd = random.Random(8)
    words = ["move", "A-1", "to", "x.", "", "END", "compute", "y = 2"]
    rows = []
    for i in range(60):
        language = ("cobol", "fortran")[i % 2]
        out = ["PROCEDURE DIVISION."] if language == "cobol" and i % 6 else []
        for k in range(rnd.randrange(0, 120)):
            head = f"P-{k}." if language == "cobol" else f"  subroutine s{k}(a)"
            out.append(head if rnd.random() < 0.12 else " " * rnd.randrange(0, 4) + " ".join(rnd.choices(words, k=rnd.randrange(0, 40))) + " " * rnd.randrange(0, 3))
        rows.append((f"f{i:02}", "b", language, "\n".join(out)))
    got = {}
    for r in chunk(spark.createDataFrame(rows, "path string, codebase string, language string, code string").repartition(3)).collect():
        got.setdefault(r.path, []).append((r.line_start, r.line_end, r.name, r.chunk_type, r.content))
    for path, _, language, code in rows:
        assert sorted(got.get(path, [])) == sorted(plain_chunks(code, language)), path


def test_uuid5(spark):
    import uuid

    name = "gnucobol:data/raw/x.cob:10"
    ns = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
    assert spark.range(1).select(T.uuid5(ns, F.lit(name))).first()[0] == str(uuid.uuid5(uuid.UUID(ns), name))
