"""The automaton against looking for each pattern."""

import random

import pytest

from strataseek.operators import evaluation, patterns
from strataseek.operators.patterns import Automaton, holding


@pytest.mark.parametrize("seed", range(4))
def test_found_is_what_contains_finds(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abé") for _ in range(rnd.randrange(0, n)))
    some = sorted({word(7) for _ in range(60)})
    automaton = Automaton(some)
    for _ in range(200):
        text = word(30)
        assert automaton.found(text) == {i for i, p in enumerate(some) if p in text}


def test_ten_thousand_patterns(spark, monkeypatch):
    rnd = random.Random(9)
    part = lambda: rnd.choice(["src", "lib", "blas", "x", "été"]) + str(rnd.randrange(60))
    expected, results = [], []
    for q in range(1000):
        files = [f"{part()}/{part()}.f" if rnd.random() < 0.5 else part() for _ in range(rnd.randrange(0, 8))] + ([None] if q % 50 == 0 else [])
        names = [rnd.choice(["dgemm", "SGEMM", "", "straße", part()]) for _ in range(rnd.randrange(0, 4))] if q % 7 else None
        expected.append((q, f"c{q % 3}", files, names))
        results += [(q, r, f"{part()}/{part()}/{part()}.f" if r % 6 else None, rnd.choice(["DGEMM", "main-logic", None, "Straße", part()])) for r in range(1, rnd.randrange(1, 9))]
    want = spark.createDataFrame(expected, "id int, codebase string, expected_files array<string>, expected_names array<string>")
    got = spark.createDataFrame(results, "id int, rank int, file_path string, name string")
    plain = sorted(map(tuple, evaluation.hits(got, want).select("id", "codebase", "file_hit", "name_hit", "returned", "hit").collect()))
    assert sorted(map(tuple, evaluation.hits_of_many(got, want).select("id", "codebase", "file_hit", "name_hit", "returned", "hit").collect())) == plain
    assert {x[2] for x in plain} == {x[3] for x in plain} == {True, False}
    monkeypatch.setattr(patterns, "BLOCK_CHARS", 500)
    few = want.where("id < 100")
    assert sorted(map(tuple, evaluation.hits_of_many(got, few).select("id", "codebase", "file_hit", "name_hit", "returned", "hit").collect())) == [x for x in plain if x[0] < 100]


def test_holding_many(spark):
    rnd = random.Random(2)
    words = [f"w{i:05}" for i in range(10_000)]
    rows = [(i, " ".join(rnd.sample(words, 20)) if i % 10 else None) for i in range(300)]
    found = holding(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(w,) for w in words], "pattern string"), "text")
    assert sorted(map(tuple, found.collect())) == sorted((i, w) for i, t in rows if t for w in t.split())
    assert holding(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([], "pattern string"), "text").count() == 0
