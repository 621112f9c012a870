"""Prompts, providers, evaluation runs, form signals."""

import pytest
from pyspark.sql import functions as F

from strataseek import providers as P
from strataseek.errors import ProviderError, ValidationError
from strataseek.operators import answers, evaluation, preprocess, prompts, rerank


def test_prompts():
    own = prompts.system_prompt("impact_analysis")
    assert "file:line" in own and all(x in own for x in ("HIGH", "MEDIUM", "LOW", "impact_analysis", "WORKING-STORAGE"))
    assert prompts.system_prompt(" ") == prompts.system_prompt("code_explanation")
    assert "Default feature behavior" in prompts.system_prompt("Unknown") and prompts.system_prompt("Unknown") == prompts.system_prompt("unknown")
    assert len({prompts.system_prompt(f) for f in prompts.TASKS}) == 8
    with pytest.raises(ValidationError, match="unsupported language"):
        prompts.system_prompt(language="rust")
    with pytest.raises(ValidationError):
        prompts.user_prompt(" ", "x")


def test_context(spark):
    kind = "c array<struct<file_path:string,line_start:int,line_end:int,name:string,division:string,content:string,metadata:map<string,string>>>"
    rows = [("a.cob", 10, 4, " ", "", "X.", {"paragraph_name": "MAIN", "division": "DATA"}), ("", -1, 0, "", None, "", None)]
    (text,) = spark.createDataFrame([(rows,)], kind).select(answers.context_block(F.col("c"))).first()
    assert text == "[Chunk 1]\nSource: a.cob:10-10\nName: MAIN\nDivision: DATA\nContent:\nX.\n\n[Chunk 2]\nSource: unknown-file:0-0\nName: (unknown)\nContent:\n(empty chunk content)"
    (none,) = spark.createDataFrame([([],)], kind).select(answers.context_block(F.col("c"))).first()
    assert none.startswith("No retrieved context was provided.") and "insufficient evidence" in none


def test_response_contents(spark):
    said = [
        '{"choices": [{"message": {"content": "  [x] text "}, "delta": {"content": " d"}}]}', '{"choices": [{"message": {"content": ["a", {"text": "b"}, {"no": 1}, {"text": 5}, 7]}}]}',
        '{"choices": []}', '{"choices": [{"message": {"content": null}}]}', "not json", None,
    ]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", answers.message_content(F.col("s")).alias("m"), answers.stream_delta(F.col("s")).alias("d")).orderBy("i").collect()
    assert [r.m for r in rows] == ["[x] text", "ab", None, None, None, None]
    assert [r.d for r in rows] == [" d", "", "", "", "", ""]


class RateLimitError(Exception):
    pass


def test_errors_that_may_pass():
    passing = (TimeoutError(), RateLimitError(), ConnectionError("x"), ValueError("request timeout"), ValueError("Rate limit reached"))
    assert all(map(P.is_retryable, passing)) and not any(map(P.is_retryable, (ValueError("bad"), KeyError("generate"))))


class Scripted:
    def __init__(self, **by_model):
        self.by_model, self.asked = by_model, []

    def stream(self, messages, model):
        self.asked.append(model)
        for x in self.by_model[model]:
            if isinstance(x, Exception):
                raise x
            yield x


@pytest.mark.parametrize(
    ("script", "text", "used", "asked"),
    [
        ({"a": ["x", "", "y"], "b": []}, "xy", ["a"], ["a"]), ({"a": [TimeoutError()], "b": ["z"]}, "z", ["b"], ["a", "b"]), ({"a": [ValueError("bad")], "b": ["z"]}, None, [], ["a"]),
        ({"a": ["x", TimeoutError()], "b": ["z"]}, None, ["a"], ["a"]), ({"a": [TimeoutError()], "b": [TimeoutError()]}, None, [], ["a", "b"]),
    ],
)
def test_fallback(script, text, used, asked):
    generator, names = Scripted(**script), []
    if text is None:
        with pytest.raises(ProviderError):
            list(P.complete(generator, [], ["a", " ", "a", "b"], names))
    else:
        assert "".join(P.complete(generator, [], ["a", None, "b"], names)) == text
    assert (names, generator.asked) == (used, asked)


def test_rate_limits(monkeypatch):
    slept, calls = [], []
    monkeypatch.setattr(P.time, "sleep", slept.append)

    class Limited(P.HashEmbedder):
        def embed(self, texts, kind="document"):
            calls.append(len(texts))
            if len(calls) in (1, 2):
                raise RuntimeError("429 too many requests")
            return super().embed(texts, kind)

    assert len(P.embed_limited(Limited(4), ["a"] * 45)) == 45
    assert calls == [20, 20, 20, 20, 5] and slept == [25.0, 50.0, 25.0, 25.0]

    class Broken(P.HashEmbedder):
        def embed(self, texts, kind="document"):
            raise RuntimeError("no such key")

    slept.clear()
    with pytest.raises(ProviderError):
        P.embed_limited(Broken(4), ["a"])
    assert slept == []


def test_cross_encoder_answers():
    assert rerank.provider_rows(["a", "b", "c"], [0.5, True, 1]) == [("a", 0.5), ("c", 1.0)]
    assert rerank.provider_rows(["a", "b"], [(1, 0.25), (2, 0.5), (-1, 0.5), (True, 1.0), (0, "x")]) == [("b", 0.25)]


def test_smoke_run(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"codebase": "blas", "queries": [' + ",".join(f'{{"id": {i}, "feature": "code_explanation", "query": "q{i}"}}' for i in range(10)) + "]}")

    class Client:
        def query(self, request):
            if request.query == "q3":
                raise ProviderError("timeout")
            return {"answer": "" if request.query == "q4" else f"{request.codebase} a.f:1"}

    queries = evaluation.load_smoke_queries(spark, str(tmp_path / "q.json"))
    results = evaluation.run_smoke(Client(), queries)
    assert {r.id: (r.status, r.passed, r.has_citations) for r in results.where("id in (2, 3, 4)").collect()} == {2: (200, True, True), 3: (0, False, False), 4: (200, False, False)}
    assert tuple(evaluation.smoke_verdict(results).first()) == (8, 10, True)


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"queries": [{"id": 1, "query": "x", "codebase": "blas", "expected_files": ["a.f"], "expected_names": []}]}')
    (r,) = evaluation.load_ground_truth(spark, str(tmp_path / "g.json")).collect()
    assert (r.id, r.expected_files) == (1, ["a.f"])


def test_form_signals(spark):
    free = "x = 1 ! note\ny = x + &\n  2\n" + "z" * 80
    fixed = "C note\n     & more\n      X = 1\n"
    rows = spark.createDataFrame([("free", fixed), ("fixed", fixed + free), ("fixed", fixed), ("free", free), ("free", None)], "form string, t string")
    s = preprocess.form_signals(F.col("t"))
    got = [(r.s.fixed, r.s.free, r.o) for r in rows.select(s.alias("s"), preprocess.looks_otherwise(F.col("form"), s).alias("o")).collect()]
    assert got == [(2, 0, False), (2, 3, True), (2, 0, False), (0, 3, False), (0, 0, False)]
