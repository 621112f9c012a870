"""The wire, without Spark: a stand-in engine behind the real server and client."""

import threading

import pytest

from strataseek import api, cli
from strataseek.errors import BackendError, ProviderError, ValidationError
from strataseek.plans.search import SearchRequest

CHUNK = {"content": "x", "file_path": "a.cob", "line_start": 1, "line_end": 2, "name": "P", "language": "cobol", "codebase": "blas", "score": 1.0, "confidence": "HIGH", "dependencies": ["A", "B"]}


class Fake:
    def answer(self, request):
        if request.query == "fail":
            raise ProviderError("no provider")
        return {"answer": f"about {request.query}", "chunks": [CHUNK], "query": request.query, "feature": request.feature, "confidence": "HIGH", "codebase_filter": request.codebase, "model": "m"}

    def stream(self, request):
        yield from ("one ", "two")


@pytest.fixture(scope="module")
def client():
    s = api.server(Fake(), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield api.Client(f"http://127.0.0.1:{s.server_address[1]}/")
    s.shutdown()


def test_query(client):
    got = client.query(SearchRequest("Q", codebase="blas"))
    assert got["answer"] == "about Q" and got["codebase_filter"] == "blas" and got["latency_ms"] >= 0
    assert got["chunks"][0]["metadata"]["dependencies"] == "A,B" and "content" not in got["chunks"][0]["metadata"]


def test_stream_and_errors(client):
    assert "".join(client.stream(SearchRequest("Q"))) == "one two"
    with pytest.raises(BackendError, match="no provider"):
        client.query(SearchRequest("fail"))
    with pytest.raises(ProviderError):
        api.Client("http://127.0.0.1:9", timeout=1).query(SearchRequest("Q"))


@pytest.mark.parametrize("bad", [{}, {"query": 1}, {"query": " "}, {"query": "x", "top_k": True}, {"query": "x", "top_k": 0}, {"query": "x", "feature": "f"}])
def test_bad_requests(bad):
    with pytest.raises(ValidationError):
        api.parse_request(bad)


@pytest.mark.parametrize(("body", "want"), [(b'{"detail": " no "}', "no"), (b'{"detail": [{"msg": "a"}, {"msg": "b"}]}', "a; b"), (b"x", "request failed"), (b"[]", "request failed")])
def test_error_detail(body, want):
    assert api.error_detail(body) == want


def test_strict_responses(client):
    good = client.query(SearchRequest("Q"))
    for change in ({"answer": 1}, {"latency_ms": True}, {"confidence": "SURE"}, {"chunks": [1]}, {"chunks": [{**CHUNK, "line_start": "1"}]}):
        with pytest.raises(BackendError):
            api.parse_response(good | change)


def test_cli(client, capsys):
    assert cli.main(["query", "Q"], client) == 0
    assert "a.cob:1-2 (P, HIGH)" in capsys.readouterr().out
    assert cli.main(["query", "Q", "--stream"], client) == 0 and cli.main(["query", "fail"], client) == 1 and cli.main(["query", " "], client) == 2
