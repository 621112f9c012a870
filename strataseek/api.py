"""The wire: requests and responses as JSON, an HTTP surface on the standard library, and a client."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from strataseek.config import CODEBASES, DEFAULT_TOP_K
from strataseek.errors import BackendError, ProviderError, StrataseekError, ValidationError
from strataseek.plans.search import Engine, SearchRequest

LEVELS = ("HIGH", "MEDIUM", "LOW")
CHUNK_FIELDS = {"content": str, "file_path": str, "line_start": int, "line_end": int, "name": str, "language": str, "codebase": str, "score": float, "confidence": str}


def parse_request(body: dict) -> SearchRequest:
    known = {"query", "feature", "codebase", "top_k", "language", "model"}
    if not isinstance(body, dict) or not isinstance(body.get("query"), str):
        raise ValidationError("query has to be a text")
    top_k = body.get("top_k", DEFAULT_TOP_K)
    if isinstance(top_k, bool) or not isinstance(top_k, int):
        raise ValidationError("top_k has to be a whole number")
    return SearchRequest(**{k: v for k, v in body.items() if k in known and v is not None} | {"top_k": top_k})


def response_json(found: dict) -> dict:
    """A response as it goes out; a chunk's other fields go into its metadata as texts, lists joined by commas."""

    def text(v: object) -> str:
        return ",".join(map(str, v)) if isinstance(v, list) else str(v)

    chunks = [
        {k: c.get(k) for k in CHUNK_FIELDS} | {"metadata": {k: text(v) for k, v in c.items() if k not in ("content", "score", "confidence") and isinstance(v, (str, int, float, list))}} for c in found["chunks"]
    ]
    return found | {"chunks": chunks}


def _field(body: dict, name: str, kind: type) -> object:
    value = body.get(name)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if isinstance(value, bool) or not isinstance(value, kind):
        raise BackendError(f"the response's {name} isn't a {kind.__name__}")
    return value


def parse_response(body: object) -> dict:
    """Strict: every required field with its type, levels among the three, chunks and their metadata."""
    if not isinstance(body, dict) or not isinstance(body.get("chunks"), list):
        raise BackendError("the response isn't an object with chunks")
    out: dict = {k: _field(body, k, str) for k in ("answer", "query", "feature", "confidence", "model")}
    out["latency_ms"] = _field(body, "latency_ms", float)
    out["codebase_filter"] = body.get("codebase_filter")
    if out["codebase_filter"] is not None and not isinstance(out["codebase_filter"], str):
        raise BackendError("the response's codebase_filter isn't a text")
    out["chunks"] = []
    for chunk in body["chunks"]:
        if not isinstance(chunk, dict):
            raise BackendError("a chunk isn't an object")
        own = {k: _field(chunk, k, kind) for k, kind in CHUNK_FIELDS.items()}
        meta = chunk.get("metadata", {})
        if not isinstance(meta, dict):
            raise BackendError("a chunk's metadata isn't an object")
        out["chunks"].append(own | {"metadata": {str(k): str(v) for k, v in meta.items()}})
    if any(x["confidence"] not in LEVELS for x in [out, *out["chunks"]]):
        raise BackendError("unknown confidence")
    return out


def error_detail(body: bytes, otherwise: str = "request failed") -> str:
    """The detail of an error body: a text, or the messages of a list of problems."""
    try:
        detail = json.loads(body).get("detail")
    except (ValueError, AttributeError):
        return otherwise
    if isinstance(detail, str) and detail.strip():
        return detail.strip()
    if isinstance(detail, list):
        said = [d["msg"] for d in detail if isinstance(d, dict) and isinstance(d.get("msg"), str)]
        return "; ".join(said) or otherwise
    return otherwise


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """POST /api/query, POST /api/stream, GET /api/health, GET /api/codebases."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/api/health":
                self._send(200, {"status": "ok"})
            elif self.path == "/api/codebases":
                self._send(200, [{"name": n, "language": lang, "description": about} for n, lang, _, _, _, about in CODEBASES])
            else:
                self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            try:
                try:
                    request = parse_request(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
                except ValueError as e:
                    raise ValidationError(str(e)) from e
                if self.path == "/api/query":
                    began = time.perf_counter()
                    found = engine.answer(request)
                    self._send(200, response_json(found | {"latency_ms": (time.perf_counter() - began) * 1000}))
                elif self.path == "/api/stream":
                    pieces = engine.stream(request)
                    first = next(pieces, "")  # an error before the first piece is still a status
                    self.send_response(200)
                    self.send_header("Content-Type", "text/plain; charset=utf-8")
                    self.end_headers()
                    for piece in (first, *pieces):
                        self.wfile.write(piece.encode())
                else:
                    self._send(404, {"detail": "not found"})
            except StrataseekError as e:
                self._send(e.status, {"detail": str(e)})

    return ThreadingHTTPServer((host, port), Handler)


class Client:
    def __init__(self, base_url: str = "http://127.0.0.1:8000", timeout: float = 30):
        if timeout <= 0:
            raise ValidationError("the timeout has to be over 0")
        self.base, self.timeout = base_url.rstrip("/"), timeout

    def _post(self, path: str, request: SearchRequest):
        body = {k: v for k, v in vars(request).items() if v is not None}
        call = urllib.request.Request(f"{self.base}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            return urllib.request.urlopen(call, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            kind = ValidationError if e.code in (400, 422) else BackendError
            raise kind(error_detail(e.read())) from e
        except OSError as e:
            raise ProviderError(str(e)) from e

    def query(self, request: SearchRequest) -> dict:
        with self._post("/api/query", request) as r:
            try:
                return parse_response(json.loads(r.read()))
            except ValueError as e:
                raise BackendError("the response isn't JSON") from e

    def stream(self, request: SearchRequest) -> Iterator[str]:
        with self._post("/api/stream", request) as r:
            while piece := r.read1(4096):
                yield piece.decode("utf-8", "replace")


