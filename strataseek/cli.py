"""``python -m strataseek.cli query TEXT``: ask a running server."""

from __future__ import annotations

import argparse
import sys

from strataseek.api import Client
from strataseek.config import DEFAULT_TOP_K, FEATURES
from strataseek.errors import StrataseekError, ValidationError
from strataseek.plans.search import SearchRequest


def render(found: dict) -> str:
    lines = [found["answer"], "", f"Confidence: {found['confidence']}", f"Model: {found['model']}", f"Latency: {found['latency_ms']:.1f} ms", f"Codebase: {found['codebase_filter'] or 'all'}", "Citations:"]
    cited = [f"  - {c['file_path']}:{c['line_start']}-{c['line_end']} ({c['name']}, {c['confidence']})" for c in found["chunks"]]
    return "\n".join(lines + (cited or ["  (none)"]))


def main(argv: list[str] | None = None, client: Client | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataseek")
    q = parser.add_subparsers(dest="command", required=True).add_parser("query")
    q.add_argument("text")
    q.add_argument("--feature", default=FEATURES[0])
    q.add_argument("--codebase")
    q.add_argument("--top-k", type=int, default=DEFAULT_TOP_K)
    q.add_argument("--language", default="cobol")
    q.add_argument("--model")
    q.add_argument("--stream", action="store_true")
    q.add_argument("--url", default="http://127.0.0.1:8000")
    a = parser.parse_args(argv)
    try:
        request = SearchRequest(a.text, a.feature, a.codebase, a.top_k, a.language, a.model)
        ask = client or Client(a.url)
        if a.stream:
            for piece in ask.stream(request):
                print(piece, end="", flush=True)
            print()
        else:
            print(render(ask.query(request)))
    except ValidationError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except StrataseekError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
