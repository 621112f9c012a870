"""Byte-pair counts against the library, and chunk sizes by them against a plain version."""

import base64
import random

import pytest

from strataseek.functions.bytepairs import PATTERN, BytePairs, Growing, with_token_count
from strataseek.operators import sizing

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def path():
    return str(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(3)
    bits = ["MOVE ", "WS-TOTAL", " PERFORM", "\n", "       ", "é", "日本", "🎉", "123456", "a" * 50, "'s", "'", ".", "==", "\t", "  \n ", "don't", "x", " ", "Z" * 7]
    return ["", " ", "\n \t", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))) for _ in range(400)), "ab" * 20000, " " * 5000 + "x"]


def test_tokens_are_those_of_the_library(path, library):
    pairs = BytePairs(path)
    for t in texts():
        want = library.encode_ordinary(t)
        assert pairs.tokens(t) == want and pairs.count(t) == (len(want) if t.strip() else 0)


def test_documents_are_counted_as_the_library_does(spark, tiny, path, library):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id", "text", "0 AS token_count")
    got = {r["doc_id"]: (r["text"], r["token_count"]) for r in with_token_count(docs, BytePairs(path), text_col="text").collect()}
    assert len(got) == docs.count() and all(n == (len(library.encode_ordinary(t)) if (t or "").strip() else 0) for t, n in got.values())


def test_a_table_without_merges_counts_bytes():
    assert BytePairs({}).count("né 日") == len("né 日".encode()) and BytePairs({b"ab": 0, b"abc": 1}).count("abcab") == 2


def test_growing_texts(path):
    pairs, rnd = BytePairs(path), random.Random(5)
    for t in texts()[:200]:
        grown, at, n = Growing(pairs), 0, 0
        while at < len(t):
            step = rnd.randrange(1, 9)
            n, grown = grown.after(t[at : at + step])
            at += step
            assert n == pairs.count(t[:at])


def plain_split(content, first, last, name, most, count):
    """Counts each candidate as a whole."""
    lines = content.splitlines()
    if count(content) <= most or not lines:
        return [(content, first, last, name, count(content))]
    parts, held, start = [], [], first
    for at, line in enumerate(lines, first):
        if held and count("\n".join([*held, line])) > most:
            parts.append(("\n".join(held), start, at - 1))
            held, start = [line], at
        elif not held and count(line) > most:
            words = []
            for w in line.split():
                if words and count(" ".join([*words, w])) > most:
                    parts.append((" ".join(words), at, at))
                    words = []
                words.append(w)
            parts += [(" ".join(words), at, at)] if words else []
            start = at + 1
        else:
            held.append(line)
    parts += [("\n".join(held), start, last)] if held else []
    return [(c, a, b, f"{name}#{i}" if len(parts) > 1 else name, count(c)) for i, (c, a, b) in enumerate(parts, 1)]


def code(rnd, lines):
    return "\n".join(" ".join(rnd.choice(["MOVE", "A-B", "TO", "ws-total.", "é", "12", "PERFORM"]) for _ in range(rnd.choice([0, 3, 9, 60]))) for _ in range(lines))


def test_splits_by_byte_pairs(spark, path):
    pairs, rnd = BytePairs(path), random.Random(7)
    rows = [(code(rnd, rnd.randrange(1, 40)), 5, 60, f"N{i}", 0) for i in range(60)] + [("", 1, 1, "E", 0), (None, 1, 1, "X", 0)]
    df = spark.createDataFrame(rows, "content string, line_start int, line_end int, name string, token_count int")
    got = sorted(map(tuple, sizing.split_oversized(df, 40, pairs=pairs).collect()))
    want = sorted((c, a, b, n, k) for content, first, last, name, _ in rows for c, a, b, n, k in plain_split(content or "", first, last, name, 40, pairs.count))
    assert got == want and len(got) > len(rows)


def test_merges_by_byte_pairs(spark, path):
    pairs, rnd = BytePairs(path), random.Random(8)
    kind = "chunks array<struct<content:string,line_start:int,line_end:int,chunk_type:string,name:string,division:string,token_count:int>>, path string"
    rows = [([(code(rnd, rnd.randrange(1, 6)).strip() or "X", 10 * k, 10 * k + 9, "p", f"N{k % 4}", rnd.choice("AB"), -1) for k in range(rnd.randrange(0, 9))], f"f{i}") for i in range(50)]
    got = {r["path"]: [(c["content"], c["line_start"], c["line_end"], c["token_count"]) for c in r["chunks"]] for r in sizing.merge_small(spark.createDataFrame(rows, kind), "MIXED", least=30, pairs=pairs).collect()}
    for chunks, name in rows:
        own = []
        for c in chunks:
            if own and own[-1][3] < 30:
                text = f"{own[-1][0]}\n{c[0]}".strip()
                own[-1] = (text, own[-1][1], c[2], pairs.count(text))
            else:
                own.append((c[0], c[1], c[2], pairs.count(c[0])))
        if len(own) > 1 and own[-1][3] < 30:
            text = f"{own[-2][0]}\n{own[-1][0]}".strip()
            own[-2:] = [(text, own[-2][1], own[-1][2], pairs.count(text))]
        assert got[name] == own
