"""Runs of words, reply trees and the divergence audit against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataseek.llm import queries as Q

#: Columns besides those of the table, named like the operators' own.
EXTRA = ("runs", "n_words", "term", "score", "__id", "tree", "position")


def more(df, *but):
    return df.withColumns({n: F.lit(7) for n in EXTRA if n not in but})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 11


def brute_runs(words, exponent=4, shortest=6):
    """By periods from the smallest: each stretch in which words ``q`` apart are equal, unless a smaller period does."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        k = 0
        while k < n - q:
            end = k
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - k + q
            if end > k and length >= max(shortest, exponent * q):
                own = words[k : k + length]
                if not any(all(own[i] == own[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((k, length, q))
            k = max(end, k + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_op11(rows):
    out = []
    for i, text in rows:
        words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13, 32)}).split(" ") if w]
        n = len(words)
        if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        lost = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        out.append(
            (i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in lost)))
        )
    return sorted(out, key=repr)


def texts_with_runs(seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(150):
        words = [rnd.choice("abcdeé") for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(0, 3)):
            at, unit = rnd.randrange(len(words) + 1), [rnd.choice("xyzü") for _ in range(rnd.randrange(1, 9))]
            words[at:at] = (unit * 9)[: rnd.randrange(len(unit), 8 * len(unit) + 1)]
        rows.append((i, rnd.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n\x0c"), (None, "a " * 7 + "\x1f b\x85c"), (None, None), (3, "a b a b a b a b"), (3, "a b a b a b a b"), (1003, "w " * 5000), (1004, "one two " * 900 + "Ünï " * 40)]
    return rows


def test_runs_query_equals_brute_force(spark, tmp_path):
    rows = texts_with_runs()
    more(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_op11(rows)


@pytest.mark.parametrize(("exponent", "shortest"), [(2, 1), (3, 4), (4, 6), (5, 12)])
def test_runs_of_other_sizes(exponent, shortest):
    from strataseek.llm.periodic_runs import text_runs

    rnd = random.Random(exponent)
    for _ in range(60):
        texts = [" ".join(rnd.choice("ab"[: rnd.randrange(1, 3)]) for _ in range(rnd.randrange(0, 50))).encode() for _ in range(5)]
        words, runs = text_runs(texts, exponent, shortest)
        assert [[tuple(r) for r in own.tolist()] for own in runs] == [brute_runs(w, exponent, shortest) for w in words]


def test_blocks_do_not_change_runs(spark):
    from strataseek.llm.periodic_runs import find_runs

    docs = more(spark.createDataFrame(texts_with_runs(7), "key string, body string"))
    one, many = (find_runs(docs, id_col="key", text_col="body", block=b) for b in (1 << 20, 3))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect())) and one.columns == ["key", "n_words", "runs", "collapsed"]
    assert find_runs(docs.limit(0), id_col="key", text_col="body").count() == 0


# ---------------------------------------------------------------- 12

MARKS = ["<|im_start|>", "<|im_end|>", "<\\|im_start|>", "<\\\\|", "<|", "<", "|", "\\", "<|nl|>", "<\\n|", "a\nb", "é<|im_end|>\n", ""]


def conversations(seed=2):
    rnd = random.Random(seed)
    say = lambda: "".join(rnd.choice(MARKS) for _ in range(rnd.randrange(0, 6)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "to\nol", "<|im_start|>x", "<|nl|>"]), say()) for c in range(30) for t in range(rnd.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    rows += [(51, 0, None, None), (51, 0, "user", "twice"), (51, 0, "user", "twice"), (51, None, "assistant", "no turn"), (None, 1, "assistant", None), (52, 7, "assistant", "long " * 20000), (53, 5, "user", "gap"), (53, 99, "assistant", "gap")]
    return rows


def brute_op12(rows):
    by = defaultdict(list)
    for c, t, role, text in rows + [(-1, 0, "user", Q.MARKED), (-1, 1, "assistant", Q.MARKED)]:
        by[c].append(((t is not None, t or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = []
    for c, own in by.items():
        own.sort()
        learnt = "".join(text for _, role, _, text in own if role == "assistant")
        out.append((c, len(own), sha("".join(f"{role}\n{text}\n" for _, role, _, text in own)), len(learnt), sha(learnt)))
    return sorted(out, key=repr)


def test_chat_query_reads_back_what_went_in(spark, tmp_path):
    rows = conversations()
    more(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.op12_chat_replies(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_op12(rows)
    assert next(r.formatted_chars for r in got if r.conv_id == 53) == len("<|im_start|>user\ngap<|im_end|>\n<|im_start|>assistant\ngap<|im_end|>\n")


TREE = "message_id string, parent_id string, role string, text string, score double"


def test_branches_of_reply_trees(spark):
    from strataseek.llm.reply_trees import format_replies, read_back

    rows = [
        ("r", None, "user", "question", 0.0), ("a", "r", "assistant", "bad", 0.1), ("b", "r", "assistant", "good", 0.9), ("c", "b", "user", "why", 0.5), ("d", "c", "assistant", "because", 0.8), ("e", "c", "assistant", "no idea", None),
        ("lost", "absent", "user", "alone", 1.0), ("own", "own", "user", "itself", 1.0), (None, "r", "assistant", "no id", 0.0), (None, None, "user", None, None), ("b", "r", "assistant", "repeated, lower", 0.2),
    ]
    messages = more(spark.createDataFrame(rows, TREE), "score").repartition(3)
    every = {r.leaf: r for r in read_back(format_replies(messages, paths=None, tree_col="message_id")).collect()}
    said = lambda r: [t.text for t in r.turns]
    assert said(every["d"]) == ["question", "good", "why", "because"] and every["d"]["rank"] == 1 and every["d"].learnt == "goodbecause" and every["d"].tree == "r"
    assert said(every["e"]) == ["question", "good", "why", "no idea"] and said(every["a"]) == ["question", "bad"]
    assert [every[x]["rank"] for x in "dea"] == [1, 2, 3] and abs(every["d"].branch_score - 2.2 / 4) < 1e-9
    assert said(every["lost"]) == ["alone"] and said(every["own"]) == ["itself"]
    lone = sorted(said(r) for r in read_back(format_replies(messages, paths=None)).collect() if r.leaf is None)
    assert lone == [[""], ["question", "no id"]]
    best = format_replies(messages, paths=1)
    assert {r.leaf for r in best.collect()} == {"d", "lost", "own", None}
    assert format_replies(messages.limit(0)).count() == 0


def test_marks_and_masks(spark):
    from strataseek.llm.reply_trees import END, START, format_replies, read_back

    rnd = random.Random(4)
    rows, last = [], None
    for i in range(200):
        rows.append((str(i), last, rnd.choice(["assistant", "user", "a\n" + rnd.choice(MARKS)]), "".join(rnd.choice(MARKS) for _ in range(rnd.randrange(6))), 0.0))
        last = str(i)
    r = read_back(format_replies(spark.createDataFrame(rows, TREE))).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows] and r.learnt == "".join(x[3] for x in rows if x[2] == "assistant")
    assert r.formatted.count(START) == r.formatted.count(END) == 200 == r.n_turns
    for part, m, x in zip(r.formatted.split(START)[1:], r.loss, rows, strict=True):
        assert m.length == 0 or (x[2] == "assistant" and part[: m.start] == "assistant\n" and part[m.start + m.length :] == END + "\n")


def test_a_ring_of_messages_is_an_error(spark):
    from strataseek.llm.reply_trees import format_replies

    with pytest.raises(ValueError, match="ring"):
        format_replies(spark.createDataFrame([("a", "b", "user", "x", 0.0), ("b", "c", "user", "x", 0.0), ("c", "a", "user", "x", 0.0)], TREE))


# ---------------------------------------------------------------- 13


def brute_op13(rows, least=3, top=200):
    terms = lambda t: [w for w in "".join(c if ord(c) > 127 or c.isalpha() else " " for c in t).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        own = terms(text or "")
        counts[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    total = {g: sum(c[t] for t in kept.get(g[0], ())) for g, c in counts.items()}
    share = lambda n, all_n, kinds: 1 + 10**9 * (n + 1) // (all_n + kinds)
    out = []
    for lang, source in counts:
        own, groups = kept.get(lang, []), [g for g in counts if g[0] == lang]
        p = {g: {t: share(counts[g][t], total[g], len(own)) for t in own} for g in groups}
        n = sum(total[g] for g in groups)
        q = {t: share(sum(counts[g][t] for g in groups), n, len(own)) for t in own}
        me = p[lang, source]
        pairs = [(g[1], sum((me[t] - p[g][t]) ** 2 // p[g][t] for t in own)) for g in groups if g[1] != source]
        loud = [(t, (me[t] - q[t]) ** 2 // q[t]) for t in own if counts[lang, source][t] and me[t] > q[t]]
        for part, found in (("pair", pairs), ("term", loud)):
            best = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(best, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows(seed=3):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice(["ba", "Té", "no", "ÉL", "x"]) * rnd.randrange(1, 4) + rnd.choice(["", "s", "ly", "日"]) for _ in range(700)]
    rows = [(i, " ".join(rnd.choice(vocabulary[k * 30 : k * 30 + 500]) + rnd.choice([" ", ", 7-", "\n"]) for _ in range(rnd.randrange(0, 90))), rnd.choice(["en", "de"]), f"s{k}") for i in range(120) for k in [rnd.choice([0, 0, 0, 1, 2, 3, 4, 5])]]
    rows += [(500, None, None, None), (501, "", "en", "empty"), (502, "123 !?", "en", "signs"), (503, "only here", "fr", "one"), (504, "only here", "fr", "two"), (505, None, "fr", None), (1, "Same same", "en", "s0"), (1, "Same same", "en", "s0"), (1, "Same same", "en", "s0"), (None, "same " * 30000, "de", "long")]
    return rows


@pytest.mark.parametrize(("cells", "top"), [(1 << 20, 200), (64, 5)])
def test_divergence_equals_brute_force(spark, cells, top):
    from strataseek.llm.source_divergence import audit_sources

    rows = audit_rows()
    docs = more(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).repartition(3)
    got = audit_sources(docs, cells=cells, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_op13(rows, top=top)
    assert audit_sources(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np

    from strataseek.llm.source_divergence import shares

    counts, total, kinds = np.array([[10**15 - 1, 7, 0]]), np.array([10**15]), 10**6
    assert shares(counts, total, kinds).tolist() == [[1 + 10**9 * (c + 1) // (10**15 + 10**6) for c in (10**15 - 1, 7, 0)]]


# ---------------------------------------------------------------- earlier operators


@pytest.mark.parametrize("weight", [0, -1, float("nan"), float("inf")])
def test_weights_of_shards_are_above_zero(weight):
    from strataseek.llm.sharding import Shard, Tree

    with pytest.raises(ValueError, match="above 0"):
        Shard(3, weight)
    with pytest.raises(ValueError, match="above 0"):
        Tree.even(1, 1, 2).grown(0, 0, weight)


def test_trees_of_shards_are_checked():
    from strataseek.llm.sharding import Shard, Tree

    for regions in ((), ((),), (((),),), (((Shard(1), Shard(1)),),)):
        with pytest.raises(ValueError, match="numbers of their own"):
            Tree(regions)


def test_dense_rows_of_personal_data_take_time_in_proportion(spark):
    import time

    from strataseek.llm.pii import candidates

    def seconds(n):
        text = " ".join(f"call 030 {i % 900 + 100:03d}-{i % 10000:04d} or +49 30 {i:07d};" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert candidates(docs).select(F.size("found")).first()[0] == 2 * n
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(50)
    assert seconds(4000) < 2.5 * seconds(2000)


def test_loose_spans_beside_base_ones(spark):
    from strataseek.llm.pii import _clear_of

    rnd = random.Random(9)
    span = lambda: (lambda a: (a, a + rnd.randrange(1, 12)))(rnd.randrange(400))
    rows = [([span() for _ in range(rnd.randrange(0, 30))], [span() for _ in range(rnd.randrange(0, 400))]) for _ in range(40)]
    kind = "array<struct<start:int,end:int>>"
    got = spark.createDataFrame(rows, f"own {kind}, taken {kind}").select("own", "taken", _clear_of(F.col("own"), F.col("taken")).alias("free")).collect()
    for r in got:
        assert r.free == [x for x in r.own if not any(b.start < x.end and x.start < b.end for b in r.taken)]


def test_pages_behind_a_shuffle_and_with_columns_of_like_names(spark, tmp_path):
    from strataseek.llm.warc import archive_pages, read_archives

    rows = [(i, f"http://h/{i}", f"page {i % 40}") for i in range(400)] + [(7, "http://h/7", "page 7")] * 3 + [(None, None, None), (None, None, None), (900, "u", "")]
    pages = more(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumns({n: F.lit(1) for n in ("row", "digest", "tie", "owner", "payload", "may_own")})
    shuffled = pages.repartition(7).join(spark.range(2).withColumnRenamed("id", "page_id").withColumn("found", F.lit(1)), "page_id", "left").groupBy(pages.columns).count()
    shuffled = shuffled.select(*pages.columns, F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("n")).orderBy(F.rand(3))
    archive_pages(shuffled, f"file://{tmp_path}/w")
    found = read_archives(spark, f"file://{tmp_path}/w", payload=False).collect()
    by = Counter((r.payload_digest, r.warc_type) for r in found)
    assert len(found) == len(rows) and all(by[d, "response"] == 1 for d, _ in by)
    assert all(r.refers_to == 360 + r.page_id % 40 for r in found if r.warc_type == "revisit" and r.page_id is not None and r.page_id < 400)
