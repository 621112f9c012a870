"""Each operator against a plain version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Columns besides id and text, named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, score double, length long, shard int, kept_text string, __hash long, anchor long"


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 0.5, 7, 3, "x", 9, 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def corpus():
    rnd = random.Random(3)
    words = [rnd.choice(["ba", "ka", "Te", "No", "il"]) * rnd.randrange(1, 4) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = "  This line is shared by MANY documents "
    rows = [(i, "\n".join([text(rnd.randrange(1, 80)), *([shared if i % 2 else shared.upper()] if i % 3 == 0 else []), text(5)])) for i in range(60)]
    base = text(400)
    near = base.split()
    for i in range(60, 70):
        own = list(near)
        own[i * 3] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(70, base), (71, base), (72, base.upper())]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, None), (104, "é" * 30 + "\n" + "Ünï " * 900), (105, "a b c"), (105, "a b c"), (105, "other"), (None, "no id " + text(30)), (None, None)]
    rows += [(110, "x\n" * 3000 + text(6000))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def both(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 1


def test_packing(spark, rows):
    import tokenizers

    from strataseek.llm.packing import cut_documents, place_pieces

    capacity, path = 64, str(public_tokenizers.path("word_bpe_49k.json"))
    tk = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + capacity]))) for k, at in enumerate(range(0, len(ids), capacity))]
    got = place_pieces(cut_documents(frame(spark, rows), path, capacity).withColumn("crc", F.crc32("ids")).drop("ids"), capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= capacity
    assert len(by) <= 1.02 * -(-sum(r.length for r in got) // capacity) + 1


def test_packing_of_nothing(spark):
    from strataseek.llm.packing import cut_documents, place_pieces, plan_packing

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert place_pieces(cut_documents(frame(spark, []), path, 64), 64).count() == 0
    assert plan_packing({}, 64).sequences == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    from strataseek.llm.packing import plan_packing

    rnd = random.Random(seed)
    counts = Counter(min(256, 1 + int(rnd.expovariate(1 / 90))) for _ in range(3000))
    plan = plan_packing(dict(counts), 256)
    room, seen = Counter(), defaultdict(list)
    for length, first, n, seq, _ in plan.runs:
        seen[length].append((first, n))
        for s in range(seq, seq + n):
            room[s] += length
    assert max(room.values()) <= 256 and len(room) == plan.sequences
    for length, own in seen.items():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) == counts[length]
    assert plan.sequences <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 256) + 1


def test_most_sequences_come_from_configurations():
    from strataseek.llm.packing import plan_packing

    rnd = random.Random(5)
    counts = Counter(min(2048, 1 + int(rnd.expovariate(1 / 700))) for _ in range(12000))
    plan = plan_packing(dict(counts), 2048)
    bound = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert plan.full == counts[2048]
    assert plan.configured >= 0.6 * (plan.sequences - plan.full)
    assert plan.sequences <= 1.001 * bound + 1
    many, more = (plan_packing({k: times * n for k, n in counts.items()}, 2048) for times in (10**4, 10**7))
    assert many.sequences <= 1.001 * 10**4 * bound + 1 and len(more.runs) <= 1.1 * len(many.runs)  # the plan doesn't grow with the data


# ---------------------------------------------------------------- 2


def brute_components(rows, shingle, threshold):
    import xxhash

    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{p:016x}", least.get(find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


@pytest.mark.parametrize("block", [100_000, 5])
def test_simhash(spark, rows, block, monkeypatch):
    from strataseek.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [r for r in rows if r[0] != 110]
    got = simhash.near_duplicates(frame(spark, rows), shingle=4, threshold=4, carry=True)
    out = got.withColumn("f", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    assert both(out, "doc_id", "f", "component_id") == brute_components(rows, 4, 4)
    firsts = got.where("is_first")
    assert firsts.count() == got.groupBy("component_id").count().count() + 1  # two texts share the id 105
    assert firsts.select("__row.*").columns == frame(spark, []).columns


def test_simhash_of_nothing(spark):
    from strataseek.llm.simhash import near_duplicates

    assert near_duplicates(frame(spark, []), shingle=4, threshold=4).count() == 0


@pytest.mark.parametrize(("threshold", "direct"), [(4, 1 << 20), (9, 1 << 20), (9, 50)])
def test_anchor_search_finds_all_links(threshold, direct, monkeypatch):
    import numpy as np

    from strataseek.llm import simhash

    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(threshold)
    fps = list(rng.integers(0, 2**63, 60, dtype=np.uint64))
    for _ in range(400):
        x = int(fps[rng.integers(min(len(fps), 80))])
        for b in rng.integers(0, 64, rng.integers(1, threshold + 3)):
            x ^= 1 << int(b)
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps))

    def classes(edges):
        label = list(range(len(fps)))
        for a, b in edges:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return [label.index(x) for x in label]

    at, key, home = (np.concatenate(x) for x in zip(*(s.anchors(fps) for s in simhash.segments(threshold)), strict=True))
    order = np.argsort(key, kind="stable")
    at, key, home = at[order], key[order], home[order]
    a, b = simhash.links(key, fps[at], 0 * fps[at], home, simhash.Limit(threshold))
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert classes(zip(at[a], at[b], strict=True)) == classes(np.argwhere(np.triu(apart <= threshold, 1)))
    assert (np.bitwise_count(fps[at[a]] ^ fps[at[b]]) <= threshold).all()


@pytest.mark.parametrize("block", [4096, 7])
def test_near_copies_link_by_shingles(spark, block, monkeypatch):
    """All pairs of a similarity of 0.8 or more, also where fingerprints are far apart, and no others."""
    from strataseek.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", block)
    rnd = random.Random(12)
    rows = []
    for i in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        rows.append((10 * i, " ".join(base)))
        for k, edits in enumerate((1, 3, 4, 5, 8, 12), 1):
            own = list(base)
            for at in rnd.sample(range(0, 200, 6), edits):
                own[at] = "x"
            rows.append((10 * i + k, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (None, rows[0][1])]
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**6), 10**6 if doc is None else doc)
    got = near_copies.near_copies(frame(spark, rows), shingle=5, similarity=0.8, threshold=9, all_bits=22)
    assert both(got, "doc_id", "component_id") == sorted(((doc, least[find(i)]) for i, (doc, _) in enumerate(rows)), key=repr)
    assert got.where("is_first").count() == len(set(least.values())) and got.select("__row.*").columns == frame(spark, []).columns
    assert near_copies.near_copies(frame(spark, []), shingle=5, similarity=0.8, threshold=9, all_bits=22).count() == 0


# ---------------------------------------------------------------- 3


def test_token_counts(spark, rows):
    import sentencepiece

    from strataseek.llm.token_counts import chars_within, count_tokens, prefix_counts, tokens_at

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [(200, "  two  spaces \n\n ▁x <s></s> 日本語é́\r\n;x\t"), (201, "a" * 50)]
    got = count_tokens(frame(spark, rows + odd), path)
    assert both(got, "doc_id", "n_bytes", "n_tokens") == sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows + odd), key=repr)
    own = {r.doc_id: r for r in got.where("doc_id in (200, 201, 105)").collect()}
    for i, t in odd:
        d = bytes(own[i].prefix_deltas)
        assert prefix_counts(d).tolist() == [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert tokens_at(d, 7) == len(sp.encode(t[:7]))
        n = chars_within(d, 5)
        assert len(sp.encode(t[:n])) <= 5 and all(len(sp.encode(t[:k])) > 5 for k in range(n + 1, len(t) + 1))
    for r in count_tokens(frame(spark, odd + [(300, None)]), path, limit=5).collect():
        assert r.limit_chars == (chars_within(bytes(r.prefix_deltas), 5) if r.n_tokens > 5 else r.n_chars)


# ---------------------------------------------------------------- 4


def test_quality_model(spark, tiny):
    from strataseek.llm.quality_model import score_quality

    good = [(i, " ".join(random.Random(i).choices("the of tree house runs and blue is on it over".split(), k=80))) for i in range(200)]
    bad = [(i, " ".join(random.Random(i).choices("$$$ buy### WIN!! |% NOW!!".split(), k=60))) for i in range(200, 320)]
    rows = good + bad + [(400, None), (401, ""), (None, "of the tree"), (402, "a b"), (402, "a b")]
    labels = spark.createDataFrame([(i, int(i < 200), None) for i in range(320)] + [(5, 1, None), (900, 0, 1), (None, 0, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(frame(spark, rows), labels)
    out = got.collect()
    assert len(out) == len(rows) and got.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id < 320]
    assert sum(r.predicted == int(r.doc_id < 200) for r in held) >= 0.97 * len(held)
    assert {r.score for r in score_quality(frame(spark, rows), labels.where("quality = 1")).collect()}.__len__() == 1
    assert score_quality(frame(spark, []), labels).count() == 0


def test_labelled_sample_is_bounded(spark):
    from strataseek.llm.quality_model import labelled_sample

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "x" * (1000 if i == ids[3] else 10)) for i in ids for _ in range(2)] + [(ids[0], "y" * 10), (ids[1], None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    columns = {"id_col": "doc_id", "text_col": "text", "label_col": "quality"}
    texts, marks = labelled_sample(frame(spark, rows), labels, **columns)
    assert Counter(texts) == Counter(t or "" for _, t in rows) and len(marks) == len(texts)
    assert len(labelled_sample(frame(spark, rows), labels, **columns, rows=7)[0]) == 7
    few, _ = labelled_sample(frame(spark, rows), labels, **columns, most_chars=100)
    assert 0 < len(few) and sum(map(len, few)) <= 100


def test_scores_are_those_of_a_plain_network():
    import numpy as np

    from strataseek.llm import quality_model as Q

    rnd = random.Random(6)
    good = [" ".join(rnd.choices("the of tree house runs and blue is on it over".split(), k=40)) for _ in range(60)]
    bad = [" ".join(rnd.choices("$$$ buy### WIN!! |% NOW!!".split(), k=40)) for _ in range(60)]
    model = Q.fit(good + bad, [1] * 60 + [0] * 60)
    scores = Q.Scorer(model).scores([t.encode() for t in good + bad + [""]])
    assert np.all(np.isfinite(scores)) and np.all((scores >= 0) & (scores <= 1))
    assert scores[:60].min() > 0.5 > scores[60:120].max()
    one_by_one = [float(Q.Scorer(model).scores([t.encode()])[0]) for t in good + bad + [""]]
    assert np.allclose(scores, one_by_one, atol=1e-6)


def test_quality_model_held_out_accuracy(spark, tiny):
    from strataseek.llm.queries import op4_quality_classifier

    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    both = op4_quality_classifier(spark, tiny).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in both) >= 0.85 * len(both)


# ---------------------------------------------------------------- 5


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)})
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated)
    return (*counts, counts[0] < 10 or 100 * repeated > 20 * counts[0])


def test_quality_rules(spark, rows):
    from strataseek.llm.quality_rules import Rule, apply_rules, default_rules, measure, order_rules

    more = [(300, "one two three four five " * 3 + "six"), (301, "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z"), (302, "# $ % |\n# $ % |\nx y z 1 2 3 4 5 6")]
    df = frame(spark, rows + more)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = apply_rules(df)
    assert both(got, "doc_id", *names) == sorted(((i, *brute_rules(t)) for i, t in rows + more), key=repr)
    backwards = apply_rules(df, default_rules()[::-1])
    assert both(got, "doc_id", "kept") == both(backwards, "doc_id", "kept")
    assert got.where("base_failed AND kept").count() == 0
    ordered = order_rules(df, [Rule("never", F.lit(False)), Rule("always", F.lit(True))])
    assert [r.name for r in ordered] == ["always", "never"]
    assert apply_rules(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 6


def luhn_ok(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn_ok(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


PII = [
    (901, "mail bob.x@mail.example.com, or a@b.c_x@d.e; @no.pe a@b"),
    (902, "ip 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8 and 00001.2.3.4"),
    (903, "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 5500005555555559"),
    (904, "call +1 (017) 555-7713 now, +12 34, +49.30.1234567"),
    (905, 'é日 token = "908038b7daaf91e730d2f64001c52934d43d9336" and (212) 555-0199 x'),
    (906, "reach jane (at) example (dot) com please"),
    (907, "the version 1.2.3 of 2020"),
    (908, "a@b.co " * 1500),
    (909, "1" * 5000),
]


def test_pii(spark, rows):
    from strataseek.llm.pii import KINDS, find_pii

    own = PII + rows
    found = {}
    for r in find_pii(frame(spark, own)).collect():
        found.setdefault(r.doc_id, []).append([(x.kind, x.start, x.end, x.base) for x in r.spans])
    for i, t in own:
        base = [[(k, a, b) for k, a, b, is_base in x if is_base] for x in found[i]]
        assert brute_pii(t or "") in base, i
    for spans in (x for per in found.values() for x in per):
        assert spans == sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))
    text = dict(PII)[905]
    assert [text[a:b] for k, a, b, is_base in found[905][0] if k == "secret" and not is_base] == ['token = "908038b7daaf91e730d2f64001c52934d43d9336"']
    assert found[907] == [[]]
    assert find_pii(frame(spark, [])).count() == 0


def test_long_secrets_are_marked_whole(spark):
    from strataseek.llm.pii import candidates

    secret = "token = " + "aB3dE5gH7j" * 60
    (r,) = candidates(frame(spark, [(1, f"see {secret} here")])).collect()
    (x,) = [x for x in r.found if x["kind"] == "secret"]
    assert (x["start"], x["end"]) == (4, 4 + len(secret)) and x["votes"][5] == "1"


def test_reliabilities():
    from strataseek.llm.pii import reliabilities

    post = reliabilities({("email", "222111"): 90, ("email", "100101"): 100, ("email", "122111"): 10, ("email", "102111"): 5})
    assert post["email", "222111"] > 0.95 and post["email", "100101"] < 0.05 and post["email", "122111"] > post["email", "102111"]


def test_added_spans_are_found(spark):
    from strataseek.llm.pii import find_pii

    rnd = random.Random(9)
    words = "the report shows that many people walked along river while it rained".split()
    filler = lambda n: " ".join(rnd.choices(words, k=n))
    token = lambda: "".join(rnd.choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789", k=28)) + "7x"
    made = {
        "email": lambda i: f"write mail to ana.b{i} (at) example.org",
        "secret": lambda i: f"api_key = {token()}",
    }
    planted = [(3 * i + k, kind, f"{filler(20)} {make(i)} {filler(20)}") for i in range(30) for k, (kind, make) in enumerate(made.items())]
    clean = [(1000 + i, filler(60)) for i in range(100)]
    found = {r.doc_id: {x["kind"] for x in r.spans} for r in find_pii(frame(spark, [(i, t) for i, _, t in planted] + clean)).collect()}
    caught = Counter(kind for i, kind, _ in planted if kind in found[i])
    assert all(caught[kind] >= 27 for kind in made), caught
    assert not any(found[i] for i, _ in clean)


# ---------------------------------------------------------------- 7


def test_warc(spark, tmp_path):
    from strataseek.llm import warc

    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d d\n/", ""), (5, "http://é/", "<p>é日\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "one"), (6, "u", "one"), (None, "n", "lone")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, row long").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.archive_pages(df, path)
    got = warc.read_archives(spark, path)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    rows = both(got, "page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to")
    want = [
        (1, 4, digest("same"), "revisit", 2), (2, 4, digest("same"), "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None),
        (5, len(pages[4][2].encode()), digest(pages[4][2]), "response", None), (6, 3, digest("one"), "response", None), (6, 3, digest("one"), "revisit", 6), (None, 4, digest("lone"), "response", None),
    ]
    assert rows == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in got.where("warc_type = 'response'").collect()} == {"same", "", pages[4][2], "one", "lone"}
    assert got.where("warc_type = 'revisit' AND page_id >= 3").count() == 2
    assert [r.page_id for r in got.where(F.col("payload_digest") == digest("same")).orderBy("page_id").collect()] == [1, 2]
    small = tmp_path / "none"
    warc.archive_pages(df.limit(0), f"file://{small}")
    assert warc.read_archives(spark, f"file://{small}").count() == 0
    high = f"file://{tmp_path}/min"
    warc.archive_pages(df, high, min_bytes=4)
    assert warc.read_archives(spark, high, payload=False).where("warc_type = 'revisit'").count() == 1


def test_warc_skips_what_filters_reject(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, StringContains

    from strataseek.llm import warc

    body = gzip.compress(b"payload")
    http = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + body
    data, marks = b"", []
    for i in range(40):
        marks.append(len(data))
        data += warc.make_record({"WARC-Type": "response" if i % 2 else "request", "X-Page-ID": i}, http)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "a.warc.idx").write_text(json.dumps(marks))
    reader = warc.WarcReader({"path": str(tmp_path), "partition_bytes": "700"})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), EqualTo(("page_id",), 7), StringContains(("target_uri",), "x")]))
    assert len(left) == 1
    decoded = []
    monkeypatch.setattr(warc, "http_payload", lambda b: decoded.append(b) or b"payload")
    parts = reader.partitions()
    assert len(parts) > 3
    assert [(r[4], r[8]) for p in parts for r in reader.read(p)] == [(7, b"payload")] and len(decoded) == 1


def test_warc_query_returns_every_page(spark, tmp_path):
    from strataseek.llm.queries import op7_warc_archives

    pages = [(1, "u", "same"), (2, "v", "same"), (3, "w", None), (None, "x", "lone")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_warc_archives(spark, str(tmp_path))
    assert both(got, "page_id", "record_type", "refers_to") == sorted([(1, "revisit", 2), (2, "response", None), (3, "response", None), (None, "response", None)], key=repr)


def test_warc_of_others(tmp_path):
    from pyspark.sql.datasource import EqualTo

    from strataseek.llm import warc

    def record(kind, block):
        return f"WARC/1.0\r\nwarc-TYPE: {kind}\r\nWARC-RECORD-ID: <urn:{kind}>\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n6;x=y\r\npedia \r\n0\r\n\r\n"
    records = [record("warcinfo", b"software: x"), record("response", chunked), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", b"HTTP/1.1 200 OK\r\n\r\nplain")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # a member for each record
    reader = warc.WarcReader({"path": str(tmp_path)})
    found = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[0], r[1], r[4], r[8]) for r in found] == [("response", "<urn:response>", None, b"Wikipedia "), ("request", "<urn:request>", None, None), ("response", "<urn:response>", None, b"plain")]
    assert not list(reader.pushFilters([EqualTo(("warc_type",), "warcinfo")]))
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["warcinfo"]


def test_warc_archives_that_roll_over(spark, tmp_path):
    from strataseek.llm import warc

    rnd = random.Random(4)
    long = "".join(chr(rnd.randrange(33, 1000)) for _ in range(200_000))  # hardly compressible
    rows = [("response", i, f"http://x/{i}", None, None, bytearray((long[i:] + str(i)).encode())) for i in range(12)]
    df = spark.createDataFrame(rows, "record_type string, page_id long, url string, date string, refers_to long, payload binary").coalesce(1)
    warc.register(spark)
    df.write.format("warc").mode("append").option("path", f"file://{tmp_path}").option("archive_bytes", "700000").option("mark_bytes", "100000").save()
    assert len(list(tmp_path.glob("*.warc"))) > 2
    got = spark.read.format("warc").option("path", f"file://{tmp_path}").option("partition_bytes", "200000").load()
    assert got.rdd.getNumPartitions() > len(list(tmp_path.glob("*.warc")))
    assert {r.page_id: bytes(r.payload) for r in got.collect()} == {r[1]: bytes(r[5]) for r in rows}


# ---------------------------------------------------------------- 8


def test_decontamination(spark):
    from strataseek.llm.decontamination import drop_contaminated, find_contamination

    rnd = random.Random(5)
    filler = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]) + rnd.choice("abcdefgh") for _ in range(n))
    item = "a train that left the old station with Alice and 40 passengers travels 120 km in 3 hours and stops near the bridge"
    other = "every baker in this quiet town sells warm bread before the early morning bells have rung across the square"
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "only four words here")], "item_id long, text string")
    changed = item.replace("40", "77").replace("120", "90.5").replace("Alice", "Bertrand").replace("3 hours", "8 hours")
    docs = [
        (1, f"{filler(30)} {item}. {filler(10)}"), (2, f"{filler(5)} {item.lower()}"), (3, f"{filler(9)}; {changed} {filler(9)}"), (4, filler(200)), (5, None), (6, ""), (7, other.upper().replace(" ", "  \n")),
        (8, " ".join(other.split()[:6]) + " " + filler(40)), (9, f"x {filler(3)} only four words here {filler(3)}"), (1, filler(50)), (None, f"{other} {filler(5)}"),
        (11, f"{item} {filler(4)} {changed}"),
    ]
    found = find_contamination(frame(spark, docs), items)
    assert both(found, "doc_id", "item_id") == sorted([(1, 1), (2, 1), (3, 1), (7, 2), (9, 5), (None, 2), (11, 1)], key=repr)
    kinds = {r.doc_id: r.verbatim for r in found.where("item_id = 1").collect()}
    assert kinds[1] and kinds[2] and not kinds[3]
    kept = drop_contaminated(frame(spark, docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8] and kept.columns == frame(spark, []).columns
    assert find_contamination(frame(spark, []), items).count() == 0 and find_contamination(frame(spark, docs), items.limit(0)).count() == 0


def test_slots_must_agree(spark):
    from strataseek.llm.decontamination import find_contamination

    item = "if 5 red boxes hold exactly 5 green balls then how many of the 5 blue jars hold all of them together"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("5", "9")), (2, "if 9 red boxes hold exactly 8 green balls then how many of the 7 blue jars hold all of them together")]
    assert both(find_contamination(frame(spark, docs), items), "doc_id", "item_id") == [(1, 1)]


def test_digits_with_letters_behind_keep_the_forms_aligned(spark):
    from strataseek.llm.decontamination import _templates, find_contamination

    item = "if Tom has 7 apples then Tom gives 5 km of rope to his friend Tom and keeps 7 of the red apples"
    odd = "on the 2nd day a1b2 was 10kg and 0x5f, 120km, 3.5kmh away from İzmir, İzmir and Rome; "
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, odd + item), (2, odd + item.replace("5 km", "5km")), (3, odd + item.replace("7", "9").replace("Tom", "Bob"))]
    assert both(find_contamination(frame(spark, docs), items), "doc_id", "item_id") == [(1, 1), (2, 1), (3, 1)]
    for r in _templates(frame(spark, docs), "doc_id", "text").collect():
        assert len(r.raw) == len(r.typed) == len(r.named)


def test_copies_with_names_as_words(spark):
    from strataseek.llm.decontamination import find_contamination

    item = "when Anna meets her friend Boris near the old mill with Clara they ask the baker Dirk for 3 loaves while Emil waits and then Frida sings"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    wrapped = item
    for name in ("Anna", "Boris", "Clara", "Dirk", "Emil", "Frida"):
        wrapped = wrapped.replace(f" {name}", f"\n {name}" if name < "D" else f"\u00a0{name}")
    docs = [(1, item.lower()), (2, item.upper()), (3, wrapped), (4, wrapped.replace("Boris", "Karl").replace("3", "8")), (5, item.lower().replace("3", "8"))]
    assert both(find_contamination(frame(spark, docs), items), "doc_id", "item_id", "verbatim") == [(1, 1, True), (2, 1, True), (3, 1, True), (4, 1, False), (5, 1, False)]


def test_only_windows_that_conflict_are_dropped(spark):
    from strataseek.llm.decontamination import find_contamination

    plain = "every baker in this quiet town sells warm bread before the early morning bells have rung across the square and all the children run down to"
    long = f"at 6 in the morning {plain} the bridge where the old boats leave at 6 for the island"
    apples = "there are 3 apples and then 4 pears in the wide basket that stood beside the door of our house today"
    items = spark.createDataFrame([(1, long), (2, apples)], "item_id long, text string")
    docs = [(1, long.replace("at 6 for", "at 7 for")), (2, apples.replace("3", "5").replace("4", "5")), (3, long.replace("6", "9"))]
    found = find_contamination(frame(spark, docs), items)
    assert both(found, "doc_id", "item_id", "verbatim") == [(1, 1, False), (2, 2, False), (3, 1, False)]


# ---------------------------------------------------------------- 9


def test_sharding(spark, rows):
    from strataseek.llm.sharding import Shard, Tree, assign_shards

    many = rows + [(1000 + i, f"t{i}") for i in range(3000)]
    tree = Tree.even(2, 3, 4)
    grown = tree.grown(1, 2)
    got = assign_shards(frame(spark, many), tree, grown).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in many), key=repr)
    by, where = defaultdict(list), {}
    for r in got:
        by[r.shard].append(r.slot)
        assert where.setdefault(r.doc_id, r.shard) == r.shard and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(24))
    assert max(map(len, by.values())) < 2 * len(got) / 24 and 0.5 / 25 < sum(r.grown_shard == 24 for r in got) / len(got) < 2 / 25
    heavy = Tree((((Shard(0, 1.0), Shard(1, 3.0)),), ((Shard(2, 4.0),),)))
    n = Counter(r.shard for r in assign_shards(frame(spark, many), heavy).collect())
    assert abs(n[1] / len(got) - 3 / 8) < 0.05 and abs(n[2] / len(got) - 1 / 2) < 0.05
    assert assign_shards(frame(spark, []), tree).count() == 0


# ---------------------------------------------------------------- 10


def brute_lines(rows, n=3, least=20):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held, keeper = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            if i is not None:
                keeper[k] = max(keeper.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or held[key(x)] < n or keeper.get(key(x)) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, rows):
    from strataseek.llm.line_dedup import drop_shared_lines

    more = [(500 + i, "\n".join(["É stays another line than é, here", "é stays another line than é, here"][i % 2 : i % 2 + 1] * 2 + ["tail"])) for i in range(4)]
    got = drop_shared_lines(frame(spark, rows + more))
    assert both(got, "doc_id", "kept_text", "n_lines", "n_dropped") == brute_lines(rows + more)
    assert got.select("__row.*").columns == frame(spark, []).columns
    assert drop_shared_lines(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(8)
    good = lambda n: " ".join(rnd.choice(["the", "of", "and", "tree", "house", "river", "stone", "light"]) + rnd.choice(["", "s", "ly"]) for _ in range(n))
    bench = " ".join(f"bench{i}" for i in range(30))
    clean = [(i, good(150)) for i in range(40)]
    line = "one common line that very many documents hold"
    docs = clean + [(100, clean[0][1]), (101, clean[1][1].replace("river", "brook", 1)), (102, f"{good(60)} {bench}"), *((200 + i, "$$$ buy### WIN!! |% " * 30) for i in range(20))]
    docs += [(300 + i, f"{good(80)}\n{line}") for i in range(4)] + [(400, None), (401, "")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = frame(spark, []).columns
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        seen[name] = rows.collect()
        if name != P.STAGES[-1][0]:
            assert rows.columns == names
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    assert not ids["quality_classifier"] & set(range(200, 220)) and set(range(40)) <= ids["quality_classifier"]
    assert sum(line in (r.text or "") for r in seen["line_dedup"]) == 1 and ids["line_dedup"] == ids["quality_classifier"]
    assert ids["simhash_near_dedup"] & {0, 100} == {0} and ids["simhash_near_dedup"] & {1, 101} == {1} and set(range(40)) <= ids["simhash_near_dedup"]
    assert 102 in ids["simhash_near_dedup"] and 102 not in ids["benchmark_decontamination"] and set(range(40)) <= ids["benchmark_decontamination"]
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]
    final = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == ids["best_fit_packing"]


def test_entry_lists_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
