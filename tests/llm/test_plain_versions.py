"""The quality model and the benchmark search against plain versions that follow their docstrings."""

import random
from collections import defaultdict

import numpy as np
import pytest
import regex

# ---------------------------------------------------------------- 4


def plain_vectors(docs, known, q):
    """Sums of the index vectors of the words up to REACH away, at unit length."""
    index = np.zeros((len(known), q.DIMENSIONS))
    places, signs = q.index_vectors(list(known))
    for i in range(len(known)):
        for p, s in zip(places[i], signs[i], strict=True):
            index[i, p] += s
    total = np.zeros_like(index)
    for d in docs:
        for i, w in enumerate(d):
            for j in range(max(0, i - q.REACH), min(len(d), i + q.REACH + 1)):
                if j != i:
                    total[w] += index[d[j]]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def plain_words(text, known, q):
    out, before = [], None
    for word in text.split():
        found = [q.AGAIN] if word == before else [m[0] for m in regex.finditer(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*", word)]
        out += [known.get(p, known.get(q.shape(p), known[q.OTHER])) for p in found]
        before = word
    return out


def test_scores_follow_from_vectors_pooling_network_and_temperature(monkeypatch):
    from strataseek.llm import quality_model as Q

    rnd = random.Random(12)
    words = "the of tree house runs and blue is on it over Ähre 12 1999 a_b it's".split()
    good = [" ".join(rnd.choices(words, k=rnd.randrange(5, 60))) for _ in range(70)]
    bad = [" ".join(rnd.choices([*words, "$$$", "buy###", "WIN!!", "NOW!!!!", "win win"], k=rnd.randrange(5, 60))) for _ in range(70)]
    texts, labels = good + bad, [1] * 70 + [0] * 70
    seen = {}
    trained = Q.network

    def noted(x, y, **more):
        seen["x"], seen["y"] = x, y
        seen["w"] = trained(x, y, **more)
        return seen["w"]

    monkeypatch.setattr(Q, "network", noted)
    model = Q.fit(texts, labels)
    docs = [plain_words(t, model.vocabulary, Q) for t in texts]
    vectors = plain_vectors(docs, model.vocabulary, Q)
    pooled = np.array([vectors[d].mean(axis=0) if d else np.zeros(Q.DIMENSIONS) for d in docs])
    mean, spread = pooled.mean(axis=0), pooled.std(axis=0) + 1e-6
    order = np.random.default_rng(5).permutation(len(texts))
    kept, used = order[: int(Q.KEPT_SHARE * len(texts))], order[int(Q.KEPT_SHARE * len(texts)) :]
    x = (pooled - mean) / spread
    assert np.allclose(seen["x"], x[used], atol=1e-3) and (seen["y"] == np.array(labels)[used]).all()
    w1, b1, w2, b2 = seen["w"]
    logits = np.tanh(x @ w1 + b1) @ w2 + b2
    loss = lambda t: -np.mean([np.log(np.clip(p if y else 1 - p, 1e-6, 1)) for p, y in zip(1 / (1 + np.exp(-np.clip(logits[kept] / t, -30, 30))), np.array(labels)[kept], strict=True)])
    assert all(loss(model.temperature) <= loss(t) + 1e-3 for t in (0.25, 0.5, 1, 2, 4, 8))
    want = 1 / (1 + np.exp(-logits / model.temperature))
    assert np.allclose(Q.Scorer(model).scores([t.encode() for t in texts]), want, atol=2e-3)
    new = ["", " \n", "unknown WORDS only 77", "tree tree tree", "$$$ the"]
    pooled = [vectors[d].mean(axis=0) if d else np.zeros(Q.DIMENSIONS) for d in (plain_words(t, model.vocabulary, Q) for t in new)]
    want = 1 / (1 + np.exp(-(np.tanh((np.array(pooled) - mean) / spread @ w1 + b1) @ w2 + b2) / model.temperature))
    assert np.allclose(Q.Scorer(model).scores([t.encode() for t in new]), want, atol=2e-3)


def test_a_network_learns_what_a_line_can_not_part():
    from strataseek.llm.quality_model import network, sigmoid

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    w1, b1, w2, b2 = network(x, y)
    assert ((sigmoid(np.tanh(x @ w1 + b1) @ w2 + b2) > 0.5) == y).mean() > 0.9


def test_a_first_text_over_the_bound_leaves_no_sample(spark):
    from strataseek.llm.quality_model import labelled_sample

    docs = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert labelled_sample(docs, labels, id_col="doc_id", text_col="text", label_col="quality", most_chars=49) == ([], [])
    assert len(labelled_sample(docs, labels, id_col="doc_id", text_col="text", label_col="quality", most_chars=149)[0]) == 2


# ---------------------------------------------------------------- 8


def plain_templates(text, d):
    """(words, typed, named): template words with names as slots and with names as words."""
    t = regex.sub(r"[ \t\n\x0b\f\r\p{Z}]{2,}|(?! )[ \t\n\x0b\f\r\p{Z}]", " ", text or "")
    t = regex.sub(r"(?<=\p{Nd})(?=\p{L})", " ", regex.sub(r"(?<=\p{Nd})[.,](?=\p{Nd})", d.POINT, t))
    n = regex.sub(r"(?<=[\p{Ll},;] )(?!İ)\p{Lu}\p{Ll}+(?![\p{L}\p{Nd}])", d.NAME, t)

    def typed(x):
        x = regex.sub(rf"(?<![\p{{L}}\p{{Nd}}{d.POINT}])\p{{Nd}}[\p{{Nd}}{d.POINT}]*", d.NUMBER, x.lower())
        return regex.sub(rf"(?<={d.NUMBER} )(?:{'|'.join(d.UNITS.split())})(?![\p{{L}}\p{{Nd}}])", d.UNIT, x)

    words = lambda x: [w for w in regex.split(rf"[^\p{{L}}\p{{Nd}}{d.NUMBER}-{d.POINT}]+", x) if w]
    return words(t.lower()), words(typed(n)), words(typed(t))


def plain_contamination(docs, items, d):
    slot = (d.NUMBER, d.UNIT, d.NAME)
    slots = lambda form, raw, at, n: tuple((k, v) for k, v in zip(form[at : at + n], raw[at : at + n], strict=True) if k in slot)
    index, size = defaultdict(set), {}
    for item, text in items:
        raw, typed, named = plain_templates(text, d)
        width = min(len(typed), d.WINDOW)
        if not raw:
            continue
        starts = sorted({*range(0, len(typed) - width + 1, d.STRIDE), len(typed) - width})
        plain = {at: width - len(slots(typed, raw, at, width)) for at in starts}
        kept = [at for at in starts if plain[at] >= min(d.PLAIN, max(plain.values()))]
        size[item] = len(kept)
        for at in kept:
            for form in (typed, named):
                index[width, tuple(form[at : at + width])].add((item, at, slots(form, raw, at, width)))
    out = []
    for doc, text in docs:
        raw, typed, named = plain_templates(text, d)
        aligned = defaultdict(set)
        for form in (typed, named) if named != typed else (typed,):
            for width in {w for w, _ in index}:
                for at in range(len(form) - width + 1):
                    for item, item_at, own in index.get((width, tuple(form[at : at + width])), ()):
                        found = slots(form, raw, at, width)
                        if len(found) == len(own):
                            aligned[item, at - item_at].add((item_at, tuple((k, a, b) for (k, a), (_, b) in zip(own, found, strict=True))))
        for item in {i for i, _ in aligned}:
            windows, n_slots, verbatim = set(), 0, True
            for (other, _), own in aligned.items():
                if other != item:
                    continue
                pairs = {p for _, ps in own for p in ps}
                sides = [p[:2] for p in pairs]
                kept = [w for w in own if not any(sides.count(p[:2]) > 1 for p in w[1])]
                if kept:
                    windows |= {at for at, _ in kept}
                    n_slots = max(n_slots, len({p for _, ps in kept for p in ps}))
                    verbatim = verbatim and all(a == b for _, a, b in pairs)
            if windows and len(windows) >= size[item] * d.SHARE:
                out.append((doc, item, len(windows), size[item], verbatim))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_benchmark_search_equals_a_plain_search(spark, seed):
    from strataseek.llm import decontamination as D

    rnd = random.Random(seed)
    vocabulary = "the train leaves at from to with and sells buys apples for each of how many are left then goes by when será élan were ever".split()
    word = lambda: rnd.choice([*vocabulary, *vocabulary, "Anna", "Bob", "Müller", "12", "3.5", "7 km", "40kg", "1,000 dollars", "x2"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.choice([3, 7, 8, 9, 20, 45]))) for i in range(14)] + [(90, None), (91, ""), (92, "12 3 4"), (93, "12 km")]
    other = {"Anna": "Zoe", "Bob": "Li", "12": "99", "3.5": "8", "7 km": "2 miles"}

    def changed(t, some):
        for a, b in other.items():
            t = t.replace(a, b, 1) if some and rnd.random() < 0.3 else t.replace(a, b)
        return t

    docs = [(i, text(rnd.randrange(0, 60))) for i in range(15)] + [(900, None), (901, ""), (902, "12 km 12 km"), (903, "12 3 4")]
    for item, t in items[:14]:
        for k, form in enumerate((t, changed(t, False), changed(t, True), t.lower(), t.upper(), t[: len(t) * 2 // 3], t.replace(" ", " \n "), f"{t} {t}")):
            docs.append((1000 + 10 * item + k, f"{text(5)} {form} {text(rnd.randrange(0, 9))}"))
    docs.append((5000, " ".join(t or "" for _, t in items) * 40))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS item_id", "'x' AS typed", "3 AS at", "4 AS text_hash").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS width", "6 AS raw")
    got = sorted(((r.doc_id, r.item_id, r.found_windows, r.item_windows, r.verbatim) for r in D.find_contamination(frame, bench).collect()), key=repr)
    assert got == plain_contamination(docs, items, D) and len(got) > 40
    assert D.find_contamination(frame.limit(0), bench).count() == 0 == D.find_contamination(frame, bench.limit(0)).count()
    twice = D.find_contamination(frame.where("doc_id = 1020").union(frame.where("doc_id = 1020")), bench)
    assert twice.count() == D.find_contamination(frame.where("doc_id = 1020"), bench).count() > 0
