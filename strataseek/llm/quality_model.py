"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Fitting is on the driver, on a bounded sample of labelled rows (``LABELLED_ROWS``, the
rows with the smallest hash of their id, whole texts, ``LABELLED_CHARS`` in all):

- each word has a sparse random index vector, drawn from its own hash; a word's vector is the
  sum of the index vectors of the words around it, over the sample, at unit length. Words are runs
  of letters, of digits or of one mark; rare words share a vector by shape (lower case,
  capitals, ...), so a text of unknown words still has a place, and a word right behind itself is
  another word, "again";
- a text's vector is the mean of its words' vectors;
- a two-layer network on that, by Adam, and a temperature fitted on rows kept from its training.

Scoring reads every whole text, in Arrow batches, without a shuffle. The first layer is applied
to the words' vectors once, before pooling, which gives the same numbers.

Cases: a text without words (null, empty, blank) has the mean vector 0 and the score that the network
gives it; rows without a label, and labels without a row, are no samples; of repeated labels the
largest holds; without samples of both classes the score is their smoothed share for all; repeated rows have
equal scores; an empty table gives no rows; only the id and text columns of ``docs`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.llm.slices import slices
from strataseek.llm.wordcache import WordCache

#: The bound of the sample that the model is fitted on.
LABELLED_ROWS = 4000
#: The bound of its texts together, in characters: the sample ends before the first that goes over it.
LABELLED_CHARS = 50_000_000
VOCABULARY = 20_000
DIMENSIONS = 128
NONZERO = 8
REACH = 2
HIDDEN = 32
EPOCHS = 60
#: Of the sample, for the temperature.
KEPT_SHARE = 0.2
CACHE_WORDS = 50_000
GATHER = 1 << 18

AGAIN, AGAIN_WORD = "\0again", b"\0again"
#: Stands for a part whose shape isn't known either; its vector is 0.
OTHER = "\0other"
PARTS = re.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*")


def shape(part: str) -> str:
    """What stands for a rare word."""
    if part == AGAIN:
        return part
    if part[0].isdigit():
        return f"\0digits{min(len(part), 5)}"
    if not part[0].isalpha():
        return f"\0mark{part[0]}{min(len(part), 4)}"
    length = min(len(part) // 4, 4)
    if part.isupper():
        return f"\0upper{length if len(part) > 1 else 'one'}"
    return f"\0{'lower' if part.islower() else 'title' if part.istitle() else 'mixed'}{length}"


def parts(word: bytes) -> list[str]:
    """Entries of the vocabulary in a blank-separated word. A word in capitals is another than in lower case, and so is a longer run of a mark."""
    return [AGAIN] if word == AGAIN_WORD else [m[0] for m in PARTS.finditer(word.decode("utf-8", "replace"))]


def words_of(text: bytes) -> list[bytes]:
    """Blank-separated words; one that only repeats the word before is a word of its own kind."""
    words = text.split()
    return words[:1] + [AGAIN_WORD if a == b else b for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Model:
    vocabulary: dict[str, int]
    first: np.ndarray  # words x hidden: the first layer on each word's vector
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float
    constant: float | None = None

    def ids(self, word: bytes) -> bytes:
        known = self.vocabulary
        out = []
        for p in parts(word):
            i = known.get(p)
            if i is None:
                i = known.get(shape(p), known[OTHER])
            out.append(i)
        return np.array(out, np.int32).tobytes()


def index_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each word's nonzero entries, from its hash."""
    places = np.empty((len(words), NONZERO), np.int64)
    signs = np.empty((len(words), NONZERO), np.float32)
    for i, w in enumerate(words):
        rng = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(w.encode(), 7)))
        places[i] = rng.choice(DIMENSIONS, NONZERO, replace=False)
        signs[i] = rng.integers(0, 2, NONZERO) * 2 - 1
    return places, signs


def word_vectors(stream: np.ndarray, words: list[str]) -> np.ndarray:
    """stream: word numbers, -1 between texts. In blocks, so that memory is that of the vectors."""
    places, signs = index_vectors(words)
    total = np.zeros(len(words) * DIMENSIONS)
    for at in range(0, len(stream), GATHER):
        block = stream[at : at + GATHER + REACH]
        for step in range(1, REACH + 1):
            a, b = block[: min(GATHER, len(block) - step)], block[step : GATHER + step]
            both = (a >= 0) & (b >= 0)
            for word, near in ((a[both], b[both]), (b[both], a[both])):
                for k in range(NONZERO):
                    total += np.bincount(word.astype(np.int64) * DIMENSIONS + places[near, k], weights=signs[near, k], minlength=len(total))
    vectors = total.reshape(len(words), DIMENSIONS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def network(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """w1, b1, w2, b2 by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    t = 0
    for epoch in range(EPOCHS):
        rate = 0.01 if epoch < EPOCHS * 2 // 3 else 0.002
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            own, want = x[at], y[at]
            hidden = np.tanh(own @ w[0] + w[1])
            error = (sigmoid(hidden @ w[2] + w[3][0]) - want) / len(at)
            back = np.outer(error, w[2]) * (1 - hidden**2)
            grads = [own.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], np.array([error.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w[0], w[1], w[2], float(w[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logits / t), 1e-6, 1 - 1e-6)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    return float(min(grid, key=loss)) if len(y) else 1.0


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model({}, np.zeros((1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0, constant=float((y.sum() + 1) / (len(y) + 2)))
    seen: dict[str, int] = {}
    docs = [np.array([seen.setdefault(p, len(seen)) for p in chain.from_iterable(map(parts, words_of(t.encode())))], np.int32) for t in texts]
    counts = np.bincount(np.concatenate(docs), minlength=len(seen))
    common = sorted((w for w, i in seen.items() if counts[i] >= 3), key=lambda w: (-counts[seen[w]], w))[:VOCABULARY]
    known = {w: i for i, w in enumerate(common)}
    for s in sorted({shape(w) for w in seen}):
        known[s] = len(known)
    known[OTHER] = len(known)
    number = np.array([known[w] if w in known else known[shape(w)] for w in seen], np.int32)
    docs = [number[d] for d in docs]
    vectors = word_vectors(np.concatenate([x for d in docs for x in (d, np.full(REACH, -1, np.int32))]), list(known))
    pooled = np.array([vectors[d].mean(0) if len(d) else np.zeros(DIMENSIONS) for d in docs])
    mean, spread = pooled.mean(0), pooled.std(0) + 1e-6
    x = (pooled - mean) / spread

    order = np.random.default_rng(5).permutation(len(y))
    kept, used = np.split(order, [int(KEPT_SHARE * len(y))])
    if len(set(y[used])) < 2:
        used = order
    w1, b1, w2, b2 = network(x[used], y[used])
    logits = np.tanh(x[kept] @ w1 + b1) @ w2 + b2
    scaled = w1 / spread[:, None]
    return Model(known, (vectors @ scaled).astype(np.float32), b1 - mean @ scaled, w2, b2, fit_temperature(logits, y[kept]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, WordCache(CACHE_WORDS)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        split = [words_of(t) for t in texts]
        self.cache.trim()
        for w in self.cache.missing(set(chain.from_iterable(split))):
            self.cache[w] = m.ids(w)
        get = self.cache.__getitem__
        pooled = np.zeros((len(texts), HIDDEN))
        for i, words in enumerate(split):
            ids = np.frombuffer(b"".join(map(get, words)), np.int32)
            for at in range(0, len(ids), GATHER):
                pooled[i] += m.first[ids[at : at + GATHER]].sum(axis=0, dtype=np.float32)
            pooled[i] /= max(1, len(ids))
        return sigmoid((np.tanh(pooled + m.bias) @ m.second + m.offset) / m.temperature)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int = LABELLED_ROWS, most_chars: int = LABELLED_CHARS) -> tuple[list[str], list[int]]:
    """At most ``rows`` texts with labels, ``most_chars`` characters in all, none held out. The ids are drawn from the labels first, so only their texts move."""
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 0))
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    own = own.join(F.broadcast(ids), "__id").withColumn("__hash", F.xxhash64("__text"))
    # Sizes first, so that what comes to the driver is bounded whatever the texts.
    sizes = own.select("__id", "__hash", F.length("__text").alias("n")).orderBy(F.xxhash64("__id"), "__id", "__hash").limit(rows).collect()
    kept = [(r["__id"], r["__hash"]) for r, total in zip(sizes, accumulate(r["n"] for r in sizes), strict=True) if total <= most_chars]
    times = Counter(kept)  # at most ``rows`` keys, in order
    chosen = docs.sparkSession.createDataFrame([(i, *key) for i, key in enumerate(times)], "__at int, __id long, __hash long")
    # Repeated rows are combined here and come as often as they were counted.
    found = own.join(F.broadcast(chosen), ["__id", "__hash"]).groupBy("__at").agg(F.first(F.struct("__id", "__hash", "__text", "__label")).alias("r"))
    out = [r for _, r in sorted(found.collect()) for _ in range(times[r["__id"], r["__hash"]])]
    return [r["__text"] for r in out], [r["__label"] for r in out]


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and, with ``carry``, __row: one row for each row of ``docs``."""
    model = fit(*labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def texts(batch: pa.RecordBatch) -> pa.Array:
        return batch.column(1).field(at) if carry else batch.column(1)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known.value)
        for batch in slices(it, texts):
            score = pa.array(scorer.scores([t or b"" for t in texts(batch).cast(pa.binary()).to_pylist()]))
            yield pa.record_batch([batch.column(0), score, *batch.columns[1:]][: 3 if carry else 2], names=["doc_id", "score", "__row"][: 3 if carry else 2])

    kinds = "doc_id long, score double" + (f", __row {docs.select(F.struct('*').alias('r')).schema[0].dataType.simpleString()}" if carry else "")
    # With all columns in one struct, the text goes to Python once.
    at = docs.columns.index(text_col) if carry else None
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("__row") if carry else F.col(text_col).cast("string").alias("__text"))
    scored = read.mapInArrow(batches, kinds)
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        *(["__row"] if carry else []),
    )
