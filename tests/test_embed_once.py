"""Vectors by content: calls and pauses of a provider are counted."""

import time

import pytest

from strataseek.plans import ingest as plan
from strataseek.providers import HashEmbedder


def counting(log):
    """An embedder that notes each call's texts and time in a file, as it runs in other processes (made here, so that it travels with the job)."""

    class Counting(HashEmbedder):
        def embed(self, texts, kind="document"):
            with open(self.log, "a") as f:
                f.write(f"{len(texts)} {time.time()}\n")
            return super().embed(texts, kind)

        def calls(self):
            return [(int(n), float(t)) for n, t in (line.split() for line in open(self.log))]

    own = Counting(8)
    own.log = str(log)
    return own


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, content string").repartition(3)


def test_a_text_is_embedded_once_ever(spark, tmp_path):
    own, store = counting(tmp_path / "log"), f"file://{tmp_path}/vectors"
    first = ["a b", "c", "a b", None, "", *(f"text {i}" for i in range(200))]
    want = {t or "": v for t, v in zip(first, HashEmbedder(8).embed([t or "" for t in first]), strict=True)}
    for texts, sent in ((first, 203), (first[:50], 0), ([*first, "new", "new"], 1)):
        before = sum(n for n, _ in own.calls()) if (tmp_path / "log").exists() else 0
        got = plan.embed_once(frame(spark, texts), own, store).collect()
        want |= {"new": HashEmbedder(8).embed(["new"])[0]}
        assert len(got) == len(texts) and all(r["embedding"] == pytest.approx(want[r["content"] or ""]) for r in got)
        assert sum(n for n, _ in own.calls()) - before == sent
    assert got[0].asDict().keys() == {"n", "content", "embedding"}


def test_tasks_share_the_rate(spark, tmp_path, monkeypatch):
    """Three tasks with pauses of three times the length: over the run, no more calls than one task would make."""
    monkeypatch.setattr(plan, "PAUSE", 0.3)
    own = counting(tmp_path / "log")
    began = time.time()
    assert plan.embed_once(frame(spark, [f"t{i}" for i in range(240)]), own, f"file://{tmp_path}/v", limited=True, tasks=3).count() == 240
    calls = own.calls()
    assert sum(n for n, _ in calls) == 240 and all(n <= 20 for n, _ in calls) and len(calls) <= 15
    ends = sorted(t for _, t in calls)
    assert ends[-1] - ends[0] >= 0.3 * (len(calls) - 3) * 0.9 and time.time() > began
