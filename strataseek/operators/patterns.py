"""Many patterns at once: which of them a text holds, in one pass over it.

An automaton over all patterns (Aho and Corasick): a trie whose nodes know where to go on when the text leaves the trie, and the nearest pattern that
ends where a node does. Patterns go in blocks of bounded size, each of which is held by every task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strataseek.scratch import materialize

#: Characters of one block of patterns together.
BLOCK_CHARS = 1 << 21


class Automaton:
    def __init__(self, patterns: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.back, self.ends, self.nearest = [0], [-1], [-1]
        self.patterns = patterns
        self.always = [i for i, p in enumerate(patterns) if not p]
        for number, pattern in enumerate(patterns):
            at = 0
            for c in pattern:
                at = self.next[at].setdefault(c, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    self.back.append(0)
                    self.ends.append(-1)
                    self.nearest.append(-1)
            if at:
                self.ends[at] = number
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for c, child in self.next[at].items():
                way = self.back[at]
                while way and c not in self.next[way]:
                    way = self.back[way]
                self.back[child] = self.next[way].get(c, 0)
                waiting.append(child)
            # The next node, on the way back, at which a pattern ends.
            self.nearest[at] = self.back[at] if self.ends[self.back[at]] >= 0 else self.nearest[self.back[at]]

    def found(self, text: str) -> set[int]:
        """Numbers of the patterns in ``text``; an empty one is in every text."""
        out, at = set(self.always), 0
        for c in text:
            while at and c not in self.next[at]:
                at = self.back[at]
            at = self.next[at].get(c, 0)
            node = at if self.ends[at] >= 0 else self.nearest[at]
            while node > 0:
                out.add(self.ends[node])
                node = self.nearest[node]
        return out


def _pass(patterns: list[str], names: list[str]) -> Callable:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        for batch in it:
            hits = [sorted(automaton.found(t)) if t is not None else [] for t in batch.column(len(names)).to_pylist()]
            kept = batch.take(pa.array([i for i, own in enumerate(hits) for _ in own], pa.int64()))
            yield pa.record_batch([*kept.columns[:-1], pa.array([patterns[k] for own in hits for k in own], pa.string())], names=[*names, "pattern"])

    return batches


def blocks_of(patterns: DataFrame) -> Iterator[list[str]]:
    """The different values of column pattern in lists of at most about ``BLOCK_CHARS`` characters."""
    held: list[str] = []
    size = 0
    for (p,) in patterns.where("pattern IS NOT NULL").select("pattern").distinct().toLocalIterator():
        if held and size + len(p) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p) + 1
    if held:
        yield held


def holding(texts: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """``texts`` without its text but with pattern: a row for each pattern of ``patterns`` (column pattern) that the text holds. A null text holds none."""
    names = [c for c in texts.columns if c not in (text_col, "pattern")]
    read = texts.select(*names, F.col(text_col).alias("__text"))
    schema = StructType([*read.schema.fields[:-1], StructField("pattern", StringType())])
    out = texts.sparkSession.createDataFrame([], schema)
    for block in blocks_of(patterns):
        out = out.unionByName(materialize(read.mapInArrow(_pass(block, names), schema), "held-patterns"))
    return out
