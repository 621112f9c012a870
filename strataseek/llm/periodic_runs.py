"""Periodic runs of words, by Crochemore's partition refinement.

Positions are put into classes: at stage ``l``, positions share a class if the same ``l`` words begin
there. A class is split by what follows it: of the parts of a class that was split before, all but the
largest are used to split the classes of the positions in front of them (the smaller-half strategy, so each
position is handled O(log n) times). Members of a class are a linked list in the order of the text. Two
neighbours at stage ``l`` that are ``l`` apart begin a square, whose root isn't itself a repetition; squares of
one period that begin at consecutive positions are one run.

A task takes the documents of an Arrow batch in blocks of about ``BLOCK`` words and refines a block at
once: classes never span documents, and all lists are arrays, so a stage is a handful of array operations on the
positions that it moves. A run of ``exponent`` periods has at least ``exponent - 1`` members in each of
its classes, so smaller classes are dropped; no run that is asked for loses a square by it. Nothing is shuffled.

Cases: a null, empty or blank text has no words and no runs; repeated rows are treated one by one; of the
input only the id and text columns are read, so further columns may have any names; an empty table gives no rows. Very
long texts are a block of their own, whose arrays grow with the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Words that are refined together, about. A longer text is a block alone.
BLOCK = 1 << 18
#: Gaps are looked through in spans of this many stages.
SPAN = 64

RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def begins_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of the sorted keys differs from the one before it."""
    out = np.ones(len(keys[0]), bool)
    np.not_equal(keys[0][1:], keys[0][:-1], out=out[1:])
    for key in keys[1:]:
        out[1:] |= key[1:] != key[:-1]
    return out


def sizes_of(starts: np.ndarray, total: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1] = total - starts[-1]
    return out


@dataclass
class Classes:
    """Positions of a block in classes; ``link`` leads to the next member of the class, ``back`` to the one before (-1: none)."""

    of: np.ndarray
    link: np.ndarray
    back: np.ndarray
    size: np.ndarray
    used: int

    @classmethod
    def first(cls, labels: np.ndarray) -> "Classes":
        """Of factors of one word."""
        n = len(labels)
        order = np.argsort(labels, kind="stable")
        same = labels[order[1:]] == labels[order[:-1]]
        link, back = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        link[order[:-1][same]] = order[1:][same]
        back[order[1:][same]] = order[:-1][same]
        counts = np.bincount(labels, minlength=1)
        size = np.zeros(2 * n + 2, np.int64)  # a class that is split off holds a position at least; ids are reused when they run out
        size[: len(counts)] = counts
        return cls(labels.astype(np.int64), link, back, size, len(counts))

    def room(self, more: int) -> None:
        if self.used + more > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(max(more, len(self.size)), np.int64)])


def split(classes: Classes, splitters: np.ndarray, is_splitter: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """One stage. splitters: positions of the small parts; is_splitter: by class. Returns the positions of the next stage's small parts, and those whose neighbour changed."""
    before = splitters[splitters > 0] - 1
    before = before[classes.size[classes.of[before]] >= least]
    none = np.empty(0, np.int64)
    if not len(before):
        return none, none
    before.sort()
    old, by = classes.of[before], classes.of[before + 1]
    order = np.argsort(old * classes.used + by, kind="stable")
    before, old, by = before[order], old[order], by[order]
    new_group = begins_of(old, by)
    group = np.cumsum(new_group) - 1
    starts = np.flatnonzero(new_group)
    counts = sizes_of(starts, len(before))
    parent = old[starts]
    new_parent = begins_of(parent)
    first_of = np.flatnonzero(new_parent)  # the first group of each parent
    family = np.cumsum(new_parent) - 1
    parents = parent[first_of]
    taken = np.add.reduceat(counts, first_of)
    rest = classes.size[parents] - taken
    # A parent that goes over into one group as a whole isn't split.
    whole = (rest == 0) & (sizes_of(first_of, len(starts)) == 1)
    moved_group = ~whole[family]
    moved = moved_group[group]
    if not moved.any():
        return none, none
    # The largest part of each parent is none of the next splitters.
    largest = np.maximum.reduceat(counts, first_of)
    rest_is_largest = rest >= largest
    order_in = np.lexsort((-counts, family))
    biggest = np.zeros(len(starts), bool)
    biggest[order_in[begins_of(family[order_in])]] = True
    small_group = moved_group & ~(biggest & ~rest_is_largest[family])

    classes.room(int(moved_group.sum()))
    fresh = np.full(len(starts), -1, np.int64)
    fresh[moved_group] = np.arange(classes.used, classes.used + moved_group.sum())
    classes.used += int(moved_group.sum())
    # Take the moved ones out of their parents' lists: chains of neighbours that go together are bridged at once.
    out = before[moved]
    chain = out[np.argsort(old[moved] * len(classes.of) + out)]
    begins = np.ones(len(chain), bool)
    np.not_equal(classes.link[chain[:-1]], chain[1:], out=begins[1:])
    ends = np.ones(len(chain), bool)
    ends[:-1] = begins[1:]
    head, tail = chain[begins], chain[ends]
    left, right = classes.back[head], classes.link[tail]
    has_left, has_right = left >= 0, right >= 0
    classes.link[left[has_left]] = right[has_left]
    classes.back[right[has_right]] = left[has_right]
    # Their own lists: sorted by group, then position.
    own = group[moved]
    same = own[1:] == own[:-1]
    classes.link[out] = -1
    classes.back[out] = -1
    classes.link[out[:-1][same]] = out[1:][same]
    classes.back[out[1:][same]] = out[:-1][same]
    classes.of[out] = fresh[own]
    classes.size[fresh[moved_group]] = counts[moved_group]
    classes.size[parents[~whole]] = rest[~whole]

    small = out[small_group[own]]
    # A rest that isn't the largest part is a splitter too: walk to its members.
    minor = parents[~whole & ~rest_is_largest & (rest > 0)]
    if len(minor):
        small = np.concatenate([small, members(classes, minor, left[has_left], right[has_right])])
    changed = np.concatenate([out, left[has_left]])
    return small, changed


def members(classes: Classes, wanted: np.ndarray, *near: np.ndarray) -> np.ndarray:
    """All positions of the classes. Each has one among ``near`` (what stood beside a position that left), from which the list is walked both ways."""
    seeds = np.concatenate(near)
    seeds = seeds[np.isin(classes.of[seeds], wanted)]
    _, at = np.unique(classes.of[seeds], return_index=True)
    found = [seeds[at]]
    for way in (classes.link, classes.back):
        step = way[seeds[at]]
        while len(step := step[step >= 0]):
            found.append(step)
            step = way[step]
    return np.concatenate(found)


def squares(labels: np.ndarray, most: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(period, sorted positions at which a square of it begins). labels: of the words, unlike in unlike documents. most: by position, the greatest period of use."""
    classes = Classes.first(labels)
    gap = np.where(classes.link >= 0, classes.link - np.arange(len(labels)), 0)
    live = classes.size[labels] >= least
    top = int(most.max(initial=0))
    splitters = np.arange(len(labels))  # at first, all classes are parts of one
    period = 0
    near: list[np.ndarray] = []
    while period < top:
        period += 1
        if period % SPAN == 1:
            far = (gap >= period) & (gap < period + SPAN)
            near = [np.flatnonzero(far & (gap <= most))]
            if not len(near[0]) and not len(splitters):
                if not (live & (gap > period)).any():
                    return
        if sum(map(len, near)):
            waiting = near[0] if len(near) == 1 else np.concatenate(near)
            near = [waiting]
            hit = waiting[gap[waiting] == period]
            hit = hit[classes.size[classes.of[hit]] >= least]
            if len(hit):
                yield period, np.unique(hit)
        if not len(splitters):
            continue
        splitters, changed = split(classes, splitters, live, least)
        if len(changed):
            gap[changed] = np.where(classes.link[changed] >= 0, classes.link[changed] - changed, 0)
            bound = (period - 1) // SPAN * SPAN + SPAN
            soon = changed[(gap[changed] > period) & (gap[changed] <= bound) & (gap[changed] <= most[changed])]
            if len(soon):
                near.append(soon)


def block_runs(labels: np.ndarray, doc: np.ndarray, first: np.ndarray, words: np.ndarray, exponent: int, shortest: int) -> list[np.ndarray]:
    """(n, 4) arrays of document, start, length, period."""
    most = words[doc] // exponent
    found = []
    for period, at in squares(labels, most, max(2, exponent - 1)):
        begins = begins_of(at - np.arange(len(at)), doc[at])
        ends = np.ones(len(at), bool)
        ends[:-1] = begins[1:]
        start, last = at[begins], at[ends]
        length = last - start + 2 * period
        kept = length >= max(shortest, exponent * period)
        if kept.any():
            own = doc[start[kept]]
            found.append(np.stack([own, start[kept] - first[own], length[kept], np.full(kept.sum(), period)], axis=1))
    return found


def text_runs(texts: list[bytes], exponent: int = 4, shortest: int = 6) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and its runs as rows start, length, period, in the order of start, then period."""
    split_up = [t.split() for t in texts]  # of bytes: at the six ASCII white-space characters alone
    sizes = np.array([len(w) for w in split_up], np.int64)
    runs = [np.empty((0, 3), np.int64)] * len(texts)
    if not sizes.sum():
        return split_up, runs
    flat = np.empty(sizes.sum(), object)
    flat[:] = [w for own in split_up for w in own]
    codes, kinds = pd.factorize(flat)
    doc = np.repeat(np.arange(len(texts)), sizes)
    _, labels = np.unique(doc * len(kinds) + codes, return_inverse=True)
    first = np.cumsum(sizes) - sizes
    found = block_runs(labels.reshape(-1), doc, first, sizes, exponent, shortest)
    if found:
        all_runs = np.concatenate(found)
        all_runs = all_runs[np.lexsort((all_runs[:, 3], all_runs[:, 1], all_runs[:, 0]))]
        cut = np.searchsorted(all_runs[:, 0], np.arange(len(texts) + 1))
        runs = [all_runs[a:b, 1:] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return split_up, runs


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, one space between."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _blocks(texts: list[bytes], block: int) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours that have about ``block`` words together, by their lengths in bytes (a word and its blank: 6)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > 6 * block:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6, block: int = BLOCK) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and the collapsed text, of each row.

    Runs have ``shortest`` words and ``exponent`` periods (2 or more) at least and can't be longer.
    """
    if exponent < 2 or shortest < 1:
        raise ValueError("a run has two periods and a word at least")
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    out = StructType([StructField("__id", read.schema["__id"].dataType), StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _blocks(texts, block):
                words, runs = text_runs(texts[a:b], exponent, shortest)
                kept = [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
                flat = np.concatenate(runs)
                ends = np.cumsum([0, *map(len, runs)])
                each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(kept, pa.string())],
                    names=out.names,
                )

    return read.mapInArrow(batches, out).withColumnRenamed("__id", id_col)
