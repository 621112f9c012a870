"""Token counts by ranked merges of byte pairs, with a rank table of one's choice.

A text is cut into pieces by a pattern. A piece that isn't a token itself is merged from single bytes: again and again, the pair of neighbours with the
lowest rank becomes one, the leftmost first. Candidates wait in a heap and neighbours are linked, so a piece of n bytes takes O(n log n), and lengths of pieces are kept.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Fixed value: words, numbers and signs, each with a blank before it, and runs of blanks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose lengths a worker keeps; longer ones than ``LONG`` are not kept.
KEPT, LONG = 1 << 17, 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank table: lines with a token in base 64 and its rank."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_stream(inside) as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f.read().splitlines() if line)}


_TABLES: dict[str, dict[bytes, int]] = {}


@dataclass
class BytePairs:
    """Counts tokens. ranks: a table, or the path of one, which each worker reads once; on a cluster a path that all of them see."""

    ranks: dict[bytes, int] | str
    pattern: str = PATTERN
    _lengths: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "_lengths": {}}

    def table(self) -> dict[bytes, int]:
        if isinstance(self.ranks, str):
            if self.ranks not in _TABLES:
                _TABLES[self.ranks] = read_ranks(self.ranks)
            return _TABLES[self.ranks]
        return self.ranks

    def pieces(self, text: str) -> list[str]:
        return regex.findall(self.pattern, text)

    def merged(self, piece: bytes) -> list[bytes]:
        """The tokens of a piece. A byte without a rank is one of its own."""
        table = self.table()
        if piece in table or len(piece) < 2:
            return [piece]
        n = len(piece)
        end, link, back = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int]] = []  # rank, start, end of a pair

        def offer(i: int) -> None:
            j = link[i]
            if j < n and (rank := table.get(piece[i : end[j]])) is not None:
                heapq.heappush(waiting, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            j = link[i] if end[i] else n
            if j >= n or not end[j] or end[j] != stop:  # one of the two has grown since, or is gone
                continue
            end[i], link[i], end[j] = end[j], link[j], 0
            if link[i] < n:
                back[link[i]] = i
            offer(i)
            if back[i] >= 0:
                offer(back[i])
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = link[i]
        return out

    def length(self, piece: str) -> int:
        found = self._lengths.get(piece)
        if found is None:
            found = len(self.merged(piece.encode("utf-8", "surrogatepass")))
            if len(piece) <= LONG:
                if len(self._lengths) >= KEPT:
                    self._lengths.clear()
                self._lengths[piece] = found
        return found

    def tokens(self, text: str) -> list[int]:
        """Ranks of all tokens of a text, by a table that has all single bytes."""
        table = self.table()
        return [table[t] for p in self.pieces(text) for t in self.merged(p.encode())]

    def count(self, text: str | None) -> int:
        """0 for a blank text."""
        return sum(map(self.length, self.pieces(text))) if text and not text.isspace() else 0


class Growing:
    """The number of tokens of a text that grows at its end. Only the last two pieces can change, so the rest is counted once."""

    def __init__(self, pairs: BytePairs):
        self.pairs, self.sure, self.tail, self.blank = pairs, 0, "", True

    def after(self, more: str) -> tuple[int, Growing]:
        """(tokens with ``more`` at the end, the text that has it)."""
        pieces = self.pairs.pieces(self.tail + more)
        lengths = [self.pairs.length(p) for p in pieces]
        new = Growing(self.pairs)
        new.sure, new.tail, new.blank = self.sure + sum(lengths[:-2]), "".join(pieces[-2:]), self.blank and (not more or more.isspace())
        return (0 if new.blank else self.sure + sum(lengths)), new


def with_token_count(df: DataFrame, pairs: BytePairs, *, text_col: str = "content", out: str = "token_count") -> DataFrame:
    """``df`` with the tokens of a text column, in Arrow batches. A null or blank text has 0."""
    names = [c for c in df.columns if c != out]
    read = df.select(*names, F.col(text_col).cast("string").alias("__text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts = [pairs.count(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(counts, pa.int32())], names=[*names, out])

    return read.mapInArrow(batches, StructType([*read.schema.fields[:-1], StructField(out, IntegerType())]))
