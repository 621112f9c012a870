"""Trees of source files as a Spark data source, format ``source_tree``, for batches and streams.

The driver lists the tree and deals supported files to partitions of about ``partition_bytes``; filters on extension, language and codebase are
pushed down, so files that they leave out aren't opened. A file is always a row: one of no bytes, one that can't be opened and one that went away
since it was listed have an ``error`` in place of content. With option ``content`` false no file is opened at all.

A stream's batch holds the files that changed after the batch before, by time, and the names of those of its last instant, so that files
of one instant are neither lost nor read twice. A file that is moved in with an older time than what has been read isn't seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from strataseek.config import CODEBASES
from strataseek.functions.encodings import with_text
from strataseek.sources.files import with_route

SCHEMA = "path string, extension string, language string, codebase string, size long, modified timestamp, content binary, error string"
EMPTY, UNREADABLE = "empty", "unreadable"
ROUTED = ("extension", "language", "codebase")


def first_routes() -> dict[str, tuple[str, str]]:
    """extension: language and codebase that own it."""
    out: dict[str, tuple[str, str]] = {}
    for name, language, extensions, *_ in CODEBASES:
        for e in extensions:
            out.setdefault(e, (language, name))
    return out


def filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or not root.startswith("file:") else "file://" + root[5:])


@dataclass(frozen=True)
class Found:
    path: str
    extension: str
    language: str
    codebase: str
    size: int
    modified: int  # microseconds


@dataclass
class Part(InputPartition):
    files: list[Found]


def listing(root: str) -> list[Found]:
    """Supported files under ``root``, by path."""
    from pyarrow import fs

    system, inside = filesystem(root)
    routes, out = first_routes(), []
    for i in system.get_file_info(fs.FileSelector(inside, recursive=True)):
        name = i.path.rpartition("/")[2]
        extension = "." + name.rpartition(".")[2].lower() if "." in name[1:] else ""
        if i.type != fs.FileType.Directory and extension in routes:
            out.append(Found(i.path, extension, *routes[extension], i.size or 0, (i.mtime_ns or 0) // 1000))
    return sorted(out, key=lambda f: f.path)


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.content = options.get("content", "true").lower() == "true"

    def parts(self, files: list[Found]) -> list[Part]:
        out: list[Part] = []
        held: list[Found] = []
        size = 0
        for f in files:
            cost = f.size + (64 << 10)  # opening a file costs about as much as reading so many bytes
            if held and size + cost > self.partition_bytes:
                out.append(Part(held))
                held, size = [], 0
            held.append(f)
            size += cost
        return [*out, Part(held)] if held or not out else out

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = filesystem(self.root)
        for f in partition.files:
            content, error = None, EMPTY if f.size == 0 else None
            if self.content:
                try:
                    with system.open_input_stream(f.path) as stream:
                        content = stream.read()
                    error = EMPTY if not content else None
                except OSError as e:
                    error = f"{UNREADABLE}: {e}"
            yield (f.path, f.extension, f.language, f.codebase, f.size, datetime.fromtimestamp(f.modified / 1e6, timezone.utc), content, error)


class TreeReader(_Reader, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ROUTED and isinstance(f, (EqualTo, In)):
                self.wanted.append((column, tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif not (column in ROUTED and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[Part]:
        return self.parts([f for f in listing(self.root) if all(getattr(f, c) in values for c, values in self.wanted)])


class TreeStreamReader(_Reader, DataSourceStreamReader):
    """An offset is the time of the last change that is covered, and the files of that instant."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1, "names": "[]"}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listing(self.root)
        until = max((f.modified for f in files), default=-1)
        return {"until": until, "names": json.dumps([f.path for f in files if f.modified == until])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, last = set(json.loads(start["names"])), set(json.loads(end["names"]))

        def of_batch(f: Found) -> bool:
            late = f.modified > start["until"] or f.modified == start["until"] and f.path not in before
            return late and (f.modified < end["until"] or f.modified == end["until"] and f.path in last)

        return self.parts([f for f in listing(self.root) if of_batch(f)])

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema: StructType) -> TreeStreamReader:  # noqa: N802
        return TreeStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def can_list(root: str) -> bool:
    """Whether the tree is in a store that this source reaches; others are scanned by Spark's own reader."""
    try:
        system, inside = filesystem(root)
        return system.get_file_info(inside).type.name == "Directory"
    except Exception:
        return False


def scan_tree(spark: SparkSession, root: str, language: str | None = None, max_files: int = 0) -> DataFrame:
    """As ``files.scan``, with a row for each supported file: error says why one has no content. Texts are decoded by the encoding that is detected, with its confidence beside them. Ordered by path components if limited."""
    register(spark)
    found = spark.read.format("source_tree").option("path", root).load()
    if language:
        found = found.where(F.col("language") == language)
    if max_files:
        found = found.orderBy(F.split("path", "/")).limit(max_files)
    read = with_text(found.select("path", "content", "error"))
    return with_route(read).where(F.col("language").isNotNull())
