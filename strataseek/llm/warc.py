"""WARC archives as a Spark data source, format ``warc``.

Reading. The driver lists the files and cuts them into partitions of about
``partition_bytes`` on file bounds; a big file is cut at byte offsets, and each part
starts at the first record at or after its offset, found by the record's length chain
in a small index file that the writer leaves beside each archive. Filters on
warc_type and on header columns are pushed down: a record's header is parsed first (names in any case),
and unless it passes, its block is skipped by seeking. Payloads are decoded only if
the column ``payload`` is wanted (option ``payload``, true if not set). A ``.warc.gz`` archive is one
part. warcinfo records are only read by a filter that asks for them. Archives of others have no page_id.

Writing. Each task writes archives of at most about ``archive_bytes``: a warcinfo record, then
one record per row, payload as an HTTP response body, gzipped under Content-Encoding. Files
appear under their final names only when the job commits.

``archive_pages`` writes pages with revisit records for equal payloads.

Cases: a null payload is empty; null URLs become ``urn:page:<id>``; white space and
control characters in URLs are percent-encoded; repeated rows: one is the response, the
others revisit it; an empty table writes no archive and reads as no rows; a numeric header of others that isn't a
number reads as null; a record without a length is an error, for nothing tells where the next one begins.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, WriterCommitMessage
from pyspark.sql.types import StructType

from strataseek.llm.scratch import discard, materialize

SCHEMA = "warc_type string, record_id string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Header field of each column that filters can be pushed down on.
FIELDS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "page_id": "X-Page-ID",
    "payload_bytes": "X-Payload-Length",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "X-Refers-To-Page-ID",
}
NUMBERS = {"page_id", "payload_bytes", "refers_to"}
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs


def filesystem(path: str):
    """(file system, path inside) of a URI or a local path, by pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(number: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{number}')}>"


def clean_uri(uri: str | None, number: object) -> str:
    if not uri:
        return f"urn:page:{number}"
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


# ---------------------------------------------------------------- records


def make_record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_head(f) -> dict[str, str] | None:
    """Header fields of the record that begins here, by their names in lower case; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def whole_number(value: str | None) -> int | None:
    """The number of a header field; None if there is none, as in archives of others."""
    return int(value) if value is not None and re.fullmatch(r"[0-9]{1,18}|-[0-9]{1,18}", value) else None


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (size := int(body[at:end].split(b";")[0] or b"0", 16)):
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response; the block as it is if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        body = unchunked(body)
    return gzip.decompress(body) if re.search(rb"(?im)^content-encoding:\s*(?:x-)?gzip\s*$", head) else body


# ---------------------------------------------------------------- filters


@dataclass(frozen=True)
class Test:
    """A pushed-down predicate on one header column."""

    column: str
    kind: str
    value: object

    def passes(self, fields: dict[str, str]) -> bool:
        found: object = fields.get(FIELDS[self.column].lower())
        if found is None:
            return False
        if self.column in NUMBERS:
            found = whole_number(found)  # type: ignore[arg-type]
            if found is None:
                return False
        elif self.column == "payload_digest":
            found = str(found).removeprefix("sha1:")
        if self.kind == "in":
            return found in self.value  # type: ignore[operator]
        if self.kind == "from":
            return found >= self.value  # type: ignore[operator]
        if self.kind == "below":
            return found < self.value  # type: ignore[operator]
        return True


def as_test(f: Filter) -> Test | None:
    column = getattr(f, "attribute", ("",))[0]
    if column not in FIELDS or len(f.attribute) != 1:
        return None
    if isinstance(f, EqualTo):
        return Test(column, "in", (f.value,))
    if isinstance(f, In):
        return Test(column, "in", tuple(f.value))
    if isinstance(f, GreaterThanOrEqual):
        return Test(column, "from", f.value)
    if isinstance(f, LessThan):
        return Test(column, "below", f.value)
    if isinstance(f, IsNotNull):
        return Test(column, "present", None)
    return None


# ---------------------------------------------------------------- source


@dataclass
class Part(InputPartition):
    """Records of a file whose first byte lies in [start, end)."""

    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            test = as_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Part]:
        """Bounds are taken from the index beside an archive; an archive without one is one part."""
        from pyarrow import fs

        system, root = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        sizes = {i.path: i.size for i in found if i.is_file}
        parts = []
        for path in sorted(p for p in sizes if p.endswith((".warc", ".warc.gz"))):
            bounds = [0, sizes[path]]
            if path.endswith(".warc") and sizes[path] > self.partition_bytes and f"{path}.idx" in sizes:
                with system.open_input_stream(f"{path}.idx") as f:
                    marks = json.loads(f.read())
                bounds = [0]
                for at in marks:
                    if at - bounds[-1] >= self.partition_bytes:
                        bounds.append(at)
                bounds.append(sizes[path])
            parts += [Part(path, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = filesystem(self.path)
        infos = any(t.column == "warc_type" and t.kind == "in" and "warcinfo" in t.value for t in self.tests)
        packed = partition.path.endswith(".gz")
        with system.open_input_file(partition.path) as raw:
            f = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 16)  # type: ignore[arg-type]
            f.seek(partition.start)
            while (packed or f.tell() < partition.end) and (fields := read_head(f)) is not None:
                kind, length = fields.get("warc-type", ""), whole_number(fields.get("content-length"))
                if length is None:  # where it ends can't be known
                    raise ValueError(f"{partition.path}: a record without a length")
                if kind == "warcinfo" and not infos or not all(t.passes(fields) for t in self.tests):
                    f.seek(length, io.SEEK_CUR)
                    continue
                payload = None
                if self.payload and kind == "response":
                    payload = http_payload(f.read(length))
                else:
                    f.seek(length, io.SEEK_CUR)
                number = lambda name: whole_number(fields.get(name.lower()))  # noqa: B023, E731
                yield (
                    kind,
                    fields.get("warc-record-id"),
                    fields.get("warc-target-uri"),
                    fields.get("warc-date"),
                    number("X-Page-ID"),
                    number("X-Payload-Length"),
                    fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    number("X-Refers-To-Page-ID"),
                    payload,
                )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Rows: record_type, page_id, url, date, refers_to, payload."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.archive_bytes = int(options.get("archive_bytes", 512 << 20))
        self.mark_bytes = int(options.get("mark_bytes", 1 << 20))
        self.level = int(options.get("gzip_level", 3))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = filesystem(self.path)
        system.create_dir(f"{root}/_{self.job}", recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        files: list[str] = []
        out, at, marks = None, 0, []
        try:
            for row in iterator:
                if out is None or at >= self.archive_bytes:
                    self._close(system, root, files, out, marks)
                    files.append(f"{name}-{len(files):04d}.warc")
                    out, marks = system.open_output_stream(f"{root}/_{self.job}/{files[-1]}"), []
                    info = {"WARC-Type": "warcinfo", "WARC-Date": EPOCH, "WARC-Record-ID": record_id(files[-1]), "Content-Type": "application/warc-fields"}
                    out.write(info := make_record(info, b"format: WARC File Format 1.1\r\n"))
                    at = len(info)
                    marks.append(at)
                if at - marks[-1] >= self.mark_bytes:
                    marks.append(at)
                record = self._record(row)
                out.write(record)
                at += len(record)
        finally:
            self._close(system, root, files, out, marks)
        return Written(files)

    def _close(self, system, root: str, files: list[str], out, marks: list[int]) -> None:
        if out is not None:
            out.close()
            with system.open_output_stream(f"{root}/_{self.job}/{files[-1]}.idx") as f:
                f.write(json.dumps(marks).encode())

    def _record(self, row) -> bytes:
        payload = bytes(row["payload"] or b"")
        headers: dict[str, object] = {
            "WARC-Type": row["record_type"],
            "WARC-Date": row["date"] or EPOCH,
            "WARC-Record-ID": record_id(row["page_id"]),
            "WARC-Target-URI": clean_uri(row["url"], row["page_id"]),
            "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
            "X-Payload-Length": len(payload),
        }
        if row["page_id"] is not None:
            headers["X-Page-ID"] = row["page_id"]
        if row["record_type"] == "revisit":
            headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers_to"])}
            if row["refers_to"] is not None:
                headers["X-Refers-To-Page-ID"] = row["refers_to"]
            return make_record(headers, b"")
        body = gzip.compress(payload, self.level, mtime=0)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        return make_record(headers | {"Content-Type": "application/http; msgtype=response"}, http + body)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = filesystem(self.path)
        kept = {name for m in messages if m for name in m.files}
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.is_file and info.path.endswith((".warc", ".warc.idx")):
                    system.delete_file(info.path)
        for name in sorted(kept):
            system.move(f"{root}/_{self.job}/{name}.idx", f"{root}/{name}.idx")
            system.move(f"{root}/_{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_{self.job}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write one record per row under ``path``. Of equal payloads of ``min_bytes`` or more, the one with the largest id is the response.

    Rows get a number and are written once, so that it is the same wherever it is looked at. Owners are found on digests alone (combined
    before the shuffle) and are a table of those that occur twice, whose size decides whether payloads are shuffled to meet it.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.xxhash64(F.col(url_col).cast("string")).alias("tie"),
        (F.octet_length(payload) >= min_bytes).alias("may_own"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "pages")
    key = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("low"), "tie", "row")
    owners = (
        rows.where("may_own")
        .groupBy(F.col("digest").alias("owned"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("owner"), F.max_by("page_id", key).alias("owner_id"))
        .where("n > 1")
    )
    owners = materialize(owners, "owners")
    revisit = F.col("owner").isNotNull() & F.col("may_own") & (F.col("owner.row") != F.col("row"))
    out = rows.join(owners, F.col("digest") == F.col("owned"), "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "url",
        F.lit(None).cast("string").alias("date"),
        F.when(revisit, F.col("owner_id")).alias("refers_to"),
        "payload",
    )
    out.write.format("warc").mode("append").option("path", path).save()
    discard(rows)
    discard(owners)


def read_archives(spark, path: str, *, payload: bool = True) -> DataFrame:
    """The records under ``path``, columns as in SCHEMA."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
