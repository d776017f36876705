"""WARC archives: a writer by Spark's text sink and a Python data source as reader.

``spark.read.format("warc")`` plans whole files as partitions, small ones
together.  A record's headers are parsed first; filters on the record type and
the other header columns are pushed down, and a record that they reject, or
whose payload nobody asked for (option ``payload``), is stepped over by its
``Content-Length`` without being read or decoded.
"""

from __future__ import annotations

import gzip
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from ..session import materialize, scratch_path
from .common import BATCH_ROWS, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URI = "urn:arbora:page:"

SCHEMA = (
    "record_type STRING, record_id STRING, refers_to STRING, target_uri STRING, date STRING, "
    "payload_digest STRING, payload_bytes BIGINT, payload BINARY"
)
# Files of a partition together, in bytes; a larger file is a partition by itself.
PARTITION_BYTES = 64 << 20
# Bytes of payloads that the reader holds before it hands them on.
HELD_BYTES = 16 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, five hexadecimal digits to four letters at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, page_id: str, payload: Column, least_bytes: int = 0) -> DataFrame:
    """``page_id, payload, payload_bytes, payload_digest, first_id`` and the rest of ``pages``.

    ``first_id`` is the smallest id of the pages with an equal payload of at
    least ``least_bytes``, null if the page is that one or there is no other.
    Only digests that occur again are joined: that table is stored first, so
    Spark sends it to all tasks if its files are small and shuffles otherwise.
    """
    known = pages.withColumn("payload", payload)
    known = known.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    known = known.withColumn("payload_digest", base32_sha1(F.col("payload")))
    again = (
        known.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(page_id).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND first_id IS NOT NULL")
        .drop("copies")
    )
    keys = ["payload_digest", "payload_bytes"]
    joined = known.join(materialize(again, "copies").df, keys, "left")
    own = F.col("first_id").eqNullSafe(F.col(page_id))
    return joined.withColumn("first_id", F.when(~own, F.col("first_id")))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _uri(url: Column) -> Column:
    """The url with blanks and control characters escaped, so that it stays one header line."""
    bad = "[\\x00-\\x20\\x7f]"
    letter = lambda c: F.when(c.rlike(bad), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    return F.when(url.rlike(bad), F.array_join(F.transform(F.split(url, ""), letter), "")).otherwise(url)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the rows of ``with_revisits`` as archives below ``path``, a record each.

    A record is one value of the text sink and the two line ends after a record
    are its separator, so the files go through Spark's own file systems and
    commit protocol.  A revisit holds the HTTP header alone, with the length of
    the payload that it leaves out.
    """
    id_of = lambda c: F.concat(F.lit(f"<{RECORD_URI}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("first_id").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    length = F.octet_length(http) + F.octet_length(body)
    record = F.concat(
        F.lit(VERSION + CRLF),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", id_of(page_id)),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _uri(F.col(url))),
        _header("WARC-Refers-To", F.when(revisit, id_of("first_id"))),
        _header("WARC-Profile", F.when(revisit, F.lit(IDENTICAL))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
        body,
    )
    pages.select(record.alias("value")).write.option("lineSep", CRLF * 2).text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _local(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI; ``file:/x`` is how Hadoop prints local paths."""
    if path.startswith("file:"):
        path = "file://" + unquote(path.removeprefix("file:")).replace("///", "/", 1)
        return pafs.LocalFileSystem(), path.removeprefix("file://")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _headers(stream) -> dict[str, str] | None:
    """The next record's header fields by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
    fields: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _columns(fields: dict[str, str]) -> dict:
    bare = lambda v: v[1:-1] if v and v[:1] == "<" else v
    digest = fields.get("warc-payload-digest")
    return {
        "record_type": fields.get("warc-type"),
        "record_id": bare(fields.get("warc-record-id")),
        "refers_to": bare(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
    }


def _accepts(row: dict, filters: list[tuple]) -> bool:
    for kind, column, value in filters:
        own = row[column]
        if own is None or (kind == "in" and own not in value) or (kind == "starts" and not own.startswith(value)):
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.wants = options.get("payload", "true").lower() != "false"
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take equality, membership, prefix and not-null on the header columns."""
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if column not in _columns({}):
                yield f
            elif isinstance(f, EqualTo):
                self.filters.append(("in", column, {f.value}))
            elif isinstance(f, In):
                self.filters.append(("in", column, set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.filters.append(("starts", column, f.value))
            elif isinstance(f, IsNotNull):
                self.filters.append(("there", column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _local(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        plan, held = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", ".")):
                if not plan or held + f.size > PARTITION_BYTES:
                    plan.append([])
                    held = 0
                plan[-1].append(prefix + f.path)
                held += f.size
        return [Files(p) for p in plan] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            for row in self._records(path):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= HELD_BYTES:
                    yield _arrow(rows)
                    rows, held = [], 0
        if rows:
            yield _arrow(rows)

    def _records(self, path: str) -> Iterator[dict]:
        system, path = _local(path)
        packed = path.endswith(".gz")
        with system.open_input_stream(path, compression=None) if packed else system.open_input_file(path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if packed else _Buffered(raw)
            while (fields := _headers(stream)) is not None:
                length = int(fields.get("content-length", 0))
                row = _columns(fields) | {"payload_bytes": None, "payload": None}
                if not _accepts(row, self.filters):
                    stream.seek(length, 1)
                    continue
                if fields.get("content-type", "").startswith("application/http"):
                    http = _http_length(stream)
                    row["payload_bytes"] = http[1]
                    length -= http[0]
                else:
                    row["payload_bytes"] = length
                if self.wants and length:
                    row["payload"] = stream.read(length)
                    row["payload_bytes"] = len(row["payload"])
                else:
                    stream.seek(length, 1)
                    row["payload"] = b"" if self.wants and row["record_type"] == "response" else None
                yield row


class _Buffered:
    """Lines, reads and forward seeks on a seekable file, a chunk at a time."""

    CHUNK = 1 << 16

    def __init__(self, raw):
        self.raw, self.held, self.at = raw, b"", 0

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            more = self.raw.read(self.CHUNK)
            self.held, self.at = self.held[self.at :] + more, 0
            if not more:
                end = len(self.held) - 1
                break
        line, self.at = self.held[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out if len(out) == n else out + self.raw.read(n - len(out))

    def seek(self, n: int, whence: int) -> None:
        there = len(self.held) - self.at
        if n <= there:
            self.at += n
        else:
            self.raw.seek(self.raw.tell() + n - there)
            self.held, self.at = b"", 0


def _http_length(stream) -> tuple[int, int | None]:
    """Bytes of the HTTP header and the length of the payload that it names."""
    size, named = 0, None
    while True:
        line = stream.readline()
        size += len(line)
        if line in (b"\r\n", b"\n", b""):
            return size, named
        if line.lower().startswith(b"content-length:"):
            named = int(line.split(b":", 1)[1])


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below ``path``: header columns, ``payload_bytes`` and the payload.

    ``payload_bytes`` of a record without its payload is the length that its
    HTTP header names.  Filters on header columns are pushed down.  With
    ``payload=False`` no payload is read and the column is null.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> str:
    """Write one record per page into a new folder below ``spark.checkpoint.dir``; returns the folder.

    Null html is an empty payload.  Equal payloads of at least ``least_bytes``
    are written once, under the smallest id; the others revisit it.  A row with
    a null id revisits like any other; if all ids of equal payloads are null, all
    are responses.  Repeated rows with the smallest id are all responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    path = scratch_path(spark, "warc")
    write_warc(with_revisits(rows, "page_id", payload, least_bytes).drop("html"), path)
    return path


def page_number(record_id: str) -> Column:
    return F.expr(f"try_cast(substring({record_id}, {len(RECORD_URI) + 1}) AS BIGINT)")
