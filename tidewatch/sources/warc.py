"""Archives of responses as a data source: WARC files, read and written by Spark's Python data source interface.

One partition a file; a file is read as a stream, record by record (also where each record is a gzip member of its own), so a
task holds one record. Filters on url, host, status and try are pushed to the reader, which then skips a record's body
unread. The limits of a request hold while reading: of a body only body_cap bytes are taken from the stream and one that is
longer is BODY_TOO_LARGE; an answer that took more than timeout_ms is TIMEOUT; encoded bodies are decoded under the same cap;
neither has a body. Headers that came more than once are joined by a comma.

Rows: url (WARC-Target-URI), host, try (X-Try, 1 by default), status, location, content_type, x_robots_tag, headers, body
(binary), error (null: an answer), elapsed_ms (X-Elapsed-Ms), as operators.fetch wants them.

Defined results: records that are no responses are passed over; a response without a status line is a NETWORK_ERROR (or TIMEOUT, if it
took that long); a file
that ends inside a record gives the records before it and that one as NETWORK_ERROR; an empty file gives no rows. Files are
opened by pyarrow's file systems (file, hdfs, s3, gs), so a path must be one that these reach from every executor.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tidewatch.sources.responses import BODY_CAP, TIMEOUT_S, decoded

SCHEMA = "url string, host string, try int, status int, location string, content_type string, x_robots_tag string, headers map<string,string>, body binary, error string, elapsed_ms int"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_PUSHED = ("url", "host", "status", "try")
END = b"\r\n"


def _headers(stream: io.BufferedIOBase) -> list[tuple[str, str]] | None:
    """Header lines up to the empty one; None at the end of the stream."""
    out: list[tuple[str, str]] = []
    while True:
        line = stream.readline()
        if not line:
            return out or None
        if not line.strip():
            return out
        name, colon, value = line.decode(errors="replace").partition(":")
        out.append((name.strip().lower(), value.strip()) if colon else ("", ""))


def _joined(pairs: list[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in pairs:
        if name:
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


class _Bounded:
    """The bytes of one record and no more."""

    def __init__(self, stream: io.BufferedIOBase, n: int):
        self.stream, self.left, self.cut = stream, n, False

    def read(self, n: int) -> bytes:
        out = self.stream.read(min(n, self.left))
        self.left -= len(out)
        self.cut |= not out and self.left > 0
        return out

    def readline(self) -> bytes:
        out = self.stream.readline(self.left)
        self.left -= len(out)
        self.cut |= not out and self.left > 0
        return out

    def skip(self) -> None:
        while self.left and self.read(1 << 16):
            pass


def _host(url: str) -> str:
    return url.partition("://")[2].split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower()


def records(stream: io.BufferedIOBase, wanted=lambda row: True, body_cap: int = BODY_CAP, timeout_ms: int = 1000 * TIMEOUT_S) -> Iterator[tuple]:
    """The rows of a stream of WARC records, of which only wanted ones have their body read."""
    while True:
        first = stream.readline()
        while first in (END, b"\n"):
            first = stream.readline()
        if not first.startswith(b"WARC/"):
            return
        own = _joined(_headers(stream) or [])
        block = _Bounded(stream, int(own.get("content-length", "0")))
        if own.get("warc-type") != "response":
            block.skip()
            continue
        url = own.get("warc-target-uri", "")
        row: dict[str, Any] = dict.fromkeys(_NAMES) | {"url": url, "host": _host(url), "try": int(own.get("x-try", "1")), "elapsed_ms": int(own.get("x-elapsed-ms", "0")), "error": own.get("x-error")}
        line = block.readline().split()
        if len(line) > 1 and line[0].startswith(b"HTTP/") and line[1].isdigit():
            row["status"] = int(line[1])
            h = row["headers"] = _joined(_headers(block) or [])
            row |= {"location": h.get("location"), "content_type": h.get("content-type"), "x_robots_tag": h.get("x-robots-tag")}
        else:
            row["error"] = row["error"] or ("TIMEOUT" if row["elapsed_ms"] > timeout_ms else "NETWORK_ERROR")
        if wanted(row):
            if not row["error"] and row["elapsed_ms"] > timeout_ms:
                row["error"] = "TIMEOUT"
            if not row["error"]:
                body = io.BytesIO()
                while block.left and body.tell() <= body_cap and (part := block.read(min(1 << 16, body_cap + 1 - body.tell()))):
                    body.write(part)
                plain, outcome = decoded(body.getvalue(), row["headers"].get("content-encoding"), body_cap)
                row |= {"body": plain, "error": None if outcome == "OK" else outcome}
                if block.cut:
                    row |= {"body": None, "error": "NETWORK_ERROR"}
            yield tuple(row[n] for n in _NAMES)
        block.skip()


def record(row: dict[str, Any]) -> bytes:
    """One response as a WARC record."""
    body = row.get("body") or b""
    body = body.encode() if isinstance(body, str) else bytes(body)
    extra = row.get("headers") or {}
    named = {"location": row.get("location"), "content-type": row.get("content_type"), "x-robots-tag": row.get("x_robots_tag")}
    lines = {k: v for k, v in {**extra, **named}.items() if v is not None}
    http = b"" if row.get("status") is None else f"HTTP/1.1 {row['status']}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + END + body
    head = {"WARC-Type": "response", "WARC-Target-URI": row["url"], "X-Try": row.get("try") or 1, "X-Elapsed-Ms": row.get("elapsed_ms") or 0, "X-Error": row.get("error"), "Content-Length": len(http)}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None) + END + http + END + END


class _File(InputPartition):
    def __init__(self, path: str, wanted: list[tuple[str, list]]):
        super().__init__(path)
        self.path, self.wanted = path, wanted


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.wanted = options["path"], []
        self.cap, self.timeout = int(options.get("body_cap", BODY_CAP)), int(options.get("timeout_ms", 1000 * TIMEOUT_S))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.wanted.append((f.attribute[0], list(f.value) if isinstance(f, In) else [f.value]))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, there = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(there, recursive=True)) if files.get_file_info(there).type == fs.FileType.Directory else [files.get_file_info(there)]
        names = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")))
        return [_File(n, self.wanted) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _File):  # a folder without files
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        wanted = lambda row: all(row[c] in values for c, values in partition.wanted)
        with files.open_input_stream(partition.path, compression=None) as raw:
            stream = io.BufferedReader(raw, 1 << 16)
            yield from records(gzip.GzipFile(fileobj=stream) if partition.path.endswith(".gz") else stream, wanted, self.cap, self.timeout)


class _Written(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class _Writer(DataSourceWriter):
    """A file a task, under a name of its own until all tasks are done: a task that is tried again leaves no second copy."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, there = fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{there}/_drafts-{self.job}", recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        with files.open_output_stream(f"{there}/_drafts-{self.job}/{name}.part", compression=None) as out:
            for row in iterator:
                out.write(gzip.compress(record(row.asDict()), 1))
                n += 1
        return _Written(name, n)

    def commit(self, messages: list) -> None:
        files, there = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(there)):
                if x.is_file:
                    files.delete_file(x.path)
        kept = [m for m in messages if m is not None and m.rows]
        for m in kept:
            files.move(f"{there}/_drafts-{self.job}/{m.name}.part", f"{there}/{m.name}")
        with files.open_output_stream(f"{there}/_SUCCESS") as out:
            out.write(json.dumps({"files": len(kept), "rows": sum(m.rows for m in kept)}).encode())
        self._drop(files, there)

    def abort(self, messages: list) -> None:
        self._drop(*fs.FileSystem.from_uri(self.path))

    def _drop(self, files: fs.FileSystem, there: str) -> None:
        if files.get_file_info(f"{there}/_drafts-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{there}/_drafts-{self.job}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def read_archive(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The responses of an archive; options: body_cap, timeout_ms."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_archive(answers: DataFrame, path: str) -> None:
    """Responses (url and any of the other columns) as an archive of gzipped records, a file a task."""
    answers.sparkSession.dataSource.register(Warc)
    answers.write.format("warc").mode("overwrite").save(path)


