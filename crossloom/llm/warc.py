"""WARC archives as a PySpark Python data source.

Writing: every task writes archives named by itself and a number, and rolls to a new one at
``max_file_bytes``. The commit writes one list of the tasks that counted, with the number of their archives; the
reader passes over archives of ours that no list has, so a lost executor or a repeated task leaves no half
archive and no double record. Payloads are stored as gzip-encoded HTTP entities, while all record headers stay plain.

Reading: archives of any writer, plain (``.warc``) or in gzip members (``.warc.gz``). Partitions are groups of
whole files up to ``partition_bytes``. A record's headers are parsed
first; pushed predicates (record type and other header columns) are tested on them; the block of a
record that fails, or of any record with the option ``payload=false``, is passed over by a seek and
not decoded. Size and digest of a payload stand in our headers; of other writers' records they are taken from
the payload where a predicate or the row needs them (null with ``payload=false`` and no predicate on them).

Columns: page_id and refers_to (of our own records, else null), url, record_type, payload_bytes, payload_digest
(bare hex SHA-1), payload (entity of responses, block of resources, conversions and metadata), record_id, refers_to_id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import operator
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as D

from .common import fresh_path

SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string, refers_to_id string"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])
# Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_COMPARE: dict[type, Callable] = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}


#: Archives of ours, and lists of those that count.
_OURS, _LIST = re.compile(r"([0-9a-f]{32})-(\d+)\.warc"), "_archives-"


@dataclass
class Written(D.WriterCommitMessage):
    task: str = ""
    files: int = 0


@dataclass
class Files(D.InputPartition):
    paths: tuple[str, ...] = ()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    """The page of one of our own record ids."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _header_text(value: str) -> str:
    """Control characters cannot stand in a header; they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def encode_record(r: dict) -> bytes:
    """One record; a revisit has the headers of its HTTP response and no entity."""
    kind, http = r["record_type"], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "response":
        body = zlib.compress(r["payload"] or b"", 1, wbits=31)
        block = http + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    else:
        block = http + b"\r\n"
    digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", _uri(r["page_id"])), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(r["payload_bytes"]))]
    if r["url"] is not None:
        head.append(("WARC-Target-URI", _header_text(r["url"])))
    if kind == "revisit":
        head += [("WARC-Refers-To", _uri(r["refers_to"])), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def _headers(file) -> dict[str, str]:
    """Header lines up to the empty one; names in lower case, continuation lines joined, odd bytes as Latin-1."""
    lines: list[str] = []
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        try:
            text = line.decode().rstrip("\r\n")
        except UnicodeDecodeError:
            text = line.decode("latin-1").rstrip("\r\n")
        if text[:1] in (" ", "\t") and lines:
            lines[-1] += " " + text.strip()
        else:
            lines.append(text)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _digest(value: str) -> str | None:
    """Hex of a SHA-1 digest header in base 32 or hex; null for other algorithms and for what is no digest."""
    name, _, code = value.partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", code):
        return code.lower()
    return base64.b32decode(code.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", code) else None


def _chunks(body: bytes) -> bytes:
    """The body of a chunked transfer; as it is if it isn't one."""
    out, at = [], 0
    while found := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n").match(body, at):
        size, at = int(found[1], 16), found.end()
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return body


def entity(block: bytes) -> bytes:
    """The entity of an HTTP message, out of its transfer and content codings; codings unknown here stay."""
    found = re.search(rb"\r?\n\r?\n", block)
    http, body = (block[: found.start()].lower(), block[found.end() :]) if found else (b"", block)
    if re.search(rb"\ntransfer-encoding:\s*chunked", http):
        body = _chunks(body)
    coding = re.search(rb"\ncontent-encoding:\s*(x-gzip|gzip|deflate)\s*(\r|\n|$)", http)
    for bits in () if coding is None else (47, -15):
        try:
            return zlib.decompress(body, wbits=bits)
        except zlib.error:
            pass
    return body


def read_records(file, keep: Callable[[dict], bool], payload: bool, tested: frozenset[str] = frozenset()) -> Iterator[dict]:
    """The records of an open archive whose headers pass keep(); tested: columns that keep() looks at."""
    while line := file.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = _headers(file)
        size, kind = int(head.get("content-length") or 0), head.get("warc-type", "")
        uri = head.get("warc-target-uri")
        row = {
            "page_id": _page(head.get("warc-record-id")), "url": uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri, "record_type": kind, "refers_to": _page(head.get("warc-refers-to")),
            "payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None, "payload_digest": _digest(head.get("warc-payload-digest", "")), "payload": None,
            "record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to"),
        }
        stored = kind in ("response", "resource", "conversion", "metadata")
        unknown = [c for c in ("payload_bytes", "payload_digest") if row[c] is None]
        unsure = stored and bool(tested.intersection(unknown))
        if not stored or not (unsure or payload) or not unsure and not keep(row):
            file.seek(size, io.SEEK_CUR)
            if keep(row):
                yield row
            continue
        block = file.read(size)
        body = entity(block) if kind == "response" else block
        row["payload_bytes"] = len(body) if row["payload_bytes"] is None else row["payload_bytes"]
        row["payload_digest"] = row["payload_digest"] or hashlib.sha1(body).hexdigest()
        row["payload"] = body if payload else None
        if keep(row):
            yield row


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()) or ())
            if column == "payload" or isinstance(f, D.Not) or column not in ARROW.names:
                yield f
            elif type(f) in _COMPARE:
                self.tests.append((type(f).__name__, column, f.value))
            elif isinstance(f, D.In):
                self.tests.append(("In", column, tuple(f.value)))
            elif isinstance(f, D.IsNotNull):
                self.tests.append(("IsNotNull", column, None))
            else:
                yield f

    def keep(self, row: dict) -> bool:
        by_name = {k.__name__: v for k, v in _COMPARE.items()}
        for kind, column, value in self.tests:
            x = row[column]
            if x is None or kind == "In" and x not in value or kind in by_name and not by_name[kind](x, value):
                return False
        return True

    def partitions(self) -> list[Files]:
        files, at = pafs.FileSystem.from_uri(self.path)
        seen = [x for x in files.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)) if x.is_file]
        counted: dict[str, int] = {}
        for x in seen:
            if x.base_name.startswith(_LIST):
                with files.open_input_stream(x.path) as f:
                    counted.update((t, int(n)) for t, n in (line.split() for line in f.read().decode().splitlines()))

        def counts(name: str) -> bool:
            ours = _OURS.fullmatch(name)
            return int(ours[2]) < counted.get(ours[1], 0) if ours else name.endswith((".warc", ".warc.gz")) and name[0] not in "_."

        found = sorted((x for x in seen if counts(x.base_name)), key=lambda x: x.path)
        groups: list[list[str]] = []
        room = 0
        for x in found:
            if not groups or x.size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(x.path)
            room -= x.size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path in partition.paths:
            raw = files.open_input_file(path)
            with io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20) as file:
                for row in read_records(file, self.keep, self.payload, frozenset(c for _, c, _ in self.tests)):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.max_file_bytes = options["path"], int(options.get("max_file_bytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = pafs.FileSystem.from_uri(self.path)
        files.create_dir(at, recursive=True)
        task, n, out, size = uuid.uuid4().hex, 0, None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        out, size, n = files.open_output_stream(f"{at}/{task}-{n}.warc"), 0, n + 1
                    record = encode_record(row)
                    out.write(record)
                    size += len(record)
                    if size >= self.max_file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(task, n)

    def commit(self, messages: list[Written | None]) -> None:
        """One list in one file, under its name once it is whole; a line per task, whatever the archives' number."""
        files, at = pafs.FileSystem.from_uri(self.path)
        files.create_dir(at, recursive=True)
        name = f"{_LIST}{uuid.uuid4().hex}"
        with files.open_output_stream(f"{at}/.{name}") as out:
            out.write("".join(f"{m.task} {m.files}\n" for m in messages if m and m.files).encode())
        files.move(f"{at}/.{name}", f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, at = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for k in range(m.files if m else 0):
                files.delete_file(f"{at}/{m.task}-{k}.warc")


class WarcSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000) -> DataFrame:
    """One record per page. Of pages with equal payloads of at least least_bytes, the one with the
    largest id is the response and the others are revisits of it; smaller payloads are all responses.

    Null html is an empty payload. A null url writes no header. Rows that share the largest id are
    all responses; rows with a null id are revisits of any row with an id and an equal payload, and
    responses if there is none. Other columns are not looked at."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # Two or more rows with a digest: summed before the shuffle, so a payload that a third of all
    # pages share is one row per task; the join's one-row side is joined by broadcast where small,
    # else a hot digest's partition is split by adaptive execution.
    heads = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(heads, "payload_digest", "left")
    again = F.col("_head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_head"))
    return rows.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_head")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~again, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).option("path", path).save()


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).option("path", path).load()


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages to fresh archives in the shared folder and reads the records back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(to_records(pages, **columns), path)
    return read_warc(pages.sparkSession, path)
