"""WARC archives as a PySpark data source: header predicates are pushed down and unwanted payloads stay undecoded."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from leafmill.llm.common import checkpoint_dir, load

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, refers_to string, payload_digest string, "
    "payload_bytes long, digest_ok boolean, headers map<string,string>, http_headers string, payload binary, file string, offset long"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "content_type", "refers_to", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
)
#: Columns that a pushed filter may test, and the WARC header each holds.
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "refers_to": "warc-refers-to"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record over an HTTP response; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(uri)}"] if uri else []
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_REVISIT}"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' tells its compressed and full length, so that readers can skip it."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes files of at most about max_bytes each. They are hidden until the whole write commits, so lost tasks leave nothing to read."""

    def __init__(self, path: str, date: str, max_bytes: int) -> None:
        self.path, self.date, self.max_bytes = path, date, max_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _files(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                if out is None:
                    names.append(f".{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                get = lambda n: col[n][i].as_py() if n in col else None  # noqa: E731, B023
                data = member(record(get("record_type"), get("record_id"), get("target_uri"), get("date") or self.date, get("payload") or b"", get("refers_to")))
                out.write(data)
                size += len(data)
                if size >= self.max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, root = _files(self.path)
        for m in messages:
            for n in m.names if m else []:
                fs.move(posixpath.join(root, n), posixpath.join(root, n[1:]))

    def abort(self, messages: list) -> None:
        fs, root = _files(self.path)
        for m in messages:
            for n in m.names if m else []:
                fs.delete_file(posixpath.join(root, n))


# ---------------------------------------------------------------- reading


@dataclass
class _Files(InputPartition):
    names: list[str]


def _headers(block: bytes) -> dict[str, str]:
    """Lower-cased names and values; folded lines join the line before."""
    out: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Plain:
    """Forward reader of an uncompressed archive: bytes as far as they are asked for, longer stretches to be skipped by a seek."""

    def __init__(self, source, name: str) -> None:
        self.source, self.name, self.data, self.at, self.more = source, name, bytearray(), 0, True
        source.seek(0)

    def offset(self) -> int:
        """Place in the file of the next byte, or of the gzip member that holds it."""
        return self.at

    def _feed(self) -> bytes:
        return self.source.read(1 << 16)

    def fill(self, n: int) -> bool:
        """Whether n bytes lie ahead; they are then in data."""
        while len(self.data) < n and self.more:
            chunk = self._feed()
            self.data += chunk
            self.more = bool(chunk)
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def blanks(self) -> None:
        """Skips the line ends between records."""
        while self.fill(1) and self.data[0] in b"\r\n":
            self.drop(1)

    def head(self) -> bytes | None:
        """The header block, whatever its length; None at the end of the archive."""
        self.blanks()
        if not self.fill(1):
            return None
        self.begun = self.offset()
        seen = 0
        while (end := self.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.data)
            if not self.fill(seen + 1):
                raise self.broken("the file ends inside a record's headers")
        out = bytes(self.data[:end])
        if not out.startswith(b"WARC/"):
            raise self.broken("no record begins here")
        self.drop(end + 4)
        return out

    def broken(self, what: str) -> ValueError:
        return ValueError(f"{self.name}, record at byte {self.begun}: {what}")

    def block(self, n: int) -> bytes:
        """The next n bytes, which stay ahead."""
        if not self.fill(n):
            raise self.broken("the file ends inside a record's block")
        return bytes(self.data[:n])

    def skip(self, n: int) -> None:
        have = len(self.data)
        if n > have:
            self.drop(have)
            self.at += n - have
            if self.at > self.source.size():
                raise self.broken("the file ends inside a record's block")
            self.source.seek(self.at)
            self.more = True
        else:
            self.drop(n)


class _Gzip(_Plain):
    """Forward reader of an archive of gzip members, of one or more records each. A member whose 'sl' field shows that it holds the one
    record only is skipped without inflating it."""

    def __init__(self, source, name: str) -> None:
        super().__init__(source, name)
        self.raw, self.raw_at, self.inflate = b"", 0, None
        self.starts: list[tuple[int, int, int, int]] = []  # first inflated byte, place in the file, packed and full length of members ahead
        self.out = 0  # inflated bytes so far

    def offset(self) -> int:
        return [s for s in self.starts if s[0] <= self.at][-1][1]

    def _feed(self) -> bytes:
        while True:
            if not self.raw:
                self.raw = self.source.read(1 << 16)
                if not self.raw:
                    if self.inflate:
                        raise ValueError(f"{self.name}: the file ends inside the gzip member at byte {self.starts[-1][1]}")
                    return b""
            if self.inflate is None:
                self.raw = self.raw if self.raw.strip(b"\0") else b""  # padding
                if not self.raw:
                    self.raw_at = self.source.tell()
                    continue
                if len(self.raw) < 24:
                    self.raw += self.source.read(24)
                packed = full = 0
                if self.raw[:4] == b"\x1f\x8b\x08\x04" and self.raw[12:14] == b"sl":
                    packed, full = struct.unpack("<II", self.raw[16:24])
                self.starts = [s for s in self.starts[:-1] if s[0] > self.at] + self.starts[-1:] + [(self.out, self.raw_at, packed, full)]
                self.inflate = zlib.decompressobj(31)
            before = len(self.raw)
            try:
                chunk = self.inflate.decompress(self.raw, 1 << 20)
            except zlib.error as e:
                raise ValueError(f"{self.name}: broken gzip member at byte {self.starts[-1][1]}: {e}") from None
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.raw_at += before - len(self.raw)
            self.out += len(chunk)
            if self.inflate.eof:
                self.inflate = None
            if chunk:
                return chunk

    def skip(self, n: int) -> None:
        first, place, packed, full = self.starts[-1]
        alone = packed and full < 0xFFFFFFFF and first <= self.at and 0 <= first + full - (self.at + n) <= 4 and self.begun == place
        if alone and n > len(self.data) and self.inflate:
            if place + packed > self.source.size():
                raise self.broken("the file ends inside its gzip member")
            self.source.seek(place + packed)
            self.data, self.raw, self.inflate, self.more = bytearray(), b"", None, True
            self.at = self.out = first + full
            self.raw_at = place + packed
            return
        while n:
            if not self.fill(1):
                raise self.broken("the file ends inside a record's block")
            step = min(n, len(self.data))
            self.drop(step)
            n -= step


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, partition_bytes: int) -> None:
        self.path, self.payload, self.partition_bytes, self.tests = path, payload, partition_bytes, []

    def pushFilters(self, filters: list[Filter]):
        """Takes tests of header columns; the rest stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADER and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, values: dict) -> bool:
        for column, kind, want in self.tests:
            v = values[column]
            if v is None or not (kind == "IsNotNull" or (kind == "EqualTo" and v == want) or (kind == "In" and v in want) or (kind == "StringStartsWith" and v.startswith(want))):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together up to partition_bytes: where a record begins inside a file can't be told for sure."""
        from pyarrow import fs as pfs

        fs, root = _files(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else [x for x in fs.get_file_info(pfs.FileSelector(root, recursive=True)) if x.is_file and not posixpath.basename(x.path).startswith((".", "_"))]
        out, size = [], 0
        for x in sorted((x for x in found if x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
            if not out or size + x.size > self.partition_bytes:
                out.append(_Files([]))
                size = 0
            out[-1].names.append(x.path)
            size += x.size
        return out or [_Files([])]

    def _records(self, name: str, fs) -> Iterator[tuple]:
        with fs.open_input_file(name) as source:
            packed = source.read(2) == b"\x1f\x8b"
            stream = (_Gzip if packed else _Plain)(source, name)
            while (head := stream.head()) is not None:
                h, offset = _headers(head), stream.begun
                if not re.fullmatch("[0-9]+", h.get("content-length", "")):
                    raise stream.broken(f"Content-Length is {h.get('content-length')!r}")
                length = int(h["content-length"])
                v = {c: h.get(k) for c, k in _HEADER.items()}
                for c in ("record_id", "refers_to"):
                    v[c] = v[c].strip("<>") if v[c] else None
                if self._wanted(v):
                    yield self._row(v, h, stream, length, name, offset)
                stream.skip(length)

    def _row(self, v: dict, h: dict, stream, length: int, name: str, offset: int) -> tuple:
        is_http = (v["content_type"] or "").startswith("application/http")
        full = self.payload == "all" or self.payload == v["record_type"]
        block = stream.block(length if full or v["record_type"] == "revisit" else min(length, 1 << 16) if is_http else 0)
        http, payload = None, block
        if is_http:
            start, _, payload = block.partition(b"\r\n\r\n")
            http = start.decode("utf-8", "replace")
        stated = (h.get("warc-payload-digest") or "").rpartition(":")[2] or None
        told = _headers(http.encode()).get("content-length") if http else None
        size = int(told) if told and told.isdigit() else None if is_http else length
        digest, ok = stated, None
        if full and v["record_type"] != "revisit":
            size, digest = len(payload), digest_of(payload)
            ok = stated is None or stated == digest
        else:
            payload = None
        return (*[v[c] for c in ("record_type", "record_id", "target_uri", "date", "content_type", "refers_to")], digest, size, ok, list(h.items()), http, payload, name, offset)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(self.path)
        rows, size = [], 0
        for name in partition.names:
            for row in self._records(name, fs):
                rows.append(row)
                size += len(row[11] or b"") + 500
                if size > 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); df.write.format("warc").mode("append").save(path).

    Read options: payload, one of all (the default), none, or a record type: only payloads of that type are decoded;
    partitionBytes (small files are read together up to it; a file is never split, since where a record begins inside one can't be told
    for sure). Members may hold several records and header blocks any length; broken or cut-off files raise an error that names the file
    and the byte. Write options: date (for rows without one), maxFileBytes. Rows to write have record_type, record_id, target_uri,
    payload, refers_to and optionally date; other columns are ignored.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "all"), int(self.options.get("partitionbytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are written once: use mode('append')")
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("maxfilebytes", 128 << 20)))


def register(spark: SparkSession) -> None:
    """Makes the format "warc" known to the session and lets Spark push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages


def _first_with_payload(rows: DataFrame, salts: int = 64) -> DataFrame:
    """rows(page_id, payload, ...) with `first`, the smallest page_id of the same payload.

    A payload that very many pages share is spread: minima are taken by (payload, salt), then by payload, and come back by
    (payload, salt), at most `salts` rows a payload.
    """
    keyed = rows.withColumn("_key", F.sha2("payload", 256)).withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    parts = keyed.groupBy("_key", "_salt").agg(F.min("page_id").alias("low"))
    firsts = parts.groupBy("_key").agg(F.min("low").alias("first"), F.collect_set("_salt").alias("s")).select("_key", F.explode("s").alias("_salt"), "first")
    return keyed.join(firsts, ["_key", "_salt"]).drop("_key", "_salt")


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a record per row of pages(page_id, url, html) to `path`; equal payloads of min_bytes or more are stored once.

    The row with the smallest page_id of a payload is a response, the others revisit it; rows with that same page_id are responses
    too. Null html counts as empty, a null url gives no target header, rows with a null page_id are responses. Other columns are
    ignored. An empty table writes no record.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    known = _first_with_payload(rows)
    again = (F.col("page_id") > F.col("first")) & (F.length("payload") >= min_bytes)
    named = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    out = known.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(named(F.col("page_id")), F.lit("urn:page:none")).alias("record_id"),
        "target_uri",
        "payload",
        F.when(again, named(F.col("first"))).alias("refers_to"),
    )
    out.write.format("warc").mode("append").save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives under path; responses are decoded and digested."""
    register(spark)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    found = spark.read.format("warc").option("payload", "response").load(path).where(F.col("record_type").isin("response", "revisit"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and reads them back; see archive_pages for nulls, repeated rows and empty tables."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(load(spark, sf_dir, "pages"), path)
    return archived_pages(spark, path)


# base32: the 160 bits of the digest in groups of five.
OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as n, sha1(html) as hex, min(page_id) over (partition by html) as first from p),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') as bits from d)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5),
    lambda j: case when bits[5 * i + j + 1] = '1' then 1 << (4 - j)::int else 0 end))::int]), '') as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from b
"""
