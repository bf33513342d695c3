"""WARC archives as a Spark data source, written with revisit records for repeated payloads.

Reading plans whole files into partitions of even size. Predicates on the record type and on headers are
pushed into the reader, which parses a record's headers first: a payload that no one asks for is never
decoded, and where the gzip member states its length (extra field ``sl``) the file is read on from its end.

Paths are URIs that pyarrow's file systems open (local, HDFS, S3, GCS), on the driver and on the executors.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import fresh_path, written

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_type string, "
    "content_length long, payload_length long, payload binary, digest_ok boolean"
)
#: Columns that come from headers of the same meaning; predicates on them are pushed down.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Each commit leaves a manifest of its own, ``_files-<id>.json``.
MANIFEST = "_files-"
PARTITION_BYTES = 64 << 20
#: A task begins another file when one is this large.
FILE_BYTES = 256 << 20
#: Bytes inflated at first, to see the headers.
HEAD = 4096


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record(kind: str, record_id: str, uri: str | None, payload: bytes, sha1: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A record of an HTTP response; a revisit has its HTTP headers alone, with the length of the payload it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", uri))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field tells its own length and that of the data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; the manifest, written at the end, lists those of the attempts that count.

    Appending adds a manifest, which also lists archives of others if none did so far. Overwriting adds one, too, and then removes the
    manifests that were there before, and their files.
    """

    def __init__(self, path: str, options: dict, overwrite: bool = False):
        self.path, self.level, self.overwrite = path, int(options.get("level", 6)), overwrite
        fs, base = pafs.FileSystem.from_uri(path)
        self.before = _manifests(fs, base)
        self.foreign = [] if overwrite or self.before else [[p[len(base) + 1 :], size] for p, size in _archives(fs, base)]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in batches:
                names = batch.schema.names
                for values in zip(*batch.columns, strict=True):
                    row = {n: v.as_py() for n, v in zip(names, values, strict=True)}
                    if out is None or size > FILE_BYTES:
                        if out:
                            out.close()
                        files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                        out, size = fs.open_output_stream(f"{base}/{files[-1][0]}", compression=None), 0
                    size += out.write(gzip_member(record(row["record_type"], row["record_id"], row["target_uri"], row["payload"] or b"", row["payload_digest"], row["refers_to"], row["date"] or DATE), self.level))
                    files[-1][1] = size
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        before = self.before if self.overwrite else []
        gone = [f"{base}/{name}" for path in before for name, _ in _listed(fs, path)]
        files = sorted([*self.foreign, *(f for m in messages if m for f in m.files)])
        with fs.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())
        for path in [*before, *gone]:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        """Files without a manifest are never read; the shared folder's owner clears them."""


# Reading


def _manifests(fs: pafs.FileSystem, base: str) -> list[str]:
    infos = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(i.path for i in infos if i.type == pafs.FileType.File and i.base_name.startswith(MANIFEST))


def _archives(fs: pafs.FileSystem, base: str) -> list[tuple[str, int]]:
    infos = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz")))


def _listed(fs: pafs.FileSystem, manifest: str) -> list:
    with fs.open_input_stream(manifest, compression=None) as file:
        return json.loads(file.read())


@dataclass
class Files(InputPartition):
    paths: list


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; the first line, a version, is left out. Folded lines continue the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Records:
    """Headers of the records of a file one by one; the block of the present one if asked for."""

    def __init__(self, file):
        self.file = file

    def __iter__(self) -> Iterator[dict[str, str]]:
        file = self.file
        while True:
            start = file.tell()
            mark = file.read(2)
            if not mark:
                return
            if mark == b"\x1f\x8b":
                yield from self._member(start)
            elif mark in (b"\r\n", b"\n\n"):
                continue
            else:
                file.seek(start)
                head = bytearray()
                while not head.endswith(b"\r\n\r\n"):
                    line = file.readline()
                    if not line:
                        raise ValueError("the file ends within the headers of a WARC record")
                    head += line
                headers = parse_headers(bytes(head[:-4]))
                length, begin = int(headers["content-length"]), file.tell()
                self.block = lambda begin=begin, length=length: (file.seek(begin), file.read(length))[1]
                yield headers
                file.seek(begin + length)

    def _member(self, start: int) -> Iterator[dict[str, str]]:
        file = self.file
        file.seek(start)
        fixed = file.read(12)
        end = None
        if fixed[3] & 4:
            extra = file.read(struct.unpack("<H", fixed[10:12])[0])
            if extra[:4] == b"sl\x08\x00":
                end = start + struct.unpack("<I", extra[4:8])[0]
        file.seek(start)
        unpack, data = zlib.decompressobj(31), bytearray()

        def more(limit: int) -> bool:
            """Inflate at least one byte more, or see the member's end."""
            before = len(data)
            while len(data) == before and not unpack.eof:
                packed = unpack.unconsumed_tail or file.read(1 << 14 if end is None else min(1 << 14, end - file.tell()))
                data.extend(unpack.decompress(packed, limit))  # without input: what zlib still holds back
                if not packed and len(data) == before and not unpack.eof:
                    raise ValueError("the file ends within a gzip member")
            return len(data) > before

        while (split := data.find(b"\r\n\r\n")) < 0 and more(HEAD):
            pass
        headers = parse_headers(bytes(data[:split]))
        whole = split + 4 + int(headers["content-length"])

        def block() -> bytes:
            while len(data) < whole and more(1 << 20):
                pass
            return bytes(data[split + 4 : whole])

        self.block = block
        yield headers
        if end is None:
            keep = data  # without a stated length the member must be inflated to find its end, in pieces that are dropped
            while not unpack.eof:
                del keep[:]
                more(1 << 20)
            end = file.tell() - len(unpack.unused_data)
        file.seek(end)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS or not isinstance(f, EqualTo | In | IsNull | IsNotNull | StringStartsWith):
                yield f
            else:
                self.tests.append((type(f).__name__, HEADERS[name], getattr(f, "value", None)))

    def partitions(self) -> list[Files]:
        fs, base = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.File:
            found = [(base, info.size)]
        elif manifests := _manifests(fs, base):
            found = sorted((f"{base}/{name}", size) for m in manifests for name, size in _listed(fs, m))
        else:
            found = _archives(fs, base)
        plan, size = [], 0
        for path, one in found:
            if not plan or size + one > self.bytes:
                plan.append(Files([]))
                size = 0
            plan[-1].paths.append(path)
            size += one
        return plan or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            own = _bare(name, headers.get(name))
            if kind == "EqualTo" and own != value or kind == "In" and own not in value or kind == "IsNull" and own is not None or kind == "IsNotNull" and own is None or kind == "StringStartsWith" and not (own or "").startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with io.BufferedReader(fs.open_input_file(path), 1 << 20) as file:
                records = _Records(file)
                for headers in records:
                    if self._wanted(headers):
                        yield self._row(headers, records)

    def _row(self, headers: dict[str, str], records: _Records) -> tuple:
        values = {c: _bare(h, headers.get(h)) for c, h in HEADERS.items()}
        length, payload, ok = int(headers["content-length"]), None, None
        size, http = length, headers.get("content-type", "").startswith("application/http")
        has_payload = values["record_type"] != "revisit"
        if http or self.payload or self.verify:
            block = records.block() if self.payload or self.verify or not has_payload else b""
            head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            if has_payload:
                payload, size = body, len(body) if block or not http else length
            else:
                size = int(parse_headers(head).get("content-length", 0))
            if self.verify and has_payload and values["payload_digest"]:
                ok = digest(payload) == values["payload_digest"]
        return (*(values[c] for c in HEADERS), length, size, payload if self.payload else None, ok)


def _bare(name: str, value: str | None) -> str | None:
    """Ids without angle brackets, digests without their algorithm."""
    if value is None:
        return None
    if name in ("warc-record-id", "warc-refers-to"):
        return value.strip("<>")
    return value.partition(":")[2] or value if name == "warc-payload-digest" else value


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload``, ``verify`` and ``partitionBytes``.

    Without ``payload`` the column is null and blocks of responses are decoded only to verify them. Then ``payload_length`` is that of
    the block. A path without archives gives no rows; a damaged record is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 6, mode: str = "append") -> None:
    """Write a record for every row, beside the archives that are there (``mode`` append) or in their place (overwrite). Of equal payloads of at least ``min_bytes``, the one with the smallest id is a response and larger ids revisit it.

    A null text is an empty payload. A null URL leaves the target out. Rows with a null id are always
    responses, and so are repeated rows of the smallest id. Records never refer to one of an earlier write. An empty table leaves an archive without records. Other columns are not read.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= min_bytes).select("id", "sha1")
    first = slim.groupBy("sha1").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha1", "first")
    again = written(slim.join(first, "sha1").where("id > first").distinct(), "revisits")  # a written table has a known size
    rows = rows.join(again, ["id", "sha1"], "left")
    urn = F.lit("urn:page:")
    rows = rows.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.concat(urn, F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record_id"),
        F.col("uri").alias("target_uri"), F.lit(DATE).alias("date"), base32("sha1").alias("payload_digest"),
        F.concat(urn, F.col("first").cast("string")).alias("refers_to"), "payload",
    )
    rows.write.format("warc").option("level", level).mode(mode).save(path)


def base32(hex_col: str):
    """Base32 of 40 hex digits: five digits make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hex_col, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = spark.read.format("warc").option("payload", "false").option("verify", "true").load(path)
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.coalesce("digest_ok", F.lit(True)).alias("digest_ok"))


QUERIES = {"op2_warc": op2_warc}
ORACLE_SQL = {
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS d, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, true AS digest_ok
FROM h"""
}
