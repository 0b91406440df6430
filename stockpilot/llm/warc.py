"""WARC archives as a PySpark data source.

Reading plans the files into partitions of bounded size, takes over predicates
on the record type and on header columns, parses a record's headers first and
skips the payloads of records that are not wanted.  Records are gzip members
of their own; the writer notes each member's length in its gzip header (field
"SL"), so that the reader seeks past a payload without inflating it.  Archives
of other writers are read too, by inflating to the record's end.

Writing gives one record per row: a response with the payload, or a revisit
that names the response with the same payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from stockpilot.llm.deploy import prepare_workers
from stockpilot.session import scratch_path

#: Bytes of a written file after which the next one is begun, and of a read partition.
FILE_BYTES, PARTITION_BYTES = 64 << 20, 64 << 20
#: Payloads from this many bytes on are written once and revisited.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that are record headers: predicates on them are decided before the payload is read.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "warc_date": "WARC-Date",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member whose header holds the member's length."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    plain = head.encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    extra = b"SL" + struct.pack("<HII", 8, (len(body) + 32) & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    start = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", len(extra)) + extra  # 10 + 2 + 12 bytes, no time
    out = start + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    return out if len(out) >> 32 == 0 else out.replace(b"SL", b"XX", 1)  # too long for the field


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names):
        super().__init__(names)
        self.names = names


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Source:
    """Buffered reads from a file at a position of its own."""

    def __init__(self, handle):
        self.handle, self.buffer, self.at, self.end = handle, b"", 0, handle.size()

    def more(self, n: int = 1 << 16) -> bytes:
        data = self.handle.read_at(min(n, self.end - self.at), self.at)
        self.at += len(data)
        return data


def records(handle, wanted, payloads: str):
    """(headers, payload length, payload or None) of each wanted record.
    ``wanted`` decides on the headers; ``payloads`` is keep, check or skip."""
    src = _Source(handle)
    while src.at < src.end:
        begin = src.at
        first = src.more(1 << 12)
        if first[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {begin}")
        length = None
        if first[3] & 4 and first[12:14] == b"SL":
            length = struct.unpack_from("<I", first, 16)[0]
        inflate = zlib.decompressobj(31)

        def more():
            if src.at >= src.end:
                raise ValueError(f"the archive ends inside the record at byte {begin}")
            return inflate.decompress(src.more())

        plain = inflate.decompress(first)
        while b"\r\n\r\n" not in plain and not inflate.eof:
            plain += more()
        head, _, block = plain.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        use = wanted(headers)
        if (not use or payloads == "skip") and length:  # past the payload, unread
            if use:
                while b"\r\n\r\n" not in block and not inflate.eof:
                    block += more()
                yield headers, _http_length(block), None
            src.at = begin + length
            continue
        parts = [block]
        while not inflate.eof:
            parts.append(more())
            if not use:
                parts.clear()
        src.at -= len(inflate.unused_data)
        if not use:
            continue
        block = b"".join(parts)[: int(headers["Content-Length"])]
        _, _, payload = block.partition(b"\r\n\r\n")
        size = _http_length(block)
        if headers.get("WARC-Type") == "response":
            if (d := headers.get("WARC-Payload-Digest")) and d != "sha1:" + digest_of(payload):
                raise ValueError(f"payload digest differs in {headers.get('WARC-Record-ID')}")
            size = len(payload)
        yield headers, size, payload if payloads == "keep" and headers.get("WARC-Type") == "response" else None


def _http_length(block: bytes) -> int | None:
    """The payload's length as the record's HTTP header gives it."""
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payload", "keep")
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "start", (f.value,)))
            else:
                yield f

    def wanted(self, headers) -> bool:
        for column, kind, values in self.tests:
            value = _value(headers, column)
            if value is None or not (value in values if kind == "in" else value.startswith(values)):
                return False
        return True

    def partitions(self):
        where, root = _open(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".warc.gz") and f.base_name[0] not in "._")
        out, some, size = [], [], 0
        for name, n in found:
            if some and size + n > self.partition_bytes:
                out.append(Files(some))
                some, size = [], 0
            some.append(name)
            size += n
        return [*out, Files(some)] if some else out or [Files([])]

    def read(self, partition):
        where, _ = _open(self.path)
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
        names = [*HEADERS, "payload_bytes", "payload"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows, size = [], 0
        for name in partition.names:
            with where.open_input_file(name) as handle:
                for headers, length, payload in records(handle, self.wanted, self.payloads):
                    rows.append((*(_value(headers, c) for c in HEADERS), length, payload))
                    size += len(payload or b"") + 256
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


def _value(headers: dict, column: str) -> str | None:
    value = headers.get(HEADERS[column])
    return value.removeprefix("sha1:") if column == "payload_digest" and value else value


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, target_uri, refers_to (null: a response), payload.

    All files of a save begin with its own number, so that it removes what its
    repeated tasks left, and nothing else; an overwriting save also removes the
    archives that were there, when it commits."""

    def __init__(self, options, overwrite: bool = False):
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex  # drawn once, on the driver

    def write(self, batches):
        where, root = _open(self.path)
        where.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                data = self._record(row)
                if out is not None and size + len(data) > self.file_bytes:
                    out.close()
                    out = None
                if out is None:
                    names.append(f"{self.job}-{uuid.uuid4().hex}.warc.gz")  # a repeated task writes other files
                    out, size = where.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def _record(self, row) -> bytes:
        payload = bytes(row["payload"])
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n"
        revisit = row["refers_to"] is not None
        headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", row["record_id"])]
        headers += [("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + digest_of(payload))]
        if row["target_uri"]:
            headers.append(("WARC-Target-URI", " ".join(row["target_uri"].split())))
        if revisit:
            headers += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE)]
        headers.append(("Content-Type", "application/http; msgtype=response"))
        return record_bytes(headers, head.encode() + (b"" if revisit else payload))

    def _settle(self, kept: set[str], own: bool):
        where, root = _open(self.path)
        for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".warc.gz") and f.base_name not in kept and (not own or f.base_name.startswith(f"{self.job}-")):
                where.delete_file(f.path)

    def commit(self, messages):
        where, root = _open(self.path)
        where.create_dir(root, recursive=True)
        self._settle({n for m in messages if m for n in m.names}, own=not self.overwrite)

    def abort(self, messages):
        self._settle(set(), own=True)


class WarcSource(DataSource):
    """Format "warc".  Options: path; payload = keep (default), check (read and
    verified, not returned) or skip (not decoded); partitionbytes; filebytes.
    An appending save adds archives to the folder, an overwriting one replaces them."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def read_warc(spark, path: str, payload: str = "keep") -> DataFrame:
    """The records of the archives below ``path``; filters on HEADERS columns
    are decided in the reader."""
    _register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def _register(spark) -> None:
    prepare_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """One record per row, with the payload in UTF-8 (null: empty).

    Of records with equal payloads of at least ``revisit_bytes`` bytes, those
    with the smallest id are responses, the others revisits of it; smaller ones
    are all responses.  A row without id is a response only if no equal row has
    an id.  Repeated rows give a record each.  An empty table gives no record."""
    spark = pages.sparkSession
    _register(spark)
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).cast("long").alias("n"),
        F.col(url_col).alias("target_uri"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    keys = rows.filter(F.octet_length("payload") >= revisit_bytes).select("n", "sha", F.octet_length("payload").alias("size"))
    groups = keys.groupBy("sha", "size").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("n").alias("ids"), F.count("*").alias("all"))
    groups = groups.filter("first != last or ids > 0 and ids < all")
    later = keys.join(groups, ["sha", "size"]).filter(~F.col("n").eqNullSafe(F.col("first")))
    later = later.select(F.col("n").alias("k"), F.col("sha").alias("k_sha"), "first").distinct()
    out = rows.join(later, rows["n"].eqNullSafe(later["k"]) & (rows["sha"] == later["k_sha"]), "left")
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), c, F.lit(">"))
    out.select(
        uri(F.coalesce("id", F.lit("none"))).alias("record_id"),
        "target_uri",
        uri(F.col("first").cast("string")).alias("refers_to"),
        "payload",
    ).write.format("warc").mode("append").save(path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    response = read_warc(spark, path, "check").filter("warc_type = 'response'")
    revisit = read_warc(spark, path, "skip").filter("warc_type = 'revisit'")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':(-?[0-9]+)>', 1) as bigint)")
    return response.unionByName(revisit).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


# base32 of a hex digest: five hex digits are four letters
ORACLE = """
with p as (
  select page_id, encode(coalesce(html, '')) as b from pages
), d as (
  select page_id, octet_length(b) as payload_bytes, sha1(b) as h from p
), f as (
  select payload_bytes, h, min(page_id) as first from d group by payload_bytes, h
)
select d.page_id, d.payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(d.h, cast(5 * (i // 4) + 1 as int), 5))::int >> cast(5 * (3 - i % 4) as int)) % 32 + 1, 1)), 'string_agg', '')
    as payload_digest,
  case when d.page_id = f.first then 'response' else 'revisit' end as record_type,
  case when d.page_id = f.first then null else f.first end as refers_to
from d join f on d.h = f.h and d.payload_bytes = f.payload_bytes
"""
