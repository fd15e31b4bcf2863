"""Web archives (WARC 1.1) as a Spark data source.

Files hold one gzip member per record. A member's gzip header says in its
``sl`` extra field how long the member is, packed and unpacked, so a reader
unpacks the record's headers, judges them, and passes over a payload that
nobody asked for without unpacking it. Files without that field, and plain
``.warc`` files, are read too.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from trailframe.llm.base import query, table
from trailframe.llm.rows import keyed, pick
from trailframe.llm.store import list_files, open_store
from trailframe.runtime import materialize, scratch_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "payload_bytes bigint, refers_to string, content_type string, file string, offset bigint, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# Columns that a record's own headers fill, and so can refuse it before its payload is unpacked.
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
# Bytes unpacked at first; headers that are longer are unpacked on.
HEAD = 4096
CRLF = b"\r\n"


def pack_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose header tells its packed and unpacked length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    # A record over 4 GB can't say its length; zero means "unpack to find out".
    if max(total, len(data)) > 0xFFFFFFFF:
        extra = b"sl" + struct.pack("<HII", 8, 0, 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """Header values are one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(row) -> bytes:
    """A WARC record of a row with the columns of ``SCHEMA`` (file and offset aside)."""
    payload = bytes(row["payload"] or b"")
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (
        _clean(row["content_type"] or "text/html; charset=utf-8").encode(),
        row["payload_bytes"] if row["payload_bytes"] is not None else len(payload),
    )
    block = http if revisit else http + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>")]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", row["target_uri"]))
    head.append(("WARC-Date", row["date"] or "1970-01-01T00:00:00Z"))
    if row["payload_digest"] is not None:
        head.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if row["refers_to"] is not None:
            head.append(("WARC-Refers-To", f"<{row['refers_to']}>"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF + CRLF


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.roll = int(options.get("rollBytes", 256 << 20))
        self.level = int(options.get("level", 1))
        self.packed = str(options.get("compression", "gzip")).lower() != "none"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Files get hidden names; only the driver's commit shows them, so a lost task leaves nothing behind to read."""
        store, where = open_store(self.path)
        store.create_dir(where, recursive=True)
        suffix = ".warc.gz" if self.packed else ".warc"
        files, out, held = [], None, 0
        for row in rows:
            if out is None:
                name = f"{uuid.uuid4().hex}{suffix}"
                files.append(name)
                out, held = store.open_output_stream(f"{where}/.{name}", compression=None), 0
            data = record_bytes(row)
            data = pack_member(data, self.level) if self.packed else data
            out.write(data)
            held += len(data)
            if held >= self.roll:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, where = open_store(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{where}/.{name}", f"{where}/{name}")

    def abort(self, messages: list) -> None:
        store, where = open_store(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.delete_file(f"{where}/.{name}")


@dataclass
class Files(InputPartition):
    files: list

    def __init__(self, files: list):
        self.files = files


class WarcReader(DataSourceReader):
    """Options: ``payload`` (false leaves payloads packed and null), ``partitionBytes``."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.size = int(options.get("partitionBytes", 64 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list):  # noqa: N802
        """Take filters on record type and headers; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together; a large file is a partition of its own."""
        groups, held = [[]], 0
        for path, size in list_files(self.path, ".gz") + list_files(self.path, ".warc"):
            if groups[-1] and held + size > self.size:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups]

    def wanted(self, head: dict) -> bool:
        for column, how, values in self.tests:
            value = head_value(head, column)
            if value is None or not (value in values if how == "in" else value.startswith(values)):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.files:
            store, where = open_store(path)
            with store.open_input_file(where) as f:
                for offset, head, http, body in records(f, self.wanted, self.payload):
                    rows.append(self.row(path, offset, head, http, body))
                    held += len(body or b"") + 300
                    if held > 8 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def row(self, path: str, offset: int, head: dict, http: dict, body: bytes | None) -> tuple:
        length = http.get("content-length", "")
        values = [head_value(head, c) for c in COLUMNS[:5]]
        return (
            *values, int(length) if length.isdigit() else None, head_value(head, "refers_to"),
            http.get("content-type"), path, offset, body,
        )

    def batch(self, rows: list) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in zip(COLUMNS, columns)], COLUMNS)


def head_value(head: dict, column: str) -> str | None:
    value = head.get(HEADER_OF[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha256:") if column == "payload_digest" else value


def parse_head(data: bytes) -> tuple[dict, int] | None:
    """Headers (names in lower case) and where they end; None if they go on."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def records(f, wanted, payload: bool) -> Iterator[tuple[int, dict, dict, bytes | None]]:
    """(offset, headers, HTTP headers, payload) of the wanted records of one open file."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        first = f.read(HEAD)
        if first[:2] != b"\x1f\x8b":
            at = yield from _plain(f, at, first, wanted, payload)
            continue
        total, start = 0, 10
        if first[3] & 4:
            length = struct.unpack_from("<H", first, 10)[0]
            if first[12:14] == b"sl":
                total = struct.unpack_from("<I", first, 16)[0]
            start = 12 + length
        # Other gzip flags (name, comment) are left to zlib.
        simple = first[3] in (0, 4)
        opener = zlib.decompressobj(-15 if simple else 31)
        chunk, data = first[start:] if simple else first, b""
        head = None
        while head is None or parse_http(data, head) is None:
            data += opener.decompress(opener.unconsumed_tail + chunk, HEAD)
            chunk = b""
            head = head or parse_head(data)
            if head is not None and not wanted(head[0]):
                break
            if opener.eof:
                break
            if not opener.unconsumed_tail:
                chunk = f.read(1 << 16)
                if not chunk:
                    break
        if head is None:
            raise ValueError(f"no WARC headers at {at}")
        keep = wanted(head[0])
        if not total or (keep and payload):
            parts = [data]
            while not opener.eof:
                more = opener.unconsumed_tail or f.read(1 << 20)
                if not more:
                    break
                parts.append(opener.decompress(more))
            data = b"".join(parts)
            # What follows the member: 8 bytes of checksum, unless zlib took them.
            total = total or f.tell() - len(opener.unused_data) - at + (8 if simple else 0)
        if keep:
            http, body_at = parse_http(data, head) or ({}, head[1])
            end = head[1] + int(head[0].get("content-length", 0))
            body = data[body_at:end] if payload else None
            yield at, head[0], http, body
        at += total


def parse_http(data: bytes, head: tuple[dict, int]) -> tuple[dict, int] | None:
    """HTTP headers of the record's block and where its body starts; other blocks are all body."""
    fields, start = head
    if not fields.get("content-type", "").startswith("application/http"):
        return {"content-length": fields.get("content-length", ""), "content-type": fields.get("content-type")}, start
    found = parse_head(data[start:])
    return found and (found[0], start + found[1])


def _plain(f, at: int, first: bytes, wanted, payload: bool):
    data = first
    while (head := parse_head(data)) is None:
        more = f.read(HEAD)
        if not more:
            return f.size()  # trailing bytes, no record
        data += more
    length = int(head[0].get("content-length", 0))
    end = head[1] + length
    if wanted(head[0]):
        need = end if payload else min(end, head[1] + HEAD)
        data += f.read(max(0, need - len(data)))
        while (http := parse_http(data[:end], head)) is None and len(data) < end:
            data += f.read(min(HEAD, end - len(data)))
        fields, body_at = http or ({}, head[1])
        yield at, head[0], fields, data[body_at:end] if payload else None
    return at + end + 4


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100
) -> None:
    """Archive pages, one record a row.

    Of rows with equal payloads of at least ``least`` bytes, the one with the
    smallest id is a ``response``; the others are ``revisit`` records that refer
    to it and hold no payload. Null html is an empty payload; a null address has
    no header; null ids count as largest, and of rows that share the smallest id
    one is the response. Record ids are ``urn:x-page:ID``. An empty table writes
    no file.
    """
    register(df.sparkSession)
    rows = keyed(pick(df, id=id_col, url=url_col, html=html_col), "key")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sums = materialize(
        rows.select("key", "id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")), "warc-sums"
    )
    # Written, so that the join's own exchange carries the rows and a payload that a third of the pages share can be split.
    firsts = materialize(
        sums.filter(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.count("*").alias("uses"))
        .filter("uses > 1")
        .select("digest", "first"),
        "warc-firsts",
    )
    revisits = materialize(
        sums.join(firsts, "digest").filter("key <> first.key").select("key", F.col("first.id").alias("of")), "warc-revisits"
    )
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    joined = rows.join(revisits.withColumn("again", F.lit(True)), "key", "left")
    again = F.col("again").isNotNull()
    joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.sha2(body, 256).alias("payload_digest"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.when(again, urn("of")).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("bigint").alias("offset"),
        F.when(~again, body).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def checked(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits, ``payload_bytes`` and ``payload_digest`` of responses taken from the payload's bytes.

    A response whose bytes aren't those of its headers is an error. Revisits hold
    no payload: their headers are read, payloads stay packed.
    """
    found = read_warc(spark, path).filter(F.col("record_type") == "response")
    size, digest = F.octet_length("payload").cast("bigint"), F.sha2("payload", 256)
    same = size.eqNullSafe(F.col("payload_bytes")) & digest.eqNullSafe(F.col("payload_digest"))
    damaged = F.raise_error(F.concat(F.lit("payload differs from its headers: "), F.coalesce("record_id", F.lit("")))).cast("string")
    responses = found.withColumns({"payload_bytes": size, "payload_digest": F.when(same, digest).otherwise(damaged)})
    revisits = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    return responses.unionByName(revisits)


@query("op3_warc")
def op3_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    return checked(spark, path).select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )
