"""Archives: round trips, revisits, pushed filters, files of other writers."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.cases import stored
from trailframe.llm import warc
from trailframe.llm.store import list_files

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("payload", T.StringType())])
BIG = "é<p>" * 60
ROWS = [
    (1, "http://a/1", "same" * 30, "x"), (2, None, "same" * 30, "x"), (2, "http://a/2", "same" * 30, "x"), (None, "http://a/n", "same" * 30, "x"),
    (3, "http://a/3", "short", "x"), (4, "http://a/4", "short", "x"), (5, "u\r\nX: y", None, "x"), (6, "", "", "x"), (7, "http://a/7", BIG * 9000, "x"),
    (None, None, "only null id" * 20, "x"), (None, None, "only null id" * 20, "x"), (-9, "http://a/m", BIG, "x"), (8, "http://a/8", BIG, "x"),
]


def expected(rows):
    first = {}
    for n, (i, _, h) in enumerate(rows):
        h = (h or "").encode()
        if len(h) >= 100:
            first[h] = min(first.get(h, (True, 0, n)), (i is None, i or 0, n)) if h in first else (i is None, i or 0, n)
    out = []
    for n, (i, _, h) in enumerate(rows):
        h = (h or "").encode()
        again = h in first and first[h][2] != n
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", (None if first[h][0] else first[h][1]) if again else None))
    return out


def key(r):
    return [(v is not None, v) for v in r]


def rows_of(spark, path):
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    got = warc.read_warc(spark, path).select(page(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")), "payload").collect()
    for r in got:
        if r[3] == "response":
            assert len(r[5]) == r[1] and hashlib.sha256(r[5]).hexdigest() == r[2]
    return sorted((tuple(r)[:5] for r in got), key=key)


def test_round_trip_of_awkward_pages(spark, tmp_path):
    df = stored(spark, ROWS, str(tmp_path / "t"), SCHEMA)
    warc.write_warc(df, str(tmp_path / "w"))
    assert rows_of(spark, str(tmp_path / "w")) == sorted(expected([r[:3] for r in ROWS]), key=key)


def test_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op3_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key)
    assert got == sorted(expected([(r["page_id"], r["url"], r["html"]) for r in df.collect()]), key=key)


def test_empty(spark, tmp_path):
    warc.write_warc(stored(spark, [], str(tmp_path / "t"), SCHEMA), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    warc.write_warc(stored(spark, ROWS, str(tmp_path / "t"), SCHEMA), str(tmp_path / "w"))
    df = warc.read_warc(spark, str(tmp_path / "w")).filter("record_type = 'revisit'")
    assert df.count() == 5
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("offset",), 3), warc.StringStartsWith(("target_uri",), "http://a/3")]))
    assert len(rest) == 1
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["urn:x-page:3"] and rows[0]["payload"] == b"short"


def test_other_files(spark, tmp_path):
    """Plain files, and gzip members without lengths, by another writer."""
    os.makedirs(tmp_path / "w")
    record = lambda i, body: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:%d>\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)
    bodies = [b"one", b"", b"three\r\n\r\n" * 3000, b"four"]
    (tmp_path / "w/a.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)))
    (tmp_path / "w/b.warc.gz").write_bytes(b"".join(gzip.compress(record(10 + i, b)) for i, b in enumerate(bodies)))
    assert len(list_files(str(tmp_path / "w"), ".gz")) == 1
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, f"file:{tmp_path}/w").collect()}
    assert got == {f"urn:r:{10 * k + i}": b for k in (0, 1) for i, b in enumerate(bodies)}
    assert warc.read_warc(spark, str(tmp_path / "w"), payload=False).filter("record_id = 'urn:r:12'").first()["payload_bytes"] == len(bodies[2])


def test_shared_payload_can_be_split(spark, tmp_path, monkeypatch):
    """The join by digest takes no partitioning from an aggregate, which adaptive execution could not split."""
    plans, plain = {}, warc.materialize

    def materialize(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, label)

    monkeypatch.setattr(warc, "materialize", materialize)
    warc.write_warc(stored(spark, ROWS, str(tmp_path / "t"), SCHEMA), str(tmp_path / "w"))
    assert "Join" in plans["warc-revisits"] and "Aggregate" not in plans["warc-revisits"]


def test_damaged_payload(spark, tmp_path, monkeypatch):
    """Bytes that aren't those of the headers don't pass as what the headers say."""
    plain = warc.write_warc

    def write(df, path):
        plain(df, path)
        for name, _ in list_files(path, ".gz"):
            with gzip.open(name) as f:
                data = f.read()
            os.remove(name)
            with open(name.removesuffix(".gz"), "wb") as f:
                f.write(data.replace(b"short", b"shirt"))

    os.makedirs(tmp_path / "sf")
    stored(spark, ROWS, str(tmp_path / "sf/pages.parquet"), SCHEMA)
    monkeypatch.setattr(warc, "scratch_path", lambda spark, label: str(tmp_path / "w"))
    monkeypatch.setattr(warc, "write_warc", write)
    with pytest.raises(Exception, match="payload differs from its headers"):
        warc.op3_warc(spark, str(tmp_path / "sf")).collect()
