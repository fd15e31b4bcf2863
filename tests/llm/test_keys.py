"""Row keys while executors come and go: scans are split otherwise from plan to plan."""

import itertools
from collections import Counter

import corpus_pipeline as pipe
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from tests.llm.cases import SCHEMA
from tests.llm.test_suffix import expected, result
from trailframe.llm.exact import exact_dedup
from trailframe.llm.warc import read_warc, write_warc

TEXTS = [f"{i % 40} " + f"text {i % 40} of forty " * 15 for i in range(240)]
SPLITS = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def docs(spark, tmp_path, monkeypatch):
    """240 rows in 12 files; every table that is written changes how the next scan is split."""
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(12).write.parquet(str(tmp_path / "t"))
    plain, cores = DataFrameWriter.parquet, itertools.cycle(["2", "5", "3"])

    def parquet(self, *args, **more):
        plain(self, *args, **more)
        spark.conf.set(SPLITS, next(cores))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.set(SPLITS, "12")
    yield spark.read.schema(SCHEMA).parquet(str(tmp_path / "t"))
    spark.conf.unset(SPLITS)


def test_exact(docs):
    got = exact_dedup(docs).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == [(i, 200 + i % 40, 6, i >= 200) for i in range(240)]


def test_suffix(docs):
    assert result(docs, 200, 64) == expected(list(enumerate(TEXTS)), 200)


def test_warc(spark, docs, tmp_path):
    write_warc(docs, str(tmp_path / "w"), "doc_id", "source", "text")
    got = read_warc(spark, str(tmp_path / "w")).select("record_id", "record_type", "refers_to").collect()
    urn = "urn:x-page:{}".format
    assert Counter(map(tuple, got)) == Counter((urn(i), "revisit" if i >= 40 else "response", urn(i % 40) if i >= 40 else None) for i in range(240))


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_pipeline(spark, docs, stage):
    left = getattr(pipe, stage)(spark, docs, "").collect()
    assert Counter(r["text"] for r in left) == Counter(TEXTS[:40])


def test_mixed(spark, docs):
    plain = pipe.mix_sources(docs).select("id", "copies").collect()
    taken = Counter(r["doc_id"] for r in pipe.mixed(spark, docs, "").collect())
    assert taken == Counter({r["id"]: r["copies"] for r in plain if r["copies"]})
