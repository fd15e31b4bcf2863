"""Quality rules and mixing against plain Python."""

import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ROWS, SCHEMA, awkward, stored
from trailframe.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)
    )


def check_quality(df, rows):
    got = quality.quality_rules(df).collect()
    seen = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    want = Counter()
    for i, text in rows:
        c = counts(text)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert seen == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_quality_awkward(spark, tmp_path):
    check_quality(awkward(spark, str(tmp_path / "t")), [(r[0], r[1]) for r in ROWS])


def test_quality_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_quality(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_bad_host_loses_its_documents(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "short", "en", "bad", 1) for i in range(200)] + [(200, good, "en", "bad", 1)]
    rows += [(1000 + i, good + f" {i}", "en", f"h{i % 9}", 1) for i in range(900)] + [(5000, "short", "en", "tiny", 1), (5001, good, "en", "tiny", 1)]
    got = {r["doc_id"]: r for r in quality.quality_rules(stored(spark, rows, str(tmp_path / "t"))).collect()}
    assert not got[200]["kept"] and not got[200]["base_failed"]
    assert got[5001]["kept"] and got[1000]["kept"]


def test_hosts_of_any_size_are_judged(spark, tmp_path):
    """Where many hosts are bad the prior is wide, and few documents suffice; where none is, a small host is no outlier."""
    good = " ".join(f"word{i}" for i in range(80))
    hosts = [(f"g{h}", n, 0) for h, n in enumerate([3, 5, 40, 300] * 4)] + [(f"b{h}", n, n) for h, n in enumerate([5, 19, 40, 300])] + [("half", 60, 24)]
    rows = [(len(name) * 1000 + i, "short" if i < bad else f"{good} {i}", "en", name, 1) for name, n, bad in hosts for i in range(n)]
    df = stored(spark, rows, str(tmp_path / "t"))
    counted = quality.text_counts(df.select("source", "text"), "text").selectExpr("source", "n_words < 50 AS base_failed")
    found = {r["source"]: r["host_rejected"] for r in quality.host_verdicts(counted, "source").collect()}
    assert found == {name: name.startswith("b") for name, _, _ in hosts}
    calm = [(i, "short" if i % 300 == 0 or i >= 3000 else f"{good} {i}", "en", f"g{i % 10}" if i < 3000 else "tiny", 1) for i in range(3002)]
    kept = quality.quality_rules(stored(spark, calm, str(tmp_path / "u")))
    assert kept.filter("NOT kept AND NOT base_failed").count() == 0


def test_quality_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    got = quality.op10_quality_rules(spark, SF)
    want = duckdb.sql(quality.SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty_tables(spark, tmp_path):
    df = stored(spark, [], str(tmp_path / "t"))
    assert quality.quality_rules(df).count() == 0
    assert mixing.mix_sources(df).count() == 0


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def check_mix(df):
    got = mixing.mix_sources(df).collect()
    assert len(got) == df.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        rate = want[r["source"]] / max(1, sizes[r["source"]])
        assert int(rate - 1e-9) <= r["copies"] <= int(rate + 1)
        assert r["copies"] <= 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    return sorted((r["id"] or -1, r["copies"]) for r in got)


def test_mix_table_and_rerun(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_mix(df) == check_mix(df.repartition(5).sortWithinPartitions("doc_id").checkpoint())


def test_mix_agrees_in_another_split(spark, tmp_path):
    """Null and repeated ids, equal rows among them: chance doesn't depend on how the scan is split."""
    rows = [(None if i % 2 else i % 50, f"w{i % 300} " * (1 + i % 5), "en", "a" if i % 3 else None, 1) for i in range(3000)]
    spark.createDataFrame(rows, SCHEMA).repartition(12).write.parquet(str(tmp_path / "t"))
    found = []
    for split in ("12", "2"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", split)
        got = mixing.mix_sources(spark.read.schema(SCHEMA).parquet(str(tmp_path / "t")).select("doc_id", "text", "source"))
        found.append(sorted((str(r["id"]), r["source"] or "", r["size"], r["copies"]) for r in got.collect()))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert found[0] == found[1] and len(found[0]) == 3000


def test_mix_one_id_on_many_rows(spark, tmp_path):
    """Blocks split rows that share an id, equal ones too."""
    rows = [(1, "w w w" if i % 2 else f"w {i}", "en", "a" if i % 3 else "b", 1) for i in range(30_000)]
    df = stored(spark, rows, str(tmp_path / "t"))
    began = time.time()
    check_mix(df)
    one = time.time() - began
    began = time.time()
    check_mix(df.withColumn("doc_id", F.monotonically_increasing_id()))
    assert one < 3 * (time.time() - began) + 10


def test_mix_awkward(spark, tmp_path):
    check_mix(awkward(spark, str(tmp_path / "t")))


def test_mix_rounds_fairly(spark, tmp_path):
    """Expected copies come out on average, and deep trees keep the total."""
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else "b", 1) for i in range(6000)]
    df = stored(spark, rows, str(tmp_path / "t"))
    check_mix(df)
    got = mixing.mix_sources(df).collect()
    for size in range(1, 8):
        mine = [r["copies"] for r in got if r["size"] == size and r["source"] == "b"]
        rate = next(r["target"] / r["source_size"] for r in got if r["source"] == "b")
        assert abs(sum(mine) / len(mine) - rate) < 0.12
