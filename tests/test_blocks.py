"""Folds of large groups in blocks: the same rows as a plain walk, few rows folded twice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_scale import brute_duplicates, chord, hot_rows
from trailframe.operators import blocks
from trailframe.operators import filters as N
from trailframe.operators import sequences as S
from trailframe.operators import tracks as K


def totals(rows, limit, carry):
    """Part numbers by walking every group's (key, order, amount) rows."""
    out = {}
    for key in {r[0] for r in rows}:
        total, part = 0, 0
        for i, (_, order, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            v = v or 0
            over = total + v > limit
            part += 1 if over and i else 0
            total = (v if carry else 0) if over else total + v
            out[order] = part
    return out


AMOUNTS = {
    "mixed": lambda rng: rng.choice([None, 0, 0, 3, 7, 20, 49, 50, 51, 120]),
    "constant": lambda rng: 10,
    "zeros": lambda rng: 0,
    "large": lambda rng: rng.choice([60, 0, 1]),
    "past doubles": lambda rng: rng.choice([2**54 + 1, 1, 2**53]),
}


@pytest.mark.parametrize("kind", AMOUNTS)
@pytest.mark.parametrize("carry", [True, False])
def test_running_totals(spark, monkeypatch, kind, carry):
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 9)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = random.Random(11)
    rows = [(k, o, AMOUNTS[kind](rng)) for k, o in [("hot", i) for i in range(300)] + [(None, 300 + i) for i in range(40)] + [("c", 400 + i) for i in range(9)]]
    df = spark.createDataFrame(rows, "k string, ord long, v long").repartition(3)
    limit = 2**55 + 1 if kind == "past doubles" else 50
    got = S.split_by_total(df, ["k"], ["ord"], F.col("v"), limit, carry=carry)
    assert got.columns == ["k", "ord", "v", "part"] and dict(got.dtypes)["part"] == "int"
    assert {r.ord: r.part for r in got.collect()} == totals(rows, limit, carry)


def test_last_kept_in_many_blocks(spark, monkeypatch):
    """A hot group in 18 blocks equals the walk, and most of it is folded once."""
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 100)
    monkeypatch.setattr(blocks, "BLOCK", 100)
    monkeypatch.setattr(blocks, "STRIDE", 10)
    rows = hot_rows(5, hot=1_800)
    df = spark.createDataFrame(rows, "k string, ord long, time double, v long, lat double, lon double").withColumn("angle", F.lit(None).cast("double"))
    report = {}
    got = S.mark_duplicates(df, ["k"], ["time", "ord"], 700.0, 5.0, report=report)
    assert {r.ord: r.duplicate for r in got.collect()} == brute_duplicates(rows, 700.0)
    assert report["rows"] == 1_800 and report["rounds"] <= 4
    assert 0 < report["again"] < 900


def test_blocks_that_never_agree(spark, monkeypatch):
    """Even spacing: every way through a block keeps other rows, so the rounds follow the group; the rows are right."""
    monkeypatch.setattr(K, "MAX_ARRAY_ROWS", 5)
    monkeypatch.setattr(blocks, "BLOCK", 10)
    rows = [("a", i, 50.0 + i * 1e-4, 8.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ord long, lat double, lon double")
    bounded = K.sample_by_distance(df, ["k"], ["ord"], 30.0, max_rows=5)
    report = {}
    got = K.sample_by_distance(df, ["k"], ["ord"], 30.0, report=report)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bounded.collect()))
    assert report["rounds"] >= 2


def greedy_merge(runs, speed):
    """Every run in turn takes the first later free run that it reaches."""
    cluster = [None] * len(runs)
    for i, (_, (t1, x1, y1)) in enumerate(runs):
        cluster[i] = i if cluster[i] is None else cluster[i]
        for j in range(i + 1, len(runs)):
            (t0, x0, y0), _ = runs[j]
            if cluster[j] is None and abs(t0 - t1) > 0 and chord((x0, y0), (x1, y1)) / abs(t0 - t1) <= speed:
                cluster[j] = cluster[i]
                break
    return cluster


def test_runs_merge_in_blocks(spark, monkeypatch):
    """One track's runs over many blocks: the greedy merge, whatever lies in the blocks before."""
    monkeypatch.setattr(N, "MAX_RUNS", 30)
    monkeypatch.setattr(blocks, "BLOCK", 20)
    rng = random.Random(13)
    rows, want = [], {}
    for track, n in (("hot", 240), ("mid", 45), ("cold", 20)):
        runs, t = [], 0.0
        for _ in range(n):
            # Places in two towns and on the way, some at one instant.
            t += rng.choice([0, 1, 5, 30, 400])
            lat = rng.choice([50.0, 50.0, 50.001, 50.4, 51.0])
            runs.append(((t, lat, 8.0), (t + 0.5, lat + 1e-4, 8.0)))
            t += 0.5
        want |= {(track, i): c for i, c in enumerate(greedy_merge(runs, 30.0))}
        rows += [(track, i, 1, 30.0, (a, b, c), (d, e, f)) for i, ((a, b, c), (d, e, f)) in enumerate(runs)]
    place = "struct<time:double,lat:double,lon:double>"
    df = spark.createDataFrame(rows, f"track string, run long, n long, max_speed double, head {place}, tail {place}")
    report = {}
    got = N.merge_runs(df, "track", report=report).collect()
    assert {(r.track, r.run): r.cluster for r in got} == want
    assert len({c for (t, _), c in want.items() if t == "hot"}) > 3 and report["rounds"] < 12


def test_empty(spark):
    df = spark.createDataFrame([], "k string, ord long, v long")
    assert S.split_by_total(df, ["k"], ["ord"], F.col("v"), 5).count() == 0
