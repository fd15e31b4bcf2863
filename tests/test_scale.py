"""Hot groups: the tiled route must give exactly what the plain route gives."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailframe.operators import accounting as B
from trailframe.operators import filters as N
from trailframe.operators import ordered as O
from trailframe.operators import sequences as S
from trailframe.operators import tracks as K
from trailframe.operators.ordered import Ordered


def chord(a, b):
    def xyz(lat, lon):
        p, l = math.radians(lat), math.radians(lon)
        aa, bb = 6378137.0**2, 6356752.314245**2
        n = math.sqrt(aa * math.cos(p) ** 2 + bb * math.sin(p) ** 2)
        return aa * math.cos(p) / n * math.cos(l), aa * math.cos(p) / n * math.sin(l), bb * math.sin(p) / n

    return math.dist(xyz(*a), xyz(*b))


def hot_rows(seed=1, hot=400, cold=5):
    """One group with most of the rows, many of them at one instant, and small groups."""
    rng = random.Random(seed)
    rows = []
    for key, n in [("hot", hot), *[(f"c{i}", rng.randint(1, 12)) for i in range(cold)], (None, 7)]:
        for i in range(n):
            t = 100.0 if rng.random() < 0.3 else round(rng.uniform(0, 500), 1)
            value = None if rng.random() < 0.4 else rng.randint(0, 50)
            rows.append((key, len(rows), t, value, 50 + rng.uniform(0, 0.02), 8 + rng.uniform(0, 0.02)))
    return rows


SCHEMA = "k string, ord long, time double, v long, lat double, lon double"


def as_map(df, key="ord"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def test_tiles_match_plain_windows(spark):
    df = spark.createDataFrame(hot_rows(), SCHEMA)
    scans = dict(
        p1=O.prev(F.col("v")), p3=O.prev(F.col("ord"), 3), n1=O.nxt(F.col("v")), n4=O.nxt(F.col("ord"), 4),
        s=O.running_sum(F.col("v")), i=O.index(), mx=O.running_max(F.col("v")),
        lk=O.last_known(F.col("v")), lb=O.last_known(F.col("v"), False),
        nk=O.next_known(F.col("v")), nb=O.next_known(F.col("v"), False),
        t=O.group_total(F.col("v")), lo=O.group_min(F.col("time")), hi=O.group_max(F.col("time")),
    )
    plain = Ordered.of(df, ["k"], ["time", "ord"])
    tiled = Ordered.of(df, ["k"], ["time", "ord"], max_rows=30)
    assert not plain.tiled and tiled.tiled
    assert tiled.df.groupBy("k", O.TILE).count().agg(F.max("count")).head()[0] < 200
    assert as_map(plain.scan(**scans).rows()) == as_map(tiled.scan(**scans).rows())


def test_plain_scans_match_window_functions(spark):
    df = spark.createDataFrame(hot_rows(2), SCHEMA)
    w = Window.partitionBy("k").orderBy("time", "ord")
    want = df.select("ord", F.lag("v").over(w).alias("a"), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    got = Ordered.of(df, ["k"], ["time", "ord"]).scan(a=O.prev(F.col("v")), b=O.next_known(F.col("v"))).rows()
    assert as_map(want) == as_map(got.select("ord", "a", "b"))


def test_ungrouped_numbering_in_tiles(spark):
    df = spark.createDataFrame(hot_rows(3), SCHEMA)
    got = O.number_globally(df, ["time", "ord"], "n", max_rows=40)
    rows = sorted(got.collect(), key=lambda r: (r.time, r.ord))
    assert [r.n for r in rows] == list(range(len(rows)))


def brute_duplicates(rows, limit):
    out = {}
    for key in {r[0] for r in rows}:
        kept = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            dup = kept is not None and chord(kept, r[4:6]) <= limit
            out[r[1]] = dup
            if not dup:
                kept = r[4:6]
    return out


@pytest.mark.parametrize("max_rows", [None, 25])
def test_last_kept_fold_on_hot_group(spark, monkeypatch, max_rows):
    rows = hot_rows(4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("angle", F.lit(None).cast("double"))
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 10)
    if max_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", max_rows)
    got = S.mark_duplicates(df, ["k"], ["time", "ord"], 700.0, 5.0)
    try:
        assert {r.ord: r.duplicate for r in got.collect()} == brute_duplicates(rows, 700.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def holes(rows, spark):
    """Rows with null and NaN positions and headings, and a nullable integer beside them."""
    nan = float("nan")
    bad = [(None, 1.0), (1.0, None), (nan, 1.0), (1.0, nan)]
    out = []
    for i, (k, o, t, v, lat, lon) in enumerate(rows):
        lat, lon = bad[i // 7 % 4] if i % 7 == 3 else (lat, lon)
        angle = None if i % 5 == 1 else nan if i % 5 == 2 else float(i * 37 % 360)
        out.append((k, o, t, None if v is None else int(v), lat, lon, angle, None if i % 3 else 2**60 + i, nan))
    return spark.createDataFrame(out, "k string, ord long, time double, v long, lat double, lon double, angle double, big long, other double")


@pytest.mark.parametrize("batch", [7, 10_000])
def test_both_fold_routes_agree_on_holes(spark, monkeypatch, batch):
    df = holes(hot_rows(21, hot=150), spark)
    text = lambda d: sorted(str(tuple(r)) for r in d.select(*sorted(d.columns)).collect())
    runs = lambda: (
        text(S.mark_duplicates(df, ["k"], ["time", "ord"], 700.0, 60.0)),
        text(S.split_by_total(df, ["k"], ["time", "ord"], F.col("v"), 90)),
        text(K.sample_by_distance(df, ["k"], ["time", "ord"], 500.0)),
    )
    bounded = runs()
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 1)
    monkeypatch.setattr(K, "MAX_ARRAY_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        streamed = runs()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    close = lambda rows: [re.sub(r"(\d+\.\d{6})\d*", r"\1", r) for r in rows]
    for a, b in zip(bounded, streamed):
        assert close(a) == close(b)


def test_long_groups_stream(spark, monkeypatch):
    """A group's length costs time in proportion: 40,000 rows of one key in a few seconds."""
    import time

    df = spark.range(40_000).selectExpr("'a' AS k", "id AS ord", "id % 17 AS v")
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 1)
    began = time.time()
    got = {r.ord: r.part for r in S.split_by_total(df, ["k"], ["ord"], F.col("v"), 90).collect()}
    assert time.time() - began < 20
    total = part = 0
    for i in range(40_000):
        total += i % 17
        if total > 90:
            total, part = i % 17, part + 1
        assert got[i] == part


def test_bounded_and_streamed_folds_agree(spark, monkeypatch):
    rows = hot_rows(5, hot=70, cold=3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("filesize", F.col("v"))
    size = F.coalesce(F.col("filesize"), F.lit(0))
    a = {r.ord: r.part for r in S.split_by_total(df, ["k"], ["time", "ord"], size, 90).collect()}
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 5)
    b = {r.ord: r.part for r in S.split_by_total(df, ["k"], ["time", "ord"], size, 90).collect()}
    assert a == b
    k1 = {r.ord for r in K.sample_by_distance(df, ["k"], ["time", "ord"], 500.0, max_rows=500).collect()}
    monkeypatch.setattr(K, "MAX_ARRAY_ROWS", 5)
    k2 = {r.ord for r in K.sample_by_distance(df, ["k"], ["time", "ord"], 500.0).collect()}
    assert k1 == k2


def brute_interpolate(points, t):
    points = sorted(points, key=lambda p: (p[2], p[1]))
    i = next((j for j, p in enumerate(points) if p[2] >= t), len(points))
    if len(points) == 1:
        a = b = points[0]
    elif 0 < i < len(points):
        a, b = points[i - 1], points[i]
    else:
        a, b = points[:2] if i == 0 else points[-2:]
    w = 0 if a[2] == b[2] else (t - a[2]) / (b[2] - a[2])
    return a[4] + (b[4] - a[4]) * w


@pytest.mark.parametrize("max_rows", [None, 30])
def test_interpolation_with_ties(spark, max_rows):
    points, photos = hot_rows(6), [r for r in hot_rows(7, hot=120) if r[0] in ("hot", "c1", "c2", None)]
    p = spark.createDataFrame(points, SCHEMA).withColumn("alt", F.lit(1.0)).drop("v")
    c = spark.createDataFrame(photos, SCHEMA).select("k", "ord", "time")
    got = {r.ord: r for r in K.interpolate(c, p, ["k"], max_rows=max_rows).collect()}
    for key, ord_, t, *_ in photos:
        mine = [q for q in points if q[0] == key]
        assert got[ord_]["at"]["lat"] == pytest.approx(brute_interpolate(mine, t), abs=1e-9)


@pytest.mark.parametrize("max_rows", [None, 20])
def test_track_choice(spark, max_rows):
    rng = random.Random(8)
    points = [("a", i, rng.uniform(0, 100), rng.randint(0, 6)) for i in range(60)]
    photos = [("a", i, rng.uniform(-5, 110)) for i in range(40)]
    p = spark.createDataFrame(points, "k string, ord long, time double, segment_id long")
    c = spark.createDataFrame(photos, "k string, ord long, time double")
    got = {r.ord: r.segment_id for r in K.pick_track(c, p, ["k"], max_rows=max_rows).collect()}
    tracks = sorted((min(q[2] for q in points if q[3] == s), s, max(q[2] for q in points if q[3] == s)) for s in {q[3] for q in points})
    for _, ord_, t in photos:
        want = next((s for _, s, end in tracks if end >= t), tracks[-1][1])
        assert got[ord_] == want


@pytest.mark.parametrize("max_rows", [None, 15])
def test_edit_list_matches_walk(spark, max_rows):
    rng = random.Random(9)
    m = sorted((round(rng.uniform(0, 60), 2) for _ in range(80)))
    seg = [(i, rng.uniform(0, 55), rng.uniform(0.2, 6)) for i in range(8)] + [(99, -1.0, 4.5)]
    measured = spark.createDataFrame([("a", i, t) for i, t in enumerate(m)], "k string, ord long, time double")
    segments = spark.createDataFrame([("a", *s) for s in seg], "k string, seg_no long, media_time double, duration double")
    got = sorted(r.ord for r in K.apply_edit_list(measured, segments, "k", max_rows).collect())
    want, j = [], 0
    real = sorted((s[1], s[2]) for s in seg if s[1] != -1)
    for i, t in enumerate(m):
        if j >= len(real):
            break
        if t < real[j][0]:
            continue
        if t <= real[j][0] + real[j][1]:
            want.append(i)
        else:
            j += 1
    assert got == want


@pytest.mark.parametrize("max_rows", [None, 30])
def test_whiskers_are_exact(spark, max_rows):
    import statistics

    rows = hot_rows(10)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.k: r.whisker for r in N.upper_whiskers(df, ["k"], "v", "ord", max_rows).collect()}
    for key in {r[0] for r in rows}:
        v = sorted(r[3] for r in rows if r[0] == key and r[3] is not None)
        if len(v) < 2:
            assert got.get(key) is None
            continue
        half = len(v) // 2
        q1, q3 = statistics.median(v[:half]), statistics.median(v[-half:])
        assert got[key] == pytest.approx(q3 + (q3 - q1) * 1.5)


def brute_zigzag(pts, window, jump, ratio):
    if len(pts) <= window:
        return set()
    out = set()
    for i in range(window, len(pts)):
        ref, cur = pts[i - window], pts[i]
        back = chord(cur, ref)
        for j in range(i - 1, i - window, -1):
            if chord(pts[j], cur) > jump and back < chord(pts[j], ref) * ratio:
                out.add(j)
            else:
                break
    return out


@pytest.mark.parametrize("max_rows", [None, 30])
def test_zigzag_matches_walk(spark, max_rows):
    rows = hot_rows(11, hot=200)
    df = spark.createDataFrame(rows, SCHEMA)
    limits = S.Limits(zigzag_jump=600.0)
    got = {r.ord for r in S.mark_zigzag(Ordered.of(df, ["k"], ["time", "ord"], max_rows), limits).rows().filter("zigzag").collect()}
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        want |= {mine[j][1] for j in brute_zigzag([r[4:6] for r in mine], 5, 600.0, 0.8)}
    assert got == want


def capture_rows(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        folder = "f0" if rng.random() < 0.8 else f"f{rng.randint(1, 4)}"
        island = rng.random() < 0.03
        lat, lon = (0.0, 0.0) if island else (50 + i * 1e-4 + rng.uniform(0, 2e-4), 8.0)
        rows.append(
            (i, folder, f"{i:05d}.jpg", float(rng.choice([i, i, i // 7 * 7]) * 3), lat, lon,
             None if rng.random() < 0.5 else float(rng.randint(0, 359)), rng.randint(0, 30))
        )
    df = spark.createDataFrame(
        rows, "ord long, folder string, basename string, time double, lat double, lon double, angle double, filesize long"
    )
    none = {c: F.lit(None).cast(t) for c, t in dict(camera_uuid="string", make="string", model="string", width="int", height="int").items()}
    return df.withColumns(none)


LIMITS = S.Limits(max_images=25, max_bytes=150, cutoff_time=40.0, duplicate_distance=12.0, duplicate_angle=200.0, cutoff_distance=60.0, zigzag_jump=15.0, max_speed_kmh=40.0)


def test_whole_flow_in_tiles(spark):
    df = capture_rows(spark, 12)
    plain = as_map(S.clean_captures(df, LIMITS))
    tiled = as_map(S.clean_captures(df, LIMITS, max_rows=40))
    assert len(plain) == 300
    assert {r["issue"] for r in plain.values()} >= {None, "NullIslandError", "DuplicationError"}
    assert plain == tiled


def test_whole_flow_without_count_limit(spark, monkeypatch):
    """The unbounded folds agree with the in-array ones where no run reaches the limit."""
    from dataclasses import replace

    df = capture_rows(spark, 13, n=140)
    roomy = replace(LIMITS, max_images=1000)
    unlimited = replace(LIMITS, max_images=None)
    keep = ["ord", "issue", "time", "seq"]
    a = as_map(S.clean_captures(df, roomy).select(keep))
    monkeypatch.setattr(S, "MAX_ARRAY_ROWS", 5)
    b = as_map(S.clean_captures(df, unlimited).select(keep))
    assert a == b


def test_numbering_is_dense_and_conserves_rows(spark):
    df = capture_rows(spark, 14)
    out = S.process_captures(df, LIMITS).collect()
    assert len(out) == 300
    ids = {r.sequence_id for r in out if r.sequence_id is not None}
    assert ids == set(range(len(ids)))
    assert all((r.sequence_id is None) == (r.error is not None) for r in out)


def test_fingerprint_streams_long_sequences(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, f"{i:032x}") for i in range(200)], "k string, ord long, md5sum string")
    whole = {r.k: r.sequence_md5sum for r in B.fingerprints(df, "k", ["ord"]).collect()}
    streamed = {r.k: r.sequence_md5sum for r in B.fingerprints(df, "k", ["ord"], max_rows=10).collect()}
    assert whole == streamed


def test_outliers_match_greedy_merge(spark):
    rng = random.Random(15)
    rows = []
    for k in range(4):
        lat, lon, t = 50.0, 8.0, 0.0
        for i in range(60):
            t += rng.choice([1, 1, 2])
            if rng.random() < 0.12:
                lat, lon = 50 + rng.uniform(-0.05, 0.05), 8 + rng.uniform(-0.05, 0.05)
            lat += rng.uniform(0, 1e-4)
            rows.append((k, len(rows), t, lat, lon, rng.uniform(5, 60)))
    df = spark.createDataFrame(rows, "k long, ord long, time double, lat double, lon double, ground_speed double")
    got = {r.ord for r in N.mark_outliers(df, "k", ["time", "ord"]).filter("NOT outlier").collect()}
    assert got == set().union(*[greedy_keep([r for r in rows if r[0] == k]) for k in range(4)])


def whisker(values):
    import statistics

    v = sorted(values)
    half = len(v) // 2
    q1, q3 = statistics.median(v[:half]), statistics.median(v[-half:])
    return q3 + (q3 - q1) * 1.5


def greedy_keep(rows):
    """All runs in memory, every pair tried in order."""
    steps = [chord(a[3:5], b[3:5]) for a, b in zip(rows, rows[1:])]
    reach = max(30.0, whisker(steps))
    runs = [[rows[0]]]
    for step, row in zip(steps, rows[1:]):
        runs.append([row]) if step > reach else runs[-1].append(row)
    pace = whisker([r[5] for r in rows])
    owner = {}
    for left in range(len(runs)):
        owner.setdefault(left, left)
        for right in range(left + 1, len(runs)):
            a, b = runs[left][-1], runs[right][0]
            if right not in owner and b[2] > a[2] and chord(a[3:5], b[3:5]) / (b[2] - a[2]) <= pace:
                owner[right] = owner[left]
                break
    sizes = {}
    for i, run in enumerate(runs):
        sizes[owner[i]] = sizes.get(owner[i], 0) + len(run)
    best = min(sizes, key=lambda c: (-sizes[c], c))
    return {r[1] for i, run in enumerate(runs) if owner[i] == best for r in run}
