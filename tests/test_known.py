"""Cases with known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trailframe.functions import geo, nmea
from trailframe.functions import records as R
from trailframe.functions import timeparse as P
from trailframe.operators import accounting as B
from trailframe.operators import filters as N
from trailframe.operators import sequences as S
from trailframe.operators import telemetry as M
from trailframe.operators import tracks as K
from trailframe.operators.fold import split_runs
from trailframe.operators.ordered import Ordered


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_distances(spark):
    rows = [(42.1, -11.1, 42.2, -11.3), (0.0, 0.0, 90.0, 180.0), (0.0, 0.0, 90.0, 0.0), (0.0, -180.0, 0.0, 180.0)]
    d = geo.gps_distance(*[F.col(c) for c in "abcd"])
    got = [round(v[0], 3) for v in values(spark, rows, "a double, b double, c double, d double", d)]
    assert got == [19916.286, 9004939.288, 9004939.288, 0.0]


def test_bearings(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, -1.0, 0.0), (0.0, 0.0, 0.0, -1.0), (0.0, 179.0, 0.0, -179.0)]
    b = geo.bearing(*[F.col(c) for c in "abcd"])
    got = [round(v[0], 6) for v in values(spark, rows, "a double, b double, c double, d double", b)]
    assert got == [0, 0, 90, 180, 270, 90]


def test_instant_pair_is_infinitely_fast(spark):
    assert value(spark, geo.point_speed(F.lit(0.0), F.lit(1.0), F.lit(1.0))) == math.inf


def captures(spark, rows, **extra):
    """Rows of (time, lat, lon[, angle]) in one folder, with the columns the flow needs."""
    full = [(i, "f", f"{i:04d}.jpg", float(r[0]), float(r[1]), float(r[2]), r[3] if len(r) > 3 else None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "ord long, folder string, basename string, time double, lat double, lon double, angle double")
    base = {"camera_uuid": None, "make": None, "model": None, "width": None, "height": None, "filesize": 0}
    kinds = {"width": "int", "height": "int", "filesize": "long"}
    return df.withColumns({k: F.lit(extra.get(k, v)).cast(kinds.get(k, "string")) for k, v in base.items()})


def test_heading_fill(spark):
    square = [(0, 0, 0, None), (1, 0, 1, 1.0), (2, 1, 1, 2.0), (3, 1, 0, None), (4, 0, 0, None)]
    rows = S.fill_headings(Ordered.of(captures(spark, square), ["folder"], ["time"])).rows()
    got = [round(r.angle, 2) for r in rows.orderBy("time").collect()]
    assert got == [90, 1, 2, 180, 180]


def test_interpolation_between_two_points(spark):
    p = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("a", 1, 2.0, 0.0, 2.0)], "k string, ord long, time double, lat double, lon double")
    c = spark.createDataFrame([("a", 0, 1.5)], "k string, ord long, time double")
    at = K.interpolate(c, p.withColumn("alt", F.lit(None).cast("double")), ["k"]).head()["at"]
    assert (at.lat, at.lon, at.alt) == (1.0, 2.5, None)
    assert at.angle == pytest.approx(206.572033, abs=1e-6)


def test_single_point_track_is_constant(spark):
    p = spark.createDataFrame([("a", 0, 5.0, 2.0, 3.0, 9.0)], "k string, ord long, time double, lat double, lon double, alt double")
    c = spark.createDataFrame([("a", 0, 1.5), ("a", 1, 50.0)], "k string, ord long, time double")
    assert {(r["at"].lat, r["at"].lon) for r in K.interpolate(c, p, ["k"]).collect()} == {(2.0, 3.0)}


def test_down_sampling(spark):
    rows = [("a", i, v, v) for i, v in enumerate([1.0, 1.0, 1.1, 1.1, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "k string, ord long, lat double, lon double")
    assert sorted(r.ord for r in K.sample_by_distance(df, ["k"], ["ord"], 100_000).collect()) == [0, 4]


@pytest.mark.parametrize(
    "data, want", [([7, 7, 31, 31, 47, 75, 87, 115, 116, 119, 119, 155, 177], 251), ([1, 2], 3.5), ([1, 2, 3], 6), ([5], None)]
)
def test_whisker(spark, data, want):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(data)], "k string, i long, v double")
    assert N.upper_whiskers(df, ["k"], "v", "i").head().whisker == want


def repaired(spark, times):
    df = captures(spark, [(t, 0, 0) for t in times]).withColumn("_sort", F.col("time"))
    out = S.repair_subseconds(Ordered.of(df, ["folder"], ["_sort", "basename"])).rows()
    return [r.time for r in out.orderBy("_sort", "basename").collect()]


def test_time_repair(spark):
    assert [round(t, 6) for t in repaired(spark, [1, 1, 1, 1, 1, 2])] == [1, 1.2, 1.4, 1.6, 1.8, 2]
    assert [int(t * 10) / 10 for t in repaired(spark, [0, 1, 1, 1, 2])] == [0, 1, 1.3, 1.6, 2]
    assert repaired(spark, [1.1]) == [1.1]


def sequences(spark, rows, limits, **extra):
    out = S.clean_captures(captures(spark, rows, **extra), limits).collect()
    return len({r.seq for r in out if r.seq is not None}), {r.ord: r.issue for r in out if r.issue}


LOOSE = S.Limits(cutoff_distance=1e9, cutoff_time=1e9, duplicate_distance=-1.0, max_speed_kmh=1e9)


def test_count_and_time_splits(spark):
    from dataclasses import replace

    line = lambda n: [(i, i * 1e-5, 0) for i in range(n)]
    assert sequences(spark, line(1000), LOOSE)[0] == 1
    assert sequences(spark, line(1001), LOOSE)[0] == 2
    assert sequences(spark, [(1, 0, 1), (600, 0, 2), (601, 0, 3)], replace(LOOSE, cutoff_time=60.0))[0] == 2


def test_byte_split(spark):
    df = captures(spark, [(1, 0, 1), (2, 0, 2), (3, 0, 3)]).withColumn(
        "filesize", F.when(F.col("ord") == 0, 110 * 1024**3).otherwise(1)
    )
    out = S.clean_captures(df, LOOSE).collect()
    assert len({r.seq for r in out}) == 2


def test_null_island_and_speed(spark):
    from dataclasses import replace

    count, issues = sequences(spark, [(1, 1, 1), (2, 0, 0), (3, 1.1, 1)], LOOSE)
    assert (count, issues) == (1, {1: "NullIslandError"})
    _, fast = sequences(spark, [(1, 0.01, 1), (2, 0.02, 1)], replace(LOOSE, max_speed_kmh=400.0))
    assert fast == {0: "CaptureSpeedTooFastError", 1: "CaptureSpeedTooFastError"}


def test_equal_times_are_not_too_fast(spark):
    rows = Ordered.of(captures(spark, [(1, 0, 1), (1, 0, 2)]), ["folder"], ["time", "ord"])
    assert not any(r.too_fast for r in S.mark_too_fast(rows, 1.0).rows().collect())


def test_stateful_splitter(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 3, 4, 1, 2])], "k string, i long, v long")
    step = lambda s, r: (F.when(s + r["v"] > 5, r["v"]).otherwise(s + r["v"]), s + r["v"] > 5)
    runs = split_runs(df, ["k"], ["i"], F.lit(0), "bigint", step)
    assert [r.run for r in runs.orderBy("i").collect()] == [0, 0, 1, 2, 2, 3]


def test_edit_list(spark):
    m = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.1, 0.29, 0.31, 0.6])], "k string, ord long, time double")
    e = spark.createDataFrame([("a", 0, -1.0, 4.4), ("a", 1, 0.24, 0.3)], "k string, seg_no long, media_time double, duration double")
    assert sorted(round(r.time, 2) for r in K.apply_edit_list(m, e, "k").collect()) == [4.69, 4.71]


LINES = [
    ("a", 0, "[1623057074211]$GPGGA,202530.00,5109.0262,N,11401.8407,W,5,40,0.5,1097.36,M,-17.00,M,18,TSTR*61"),
    ("b", 0, "[1629874404069]$GNGGA,175322.00,3244.53126,N,11710.97811,W,1,12,0.84,17.4,M,-34.0,M,,*45"),
    ("c", 0, "[1629874404069]$GNGLL,4404.14012,N,12118.85993,W,001037.00,A,A*67"),
    ("d", 0, "[1629874404069]$GNRMC,001031.00,A,4404.13993,N,12118.86023,W,0.146,,100117,,,A*7B"),
    ("e", 0, "[1623057074211]$GPVTG,,T,,M,0.078,N,0.144,K,D*28[1623057075215]"),
    ("f", 0, "[1623057074211]$GPGGA,202530.00,5109.0262,N,11401.8407,W,5,40,0.5,1097.36,M,-17.00,M,18,TSTR*62"),
]


def test_dashcam_points(spark):
    df = spark.createDataFrame(LINES, "file string, ord long, line string")
    got = {r.file: (r.time, round(r.lat, 6), round(r.lon, 6), r.alt, r.fix) for r in M.log_points(M.read_log(df), "file").collect()}
    assert got == {
        "a": (1623097530.0, 51.150437, -114.030678, 1097.36, 3),
        "b": (1629914002.0, 32.742188, -117.182969, 17.4, 3),
        "c": (1629850237.0, 44.069002, -121.314332, None, None),
        "d": (1484007031.0, 44.068999, -121.314337, None, None),
    }


def test_checksum(spark):
    assert value(spark, nmea.checksum(F.lit("GNGLL,4404.14012,N,12118.85993,W,001037.00,A,A"))) == 0x67


def test_datetime_texts(spark):
    read = lambda text: value(spark, P.as_unix_time(P.parse_gps_datetime(F.lit(text))))
    assert read("2021:08:02 07:57:06") == 1627891026.0
    assert read("2022-06-10T17:35:52.269367Z") == pytest.approx(1654882552.269367)
    assert read("2021-07-15T15:37:30+10:00") == 1626327450.0
    assert read("2021:07:15 24:00:00") == 1626393600.0
    assert read("2021:07:15") is None and read("2021-13-40 10:00:00") is None
    camera = P.parse_camera_datetime(F.lit("2021:10:10 17:29:54"), F.lit("124 junk"), F.lit("-02:00"))
    assert value(spark, P.as_unix_time(camera)) == pytest.approx(1633894194.124)
    far = P.parse_camera_datetime(F.lit("2021:10:10 17:29:54"), None, F.lit("+24:00"))
    assert value(spark, P.as_unix_time(far)) == 1633886994.0


def test_coordinates(spark):
    read = lambda text, ref=None: value(spark, P.parse_coordinate(F.lit(text), F.lit(ref).cast("string")))
    assert read("33,18.32N") == pytest.approx(33.305333, abs=1e-6)
    assert read("44,24.54W") == pytest.approx(-44.409, abs=1e-6)
    assert read("33.5", "S") == -33.5 and read("33.5", "X") is None and read("x") is None


def test_capture_time_text(spark):
    text = R.format_capture_time(F.lit(1626327450.0127))
    assert value(spark, text) == "2021_07_15_05_37_30_012"
    assert value(spark, R.parse_capture_time(F.lit("2021_07_15_05_37_30_012"))) == 1626327450.012
    assert value(spark, R.parse_capture_time(F.lit("2021_17_15_05_37_30_012"))) is None


def test_empty_upload_summary(spark):
    ddl = "sequence_image_count long, entity_size long, upload_first_offset long, upload_total_time double"
    row = B.upload_summary(spark.createDataFrame([], ddl)).head()
    assert (row.images, row.sequences, row["size"], row.speed) == (0, 0, 0.0, 0.0)


def test_errors_stop_the_job(spark):
    df = spark.range(3).select(F.when(F.col("id") == 0, R.error(R.DUPLICATION, "x")).alias("error"))
    B.raise_on_errors(df)
    worse = df.unionByName(spark.range(1).select(R.error(R.ZIGZAG, "x").alias("error")))
    B.raise_on_errors(worse, skip_all=True)
    with pytest.raises(RuntimeError):
        B.raise_on_errors(worse)


def test_history_keeps_numeric_prefixes(spark, tmp_path):
    """Prefixes that look like numbers stay text."""
    from trailframe.sources import writers

    digests = ["07" + "a" * 30, "12" + "b" * 30, "00" + "c" * 30]
    stored = spark.createDataFrame([(d, i) for i, d in enumerate(digests)], "sequence_md5sum string, n int")
    writers.append_history(stored, str(tmp_path / "h"))
    found = writers.lookup_history(spark, str(tmp_path / "h"), stored.select("sequence_md5sum"))
    assert {r.sequence_md5sum for r in found.collect()} == set(digests)


def test_large_files_hash_as_small_ones(spark, tmp_path, monkeypatch):
    import hashlib

    from trailframe.sources import readers

    for i, size in enumerate((1, 10, 100_000)):
        (tmp_path / f"f{i}").write_bytes(bytes(range(256)) * size)
    want = {str(tmp_path / f"f{i}"): hashlib.md5(bytes(range(256)) * size).hexdigest() for i, size in enumerate((1, 10, 100_000))}
    monkeypatch.setattr(readers, "WHOLE_FILE", 2000)
    assert {r.path: r.md5sum for r in readers.hash_files(spark, [str(tmp_path)]).collect()} == want


def test_fingerprints_without_some_digests(spark):
    """A member without a digest adds nothing on either way, for long and usual sequences side by side."""
    from trailframe.operators import accounting

    rows = [("long", i, f"{i:032x}" if i % 4 else None) for i in range(50)] + [("short", i, "ab" if i else None) for i in range(3)] + [(None, 0, "cd")]
    df = spark.createDataFrame(rows, "k string, ord long, md5sum string")
    one, two = ({r.k: r.sequence_md5sum for r in accounting.fingerprints(df, "k", ["ord"], max_rows=n).collect()} for n in (1000, 10))
    assert one == two and len(one) == 3


def test_manifest_of_any_length(spark):
    import json

    from trailframe.operators import accounting

    df = spark.range(30_000).selectExpr("1 AS k", "id AS ord", "concat('h', id) AS handle")
    row = accounting.manifests(df, "k", ["ord"]).first()
    assert json.loads(row.manifest)["image_handles"] == [f"h{i}" for i in range(30_000)] and row.n_images == 30_000


def test_tool_xml_is_read_as_xml(spark, tmp_path):
    """Entities, CDATA, comments, nested and empty elements."""
    from trailframe.sources import readers

    (tmp_path / "a.xml").write_text(
        "<?xml version='1.0'?>\n<rdf:RDF xmlns:rdf='r'>\n"
        "<rdf:Description rdf:about='/x/a.jpg'><A:One>Caf&#233; &amp; co</A:One><!-- <A:No>1</A:No> --><A:Two><![CDATA[<5>]]></A:Two>"
        "<A:List><rdf:li>x</rdf:li></A:List><A:None/></rdf:Description>\n"
        "<!-- <rdf:Description rdf:about='/x/b.jpg'><A:One>no</A:One></rdf:Description> -->\n"
        "<rdf:Description rdf:about='/x/c.jpg'><A:One>c</A:One></rdf:Description>\n</rdf:RDF>"
    )
    rows = {(r.path, r.tag): r.text for r in readers.read_descriptions(spark, str(tmp_path)).collect()}
    assert rows == {
        ("/x/a.jpg", "A:One"): "Café & co", ("/x/a.jpg", "A:Two"): "<5>", ("/x/a.jpg", "A:List"): None,
        ("/x/a.jpg", "A:None"): None, ("/x/c.jpg", "A:One"): "c",
    }


def test_video_rules(spark):
    from trailframe.functions import records as R
    from trailframe.operators import accounting
    from pyspark.sql import functions as F

    good = [1.0, 2.0, 3.0, None, None]
    rows = [("a", "gopro", [good]), ("b", "image", [good]), ("c", "video", None), ("d", "video", [[1.0, 2.0]]), ("e", "camm", [[1.0, None, 3.0, 1.0, 1.0]]), ("f", "video", [[1.0, 200.0, 3.0, 1.0, 1.0, 5.0]]), ("g", "video", [])]
    df = spark.createDataFrame(rows, "filename string, filetype string, track array<array<double>>").withColumn("error", R.no_error())
    got = {r.filename: r.e for r in accounting.validate_videos(df).select("filename", F.col("error.message").alias("e")).collect()}
    assert got["a"] is None and got["g"] is None and all(got[k] for k in "bcdef") and len({got[k] for k in "bcdef"}) == 5


def test_find_media(spark, tmp_path):
    """Each kind by its extension; hidden files stay out; each path comes once."""
    from trailframe.sources import readers

    for name in ("a.jpg", "b.JPG", "c.mp4", "d.xml", ".e.jpg", "f.txt", "sub/g.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = lambda kind, **kw: {r.path.rsplit("/", 1)[-1] for r in readers.find_media(spark, [str(tmp_path)], kind, **kw).collect()}
    assert found("image") == {"a.jpg", "b.JPG", "g.jpg"}
    assert found("image", recursive=False) == {"a.jpg", "b.JPG"}
    assert found("video") == {"c.mp4"} and found("xml") == {"d.xml"}
