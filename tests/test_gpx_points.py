"""GPX files split inside their tracks: the rows of the reader that takes whole tracks."""

import random

import pytest

from trailframe.sources import readers


def document(rng, tracks):
    out = ["<?xml version='1.0'?><gpx xmlns='http://www.topografix.com/GPX/1/1'><metadata><name>run</name></metadata><wpt lat='9' lon='9'><time>2020-01-01T00:00:00Z</time><name>w</name></wpt>"]
    for t in range(tracks):
        name = rng.choice(["", f"<name>t{t} &lt;a&gt; &amp; b</name>", "<desc>d</desc><name>x</name>"])
        out.append(rng.choice(["<trk>", "<trk id='1'>"]) + name)
        for _ in range(rng.randrange(0, 4)):
            out.append("<trkseg>")
            for i in range(rng.choice([0, 1, 3, 40])):
                ele = rng.choice(["", f"<ele>{i}.5</ele>"])
                time = rng.choice(["", f"<time>2020-01-01T00:{i % 60:02d}:0{t % 10}.250Z</time>"])
                where = rng.choice([f'lat="{i / 8}" lon="-{t}.5"', f"lon='-{t}.5' lat='{i / 8}'"])
                out.append(rng.choice([f"<trkpt {where}>\n{ele}<extensions><v>1</v></extensions>{time}<name>p{i}</name></trkpt>", f"<trkpt {where}/>", "<!-- <trk><trkseg> -->"]))
            out.append("</trkseg>\n")
        out.append("</trk>")
    return "".join(out) + "</gpx>"


@pytest.mark.parametrize("max_rows", [None, 40])
def test_same_rows_as_whole_tracks(spark, tmp_path, max_rows):
    rng = random.Random(17)
    for i in range(6):
        (tmp_path / f"{i}.gpx").write_text(document(rng, [0, 1, 5, 12, 20, 30][i]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = readers.read_gpx_points(spark, str(tmp_path), max_rows)
        whole = readers.read_gpx(spark, str(tmp_path))
        assert got.columns == whole.columns
        rows = sorted(map(str, map(tuple, got.collect())))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == sorted(map(str, map(tuple, whole.collect()))) and len(rows) > 100


def test_one_track_over_many_tasks(spark, tmp_path):
    points = "".join(f"<trkpt lat='{i % 90}' lon='1'><time>2020-01-01T00:00:00Z</time></trkpt>" for i in range(20_000))
    (tmp_path / "a.gpx").write_text(f"<gpx><trk><name>n</name><trkseg>{points}</trkseg></trk></gpx>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        raw = spark.read.option("lineSep", "</trkpt>").text(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 8
        got = readers.read_gpx_points(spark, str(tmp_path), 3_000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.ord, r.lat) for r in got) == [(i, float(i % 90)) for i in range(20_000)]
    assert {(r.track_no, r.name, r.segment_id) for r in got} == {(0, "n", 0)}
