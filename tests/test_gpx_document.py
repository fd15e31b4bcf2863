"""A run's GPX document: written in parts by many tasks, equal to a plain one."""

import json
import xml.etree.ElementTree as ET
from pathlib import Path

from trailframe.functions import records as R
from trailframe.sources import writers

IMAGES = [
    # sequence, name, time, lat, alt, error
    ("s2", "b.jpg", 20.0, 1.5, None, False), ("s2", "a.jpg", 20.0, 1.25, 3.0, False), ("s1", "c<&>.jpg", 5.0, 2.0, 0.0, False),
    ("s1", "d.jpg", 4.0, 2.5, 1.0, False), ("s1", "bad.jpg", 6.0, 3.0, 1.0, True), *[("big", f"{i:04d}.jpg", float(i), 4.0 + i, 1.0, False) for i in range(500)],
]
VIDEOS = [("/v/2", False, 2), ("/v/1", False, 1), ("/v/0", True, 1), ("/v/none", False, 0)]


def frames(spark):
    rows = [
        (q, n, f"/i/{n}", t, lat, 8.0, alt, None, "m", None, "c", 7, "md", "OutsideGPXTrackError" if bad else None) for q, n, t, lat, alt, bad in IMAGES
    ]
    images = spark.createDataFrame(
        rows, "sequence_id string, basename string, filename string, time double, lat double, lon double, alt double, angle double, make string, model string, camera_uuid string, filesize long, md5sum string, e string"
    )
    from pyspark.sql import functions as F

    failed = lambda df: df.withColumn("error", F.when(F.col("e").isNotNull(), R.error("OutsideGPXTrackError", "out"))).drop("e")
    clips = [(f, "gopro", 5, "md", "m", "n", "c", [(float(i), 8.0, 1.0 + i, 2.0, None, 100.0 if i else None) for i in range(n)], "x" if bad else None) for f, bad, n in VIDEOS]
    videos = spark.createDataFrame(
        clips, "filename string, filetype string, filesize long, md5sum string, make string, model string, camera_uuid string, points array<struct<time:double,lon:double,lat:double,alt:double,angle:double,epoch:double>>, e string"
    )
    return failed(images), failed(videos)


def test_document_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    images, videos = frames(spark)
    path = tmp_path / "run.gpx"
    writers.write_gpx_in_parts(writers.metadata_gpx_lines(images.repartition(4), videos), str(path))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    parts = sorted(Path(path).glob("part-*"))
    texts = [p.read_text() for p in parts]
    # One track lies in several parts.
    assert sum('lat="' in t and "<name>0" in t for t in texts) > 1
    root = ET.fromstring("".join(texts).encode())
    for node in root.iter():
        node.tag = node.tag.split("}")[-1]
    got = []
    for trk in root.findall("trk"):
        points = [(float(p.get("lat")), p.findtext("ele"), p.findtext("time"), p.findtext("name")) for p in trk.iter("trkpt")]
        got.append((trk.findtext("name"), json.loads(trk.findtext("desc")), None if trk.find("trkseg") is None else points))
    assert [(n, d["error"]["type"], p) for n, d, p in got[:2]] == [("/i/bad.jpg", "OutsideGPXTrackError", None), ("/v/0", "OutsideGPXTrackError", None)]
    assert all("filename" not in d and "MAPGPSTrack" not in d and "MAPLatitude" not in d for _, d, _ in got)
    sequences = [(n, [p[3] for p in points]) for n, _, points in got[2:5]]
    want = {q: [n for _, n in sorted((t, n) for s, n, t, _, _, bad in IMAGES if s == q and not bad)] for q in ("big", "s1", "s2")}
    assert sequences == list(want.items())
    assert got[4][1]["MAPSequenceUUID"] == "s2" and got[4][2][0] == (1.25, "3.0", "1970-01-01T00:00:20.000Z", "a.jpg") and got[4][2][1][1] is None
    clips = [(n, [(p[0], p[2]) for p in points]) for n, _, points in got[5:]]
    assert clips == [("/v/1", [(1.0, "1970-01-01T00:00:00.000Z")]), ("/v/2", [(1.0, "1970-01-01T00:00:00.000Z"), (2.0, "1970-01-01T00:01:40.000Z")]), ("/v/none", [])]
    assert got[5][1]["filetype"] == "gopro" and len(got) == 8
