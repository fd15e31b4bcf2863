"""Tracks in tool XML: tables that several steps read are stored once."""

from trailframe.operators import telemetry as M


def test_elements_are_read_once(spark, tmp_path):
    rows = [
        ("a", 1, "QuickTime:GPSDateTime", "2020:01:01 00:00:05Z"), ("a", 2, "QuickTime:GPSLongitude", "1"), ("a", 3, "QuickTime:GPSLatitude", "2"),
        ("b", 1, "Track1:SampleTime", "0"), ("b", 2, "Track1:SampleDuration", "6"), ("b", 3, "Track1:GPSLongitude", "3"), ("b", 4, "Track1:GPSLatitude", "4"),
        ("b", 5, "Track1:GPSLongitude", "5"), ("b", 6, "Track1:GPSLatitude", "6"), ("c", 1, "Other:GPSLatitude", "7"),
    ]
    spark.createDataFrame(rows, "file string, ord long, tag string, text string").write.parquet(f"{tmp_path}/elements")
    out = M.tool_video_tracks(spark.read.parquet(f"{tmp_path}/elements"), "file")
    assert out.inputFiles() and not any(str(tmp_path) in f for f in out.inputFiles())
    found = sorted((r.file, r.time, r.lon, r.lat, r.source_no) for r in out.collect())
    assert found == [("a", 0.0, 1.0, 2.0, 0), ("b", 0.0, 3.0, 4.0, 2), ("b", 3.0, 5.0, 6.0, 2)]
