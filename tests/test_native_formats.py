"""Formats of a video's container, tried in order by file type."""

from trailframe.operators.native import native_tracks

VIDEOS = [("both", None), ("camm only", ["camm"]), ("falls through", ["video"]), ("broken", None), ("not asked", ["blackvue"]), ("empty", ["gopro"]), ("noisy", None), ("image", ["image"]), ("full first", None), (None, None)]
CONTAINERS = [
    ("both", "gopro", None), ("both", "camm", None), ("camm only", "gopro", None), ("camm only", "camm", None), ("falls through", "blackvue", None),
    ("broken", "gopro", "moov"), ("broken", "camm", None), ("not asked", "gopro", None), ("empty", "gopro", None), ("empty", "camm", None),
    ("noisy", "gopro", None), ("noisy", "camm", None), ("image", "gopro", None), ("full first", "camm", None), ("both", "other", None),
]
TRACK = [(n, f) for n, f, broken in CONTAINERS if n != "empty"]


def test_first_format_that_has_a_track_decides(spark):
    videos = spark.createDataFrame(VIDEOS, "file string, filetypes array<string>")
    containers = spark.createDataFrame(CONTAINERS, "file string, format string, broken string")
    rows = [
        (n, f, i % 2 == 0 if n == "full first" else True if f == "camm" else None, i, float(i), 50.0, 8.0, 0 if n == "noisy" else 3, 100.0, 0.0)
        for n, f in TRACK for i in range(4)
    ]
    points = spark.createDataFrame(rows, "file string, format string, minimal boolean, ord long, time double, lat double, lon double, fix int, precision double, ground_speed double")
    verdicts, kept = native_tracks(videos, containers, points, "file", ["time", "ord"])
    assert {r.file: (r.filetype, r.error.type if r.error else None) for r in verdicts.collect()} == {
        "both": ("gopro", None), "camm only": ("camm", None), "falls through": ("blackvue", None), "broken": (None, "InvalidVideoError"),
        "not asked": (None, "VideoGPSNotFoundError"), "empty": (None, "GPXEmptyError"), "noisy": (None, "GPSNoiseError"),
        "image": (None, "VideoGPSNotFoundError"), "full first": ("camm", None), None: (None, "VideoGPSNotFoundError"),
    }
    found = {}
    for r in kept.collect():
        found.setdefault((r.file, r.filetype), []).append(r.ord)
    assert {k: sorted(v) for k, v in found.items()} == {
        ("both", "gopro"): [0, 1, 2, 3], ("camm only", "camm"): [0, 1, 2, 3], ("falls through", "blackvue"): [0, 1, 2, 3], ("full first", "camm"): [1, 3],
    }


def test_inputs_are_read_for_one_table_each(spark, tmp_path):
    """The verdicts and points come from stored tables, not from the inputs once more in every step."""
    spark.createDataFrame(VIDEOS, "file string, filetypes array<string>").write.parquet(f"{tmp_path}/videos")
    videos = spark.read.parquet(f"{tmp_path}/videos")
    containers = spark.createDataFrame(CONTAINERS, "file string, format string, broken string")
    points = spark.range(4).selectExpr(
        "'both' AS file", "'gopro' AS format", "false AS minimal", "id AS ord", "double(id) AS time", "50D AS lat", "8D AS lon", "3 AS fix", "100D AS precision", "0D AS ground_speed"
    )
    verdicts, kept = native_tracks(videos, containers, points, "file", ["time", "ord"])
    for out in (verdicts, kept):
        assert out.inputFiles() and not any(str(tmp_path) in f for f in out.inputFiles())
    assert kept.count() == 4
