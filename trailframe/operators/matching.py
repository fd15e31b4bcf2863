"""Matching files to their sources, and choosing among several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import paths
from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators import tracks as K


def first_per_path(files: DataFrame, order: str, path: str = "path") -> DataFrame:
    """First occurrence of each resolved path."""
    resolved = files.withColumn("_resolved", paths.resolve(F.col(path)))
    row = F.struct(*files.columns)
    return resolved.groupBy("_resolved").agg(F.min_by(row, order).alias("_r")).select("_r.*")


def match_frames(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Images that are frames of a video: ``.../<video name>/<video stem>_...``.

    Of several videos with one name the last listed counts. Adds ``video_path``.
    """
    named = videos.groupBy(paths.basename(F.col("path")).alias("_dir")).agg(
        F.max_by("path", "ord").alias("video_path")
    )
    placed = images.withColumn("_dir", paths.basename(paths.parent(F.col("path"))))
    joined = placed.join(named, "_dir")
    lead = F.concat(paths.stem(F.col("_dir")), F.lit("_"))
    return joined.filter(F.startswith(paths.basename(F.col("path")), lead)).drop("_dir")


def frame_number(path: Column) -> Column:
    """``struct<stream, frame_idx>`` of ``<stem>_<stream>_<index>.jpg``, else null."""
    name = paths.basename(path)
    pattern = r"^.*_(\d+|v)_(\d+)\.(?i:jpg)$"
    found = F.struct(
        F.regexp_extract(name, pattern, 1).alias("stream"),
        F.regexp_extract(name, pattern, 2).try_cast("bigint").alias("frame_idx"),
    )
    return F.when(name.rlike(pattern), found)


def geotag_frames(
    images: DataFrame, videos: DataFrame, points: DataFrame, offset: float = 0.0
) -> DataFrame:
    """Position frames on the track of their video.

    ``videos``: path, ord, make, model, camera_uuid, error; ``points`` belong to
    ``video_path`` with times from the start of the video. The first frame of a
    video is taken at time 0. Frames of failed videos inherit their error.
    """
    frames = match_frames(images, videos.select("path", "ord"))
    known = videos.select(
        F.col("path").alias("video_path"), "make", "model", "camera_uuid", F.col("error").alias("_video_error")
    )
    joined = frames.join(known, "video_path")
    failed = joined.filter("_video_error IS NOT NULL").withColumn("error", F.col("_video_error"))
    good = joined.filter("_video_error IS NULL")
    shifted = K.align_points(points, good, ["video_path"])
    moved = K.align_captures(good, points, ["video_path"], offset)
    tagged = K.geotag(moved.drop("error"), shifted, ["video_path"])
    both = tagged.unionByName(failed, allowMissingColumns=True)
    return both.drop("_video_error")


def attach_sidecars(
    files: DataFrame, listing: DataFrame, pattern: str | None = None, fixed: str | None = None
) -> DataFrame:
    """Companion path of each file, or an error row where there is no such file."""
    wanted = files.withColumn("sidecar", paths.sidecar(F.col("path"), pattern, fixed))
    existing = listing.select(F.col("path").alias("sidecar"), F.lit(True).alias("_found")).distinct()
    joined = wanted.join(existing, "sidecar", "left")
    missing = R.error(R.VIDEO_GPS_NOT_FOUND, "No track file goes with the video")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), missing)).drop("_found")


def match_index(files: DataFrame, index: DataFrame, by_pattern: str | None = None) -> DataFrame:
    """Record of each file in an XML index (``path, source, ord, record``).

    With a pattern the record comes from the file's own XML: the one for its
    path, else the first in it. Files without a record are error rows.
    """
    missing = R.error(R.TOOL_XML_NOT_FOUND, "Cannot find the file in the ExifTool XML")
    last = lambda keys: index.groupBy(*keys).agg(
        F.max_by("record", F.struct("source", "ord")).alias("record")
    )
    if by_pattern is None:
        joined = files.join(last(["path"]), "path", "left")
    else:
        placed = files.withColumn("source", paths.sidecar(F.col("path"), by_pattern))
        first = index.groupBy("source").agg(F.min_by("record", "ord").alias("_first"))
        joined = placed.join(last(["path", "source"]), ["path", "source"], "left").join(first, "source", "left")
        joined = joined.withColumn("record", F.coalesce("record", "_first")).drop("_first")
    return joined.withColumn("error", F.when(F.col("record").isNull(), missing))


def split_frames_and_stills(
    images: DataFrame, frame_results: DataFrame, geotag_stills
) -> DataFrame:
    """Frames keep their result; the other images go through ``geotag_stills``."""
    stills = images.join(frame_results.select("path"), "path", "left_anti")
    return frame_results.unionByName(geotag_stills(stills), allowMissingColumns=True)


def cascade(sources: list[DataFrame], key: str = "path") -> DataFrame:
    """First source with a final result per file.

    A retryable error defers to the next source, except at the last source,
    whose result stands. Files no source answers for drop out.
    """
    last = len(sources) - 1
    ranked = [
        df.withColumn("_p", F.lit(i)).filter(F.lit(i == last) | ~R.is_retryable(F.col("error")))
        for i, df in enumerate(sources)
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    rest = [c for c in merged.columns if c not in (key, "_p")]
    best = F.min_by(F.struct("_p", *rest), "_p")
    out = merged.groupBy(key).agg(best.alias("_b"))
    return out.select(key, F.col("_b._p").alias("source_no"), *[f"_b.{c}" for c in rest])


def existing_records(records: DataFrame, listing: DataFrame, path: str = "filename") -> DataFrame:
    """Records whose resolved file is among the listed files."""
    here = listing.select(paths.resolve(F.col("path")).alias("_resolved")).distinct()
    resolved = records.withColumn("_resolved", paths.resolve(F.col(path)))
    return resolved.join(here, "_resolved", "left_semi").drop("_resolved")


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter("error IS NULL")


def error_rows(df: DataFrame) -> DataFrame:
    return df.filter("error IS NOT NULL")


def sort_for_upload(videos: DataFrame, max_rows: int | None = None) -> DataFrame:
    """0-based place of each video by file name."""
    return O.number_globally(videos, ["filename"], "upload_idx", max_rows)

