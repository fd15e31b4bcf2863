"""Telemetry of a video's own container: formats tried in order, by file type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import records as R
from trailframe.operators.filters import GPS_PRECISION_M, remove_noisy_points
from trailframe.operators.ordered import join_keys
from trailframe.runtime import materialize

# Formats in the order they are tried; a file type of the same name admits each, and "video" admits all.
FORMATS = ["gopro", "camm", "blackvue"]
ANY_VIDEO = "video"
# The format whose points go through the noise filter.
FILTERED = "gopro"


def admits(filetypes: Column, kind: str) -> Column:
    """Whether a file-type filter (null: no filter) lets a format be tried."""
    return filetypes.isNull() | F.arrays_overlap(filetypes, F.array(F.lit(ANY_VIDEO), F.lit(kind)))


def first_telemetry(videos: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """``videos`` with the ``format`` that decides each video and its ``error`` so far.

    ``containers`` has one row per video and format that was met: ``key, format,
    broken`` (why the container can't be read for it, null if it can). Formats
    are tried in order where ``filetypes`` admits them. One that isn't there
    passes the video on; a broken one, and one with a track, decide it. A video
    that none decides has no telemetry.
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    # The lists are short: one pass over the containers finds each video's first few formats.
    met = containers.filter(rank > 0).groupBy(key).agg(
        F.sort_array(F.collect_set(F.struct(rank.alias("rank"), "format", "broken"))).alias("_met")
    )
    tried = join_keys(videos, met, [key])
    allowed = F.array(*[F.when(admits(F.col("filetypes"), f), F.lit(f)) for f in FORMATS])
    chosen = tried.withColumn("_first", F.get(F.filter("_met", lambda m: F.array_contains(F.array_compact(allowed), m["format"])), F.lit(0)))
    error = F.when(F.col("_first").isNull(), R.error(R.VIDEO_GPS_NOT_FOUND, "The video holds no telemetry of a format that was asked for")).when(
        F.col("_first.broken").isNotNull(), R.error(R.INVALID_VIDEO, F.concat(F.lit("The container can't be read: "), F.col("_first.broken")))
    )
    return chosen.withColumns({"format": F.col("_first.format"), "error": error}).drop("_met", "_first")


def native_tracks(
    videos: DataFrame, containers: DataFrame, points: DataFrame, key: str, order: list[str], precision: float = GPS_PRECISION_M
) -> tuple[DataFrame, DataFrame]:
    """Verdicts (``videos`` with ``filetype`` and ``error``) and the points of the videos without an error.

    ``points`` has ``key, format, minimal`` and the track's columns; points of
    the ``minimal`` kind count only where a video's track has no full ones. The
    deciding format's errors end the search: no points, or none left by the
    noise filter of ``gopro``.
    """
    # Both are written once: the noise filter reads the points, and so the deciding, in many steps.
    decided = materialize(first_telemetry(videos, containers, key), "native-decided")
    open_ = decided.filter("error IS NULL").select(key, F.col("format").alias("_format"))
    own = points.join(open_, (points[key] == open_[key]) & (points["format"] == open_["_format"])).drop(open_[key], "_format")
    own = materialize(own, "native-own")
    full = own.groupBy(key).agg(F.count_if(~F.coalesce("minimal", F.lit(False))).alias("_full"), F.count(F.lit(1)).alias("_raw"))
    chosen = own.join(full, key).filter((F.col("_full") == 0) | ~F.coalesce("minimal", F.lit(False))).drop("_full", "_raw")
    chosen = materialize(chosen, "native-points")
    columns = [c for c in points.columns if c != "minimal"]
    noisy = chosen.filter(F.col("format") == FILTERED).select(*columns)
    clean = remove_noisy_points(noisy, key, order, precision).select(*columns)
    kept = chosen.filter(F.col("format") != FILTERED).select(*columns).unionByName(clean)
    left = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_left"))
    counted = join_keys(join_keys(decided, full.select(key, "_raw"), [key]), left, [key])
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_raw").isNull(), R.error(R.GPX_EMPTY, "The telemetry track has no points"))
        .when(F.col("_left").isNull(), R.error(R.GPS_NOISE, "No point of the track is trusted"))
    )
    verdicts = counted.withColumn("error", error).withColumn("filetype", F.when(F.col("error").isNull(), F.col("format"))).drop("_raw", "_left", "format")
    return verdicts, kept.withColumnRenamed("format", "filetype")
