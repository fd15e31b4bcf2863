"""Which frames to take from videos, where they are, and when they were taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.operators import ordered as O
from trailframe.operators import telemetry as M
from trailframe.operators import tracks as K
from trailframe.operators.ordered import Ordered


def frames_by_distance(
    frames: DataFrame, points: DataFrame, streams: DataFrame, key: str, min_distance: float
) -> DataFrame:
    """Sampled frames with position and capture time.

    The time is the interpolated GPS epoch where the track has one, else the
    recording start plus the time into the video. Points carry ``epoch_time``.
    """
    ordered = Ordered.of(frames, [key], ["cts", "frame_no"]).scan(_i=O.index())
    shown = ordered.rows().withColumns({"frame_idx": F.col("_i") - 1, "time": F.col("cts")}).drop("_i")
    placed = K.interpolate(shown, points, [key], "frame_idx", fields={"epoch_time": "epoch"})
    near = placed.filter(K.within_track_buffered(F.col("time"), F.col("track_start"), F.col("track_end")))
    flat = near.select(key, "frame_idx", "time", "at.*")
    kept = K.sample_by_distance(flat, [key], ["frame_idx"], min_distance)
    timed = kept.join(M.recording_start(streams, key), key, "left")
    taken = K.frame_time(F.col("epoch_time"), F.col("start_time"), F.col("time"))
    return timed.withColumn("capture_time", taken).drop("start_time")


def frames_by_interval(
    frames: DataFrame, streams: DataFrame, key: str, interval: float, ratio: float = 1.0
) -> DataFrame:
    """Capture time of frames taken at a fixed interval (``frame_idx`` from 1)."""
    timed = frames.join(M.recording_start(streams, key), key, "left")
    taken = K.interval_frame_time(F.col("start_time"), F.col("frame_idx"), interval, ratio)
    return timed.withColumn("capture_time", taken).drop("start_time")
