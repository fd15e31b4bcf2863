"""Placing captures on tracks, and arithmetic on timestamped point streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.functions import geo
from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators.blocks import by_size, last_kept, placed
from trailframe.operators.fold import MAX_ARRAY_ROWS, fold_bounded
from trailframe.operators.ordered import Ordered, join_keys

# Captures this close to an end of the track still count as on it (seconds).
EDGE_TOLERANCE_S = 0.001

# Typed fields carried along a track, and how each one interpolates.
GPS_FIELDS = {"epoch_time": "epoch", "fix": "start", "precision": "linear", "ground_speed": "linear"}
MOTION_FIELDS = {
    "time_gps_epoch": "linear",
    "gps_fix_type": "start",
    "horizontal_accuracy": "linear",
    "vertical_accuracy": "linear",
    "velocity_east": "linear",
    "velocity_north": "linear",
    "velocity_up": "linear",
    "speed_accuracy": "linear",
}


# -- as-of interpolation --------------------------------------------------------


def interpolate(
    captures: DataFrame,
    points: DataFrame,
    keys: list[str],
    capture_id: str = "ord",
    point_id: str = "ord",
    fields: dict[str, str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Position every capture on the track of its key at the capture's time.

    The bracket is the last point strictly before and the first point at or
    after the capture; outside the track the nearest segment is extended. One
    shuffle: captures and points are unioned and scanned in time order, so no
    range join is involved. Adds ``at`` (lat, lon, alt, angle and typed fields),
    ``track_start``, ``track_end``; ``at`` is null where the key has no points.
    """
    fields = fields or {}
    kept = [c for c in captures.columns if c not in keys]
    point = F.struct("time", "lat", "lon", "alt", *fields)
    null_point = F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType)
    null_capture = F.lit(None).cast(captures.select(F.struct(*kept).alias("c")).schema["c"].dataType)
    left = captures.select(
        *keys,
        F.col("time").alias("_t"),
        F.lit(0).alias("_k"),
        F.col(capture_id).cast("string").alias("_o"),
        F.lit(0).cast("bigint").alias("_po"),
        F.struct(*kept).alias("_cap"),
        null_point.alias("_pt"),
    )
    right = points.select(
        *keys,
        F.col("time").alias("_t"),
        F.lit(1).alias("_k"),
        F.lit("").alias("_o"),
        F.col(point_id).cast("bigint").alias("_po"),
        null_capture.alias("_cap"),
        point.alias("_pt"),
    )
    # At equal times captures come first, so "strictly before" is a plain scan.
    rows = Ordered.of(
        left.unionByName(right), keys, ["_t", "_k", "_po", "_o"], max_rows, sized_by=[captures, points], spread=True
    )
    near = rows.scan(
        _lk=O.last_known(F.col("_pt"), current=False), _nk=O.next_known(F.col("_pt"), current=False)
    )
    is_point = F.col("_k") == 1
    linked = near.scan(
        _lq=O.last_known(
            F.when(is_point, F.struct(F.col("_pt").alias("pt"), F.col("_lk").alias("far"))), False
        ),
        _nr=O.next_known(
            F.when(is_point, F.struct(F.col("_pt").alias("pt"), F.col("_nk").alias("far"))), False
        ),
        track_start=O.group_min(F.col("_pt.time")),
        track_end=O.group_max(F.col("_pt.time")),
    )
    before, after = F.col("_lq.pt"), F.col("_nr.pt")
    start = F.when(before.isNull(), after).when(
        after.isNull(), F.coalesce(F.col("_lq.far"), before)
    ).otherwise(before)
    end = F.when(after.isNull(), before).when(
        before.isNull(), F.coalesce(F.col("_nr.far"), after)
    ).otherwise(after)
    bracketed = linked.df.filter("_k = 0").withColumns({"_s": start, "_e": end})
    at = _between(F.col("_s"), F.col("_e"), F.col("_t"), fields)
    placed = bracketed.withColumn("at", F.when(F.col("_s").isNotNull(), at))
    return placed.select(*keys, "_cap.*", "at", "track_start", "track_end")


def _between(start: Column, end: Column, t: Column, fields: dict[str, str]) -> Column:
    w = geo.weight(t, start["time"], end["time"])
    out = {
        "lat": geo.lerp(start["lat"], end["lat"], w),
        "lon": geo.lerp(start["lon"], end["lon"], w),
        "alt": geo.lerp(start["alt"], end["alt"], w),
        "angle": geo.bearing(start["lat"], start["lon"], end["lat"], end["lon"]),
    }
    for name, how in fields.items():
        a, b = start[name], end[name]
        if how == "start":
            out[name] = a
        elif how == "epoch":
            out[name] = F.when((a > 0) & (b > 0), geo.lerp(a, b, w))
        else:
            out[name] = geo.lerp(a, b, w)
    return F.struct(*[c.alias(n) for n, c in out.items()])


def outside_track_error(time: Column, start: Column, end: Column) -> Column:
    """Error for a capture more than a millisecond off the track, else null."""
    variables = {
        "image_time": R.format_capture_time(time),
        "gpx_start_time": R.format_capture_time(start),
        "gpx_end_time": R.format_capture_time(end),
    }
    early, late = start - time, time - end
    text = lambda lead, delta, tail: F.concat(
        F.lit(lead), F.round(delta, 3).cast("string"), F.lit(tail)
    )
    behind = text("taken ", early, " s before the track begins")
    beyond = text("taken ", late, " s after the track ends")
    return F.when(
        early > EDGE_TOLERANCE_S, R.error(R.OUTSIDE_TRACK, behind, **variables)
    ).when(late > EDGE_TOLERANCE_S, R.error(R.OUTSIDE_TRACK, beyond, **variables))


def within_track_buffered(time: Column, start: Column, end: Column) -> Column:
    return (time >= start - EDGE_TOLERANCE_S) & (time <= end + EDGE_TOLERANCE_S)


def geotag(captures: DataFrame, points: DataFrame, keys: list[str], capture_id: str = "ord") -> DataFrame:
    """Interpolate and turn captures off the track into error rows."""
    placed = interpolate(captures, points, keys, capture_id)
    off = outside_track_error(F.col("time"), F.col("track_start"), F.col("track_end"))
    empty = R.error(R.GPX_EMPTY, "The track has no points")
    judged = placed.withColumn("error", F.when(F.col("at").isNull(), empty).otherwise(off))
    ok = F.col("error").isNull()
    updates = {c: F.when(ok, F.col(f"at.{c}")) for c in ("lat", "lon", "alt", "angle")}
    return judged.withColumns(updates).drop("at", "track_start", "track_end")


def pick_track(
    captures: DataFrame,
    points: DataFrame,
    keys: list[str],
    segment: str = "segment_id",
    capture_id: str = "ord",
    max_rows: int | None = None,
) -> DataFrame:
    """Choose, per capture, the first track (by start) that ends at or after it.

    With a running maximum of the ends only tracks that push it up can be first,
    and those have increasing ends, so the choice is one forward scan. Captures
    after every track take the last one.
    """
    bounds = points.groupBy(*keys, segment).agg(
        F.min("time").alias("_start"), F.max("time").alias("_end")
    )
    ranked = Ordered.of(bounds, keys, ["_start", segment], max_rows, sized_by=[points])
    topped = ranked.scan(_upto=O.running_max(F.col("_end"))).scan(_past=O.prev(F.col("_upto")))
    record = F.coalesce(F.col("_end") > F.col("_past"), F.lit(True))
    kept = [c for c in captures.columns if c not in keys]
    null_capture = F.lit(None).cast(captures.select(F.struct(*kept).alias("c")).schema["c"].dataType)
    seg_type = points.schema[segment].dataType
    left = captures.select(
        *keys,
        F.col("time").alias("_t"),
        F.lit(0).alias("_k"),
        F.col(capture_id).cast("string").alias("_o"),
        F.struct(*kept).alias("_cap"),
        F.lit(None).cast("double").alias("_start"),
        F.lit(None).cast(seg_type).alias(segment),
        F.lit(False).alias("_record"),
    )
    right = topped.rows().select(
        *keys,
        F.col("_end").alias("_t"),
        F.lit(1).alias("_k"),
        F.col(segment).cast("string").alias("_o"),
        null_capture.alias("_cap"),
        "_start",
        segment,
        record.alias("_record"),
    )
    rows = Ordered.of(
        left.unionByName(right), keys, ["_t", "_k", "_o"], max_rows, sized_by=[captures, points]
    )
    found = rows.scan(
        _hit=O.next_known(F.when(F.col("_record"), F.col(segment)), current=False),
        _last=O.group_max(F.when(F.col("_k") == 1, F.struct("_start", segment))),
    )
    chosen = F.coalesce(F.col("_hit"), F.col(f"_last.{segment}"))
    out = found.df.filter("_k = 0").withColumn("_chosen", chosen)
    return out.select(*keys, "_cap.*", F.col("_chosen").alias(segment))


def interpolate_tracks(
    captures: DataFrame, points: DataFrame, keys: list[str], segment: str = "segment_id"
) -> DataFrame:
    """Interpolation where a key has several tracks."""
    picked = pick_track(captures, points, keys, segment)
    return interpolate(picked, points, [*keys, segment])


def align_captures(
    captures: DataFrame, points: DataFrame, keys: list[str], offset: float = 0.0, to_track_start: bool = False
) -> DataFrame:
    """Shift capture times by ``offset`` and, if asked, onto the track's first point."""
    if not to_track_start:
        return captures.withColumn("time", F.col("time") + offset)
    first_capture = captures.groupBy(*keys).agg(F.min("time").alias("_c0"))
    first_point = points.groupBy(*keys).agg(F.min("time").alias("_p0"))
    both = join_keys(join_keys(captures, first_capture, keys), first_point, keys)
    shift = F.coalesce(F.col("_p0") - F.col("_c0"), F.lit(0.0)) + offset
    return both.withColumn("time", F.col("time") + shift).drop("_c0", "_p0")


def align_points(points: DataFrame, captures: DataFrame, keys: list[str]) -> DataFrame:
    """Read point times as seconds after the first capture of their key."""
    first = captures.groupBy(*keys).agg(F.min("time").alias("_c0"))
    return join_keys(points, first, keys).withColumn("time", F.col("_c0") + F.col("time")).drop("_c0")


def sync_to_video(
    gpx: DataFrame, native: DataFrame, key: str, mode: str = "sync"
) -> DataFrame:
    """Rebase GPX points onto the clock of their video.

    ``sync`` offsets by first GPX time minus the video's first GPS epoch where
    there is one; ``rebase`` starts every track at 0; ``strict_sync`` marks the
    points of videos without GPS with an error.
    """
    at = F.struct("time", "ord")
    first_gpx = gpx.groupBy(key).agg(F.min("time").alias("_g0"))
    first_native = native.groupBy(key).agg(
        F.min_by("epoch_time", at).alias("_epoch"), F.lit(True).alias("_found")
    )
    joined = gpx.join(first_gpx, key).join(first_native, key, "left")
    offset = F.coalesce(F.col("_g0") - F.col("_epoch"), F.lit(0.0)) if mode != "rebase" else F.lit(0.0)
    missing = R.error(R.VIDEO_GPS_NOT_FOUND, "The video has no telemetry track")
    strict = F.lit(mode == "strict_sync") & F.col("_found").isNull()
    out = joined.withColumns(
        {"time": F.col("time") - F.col("_g0") + offset, "error": F.when(strict, missing)}
    )
    return out.drop("_g0", "_epoch", "_found")


# -- edit lists -------------------------------------------------------------------


def apply_edit_list(
    measurements: DataFrame, segments: DataFrame, key: str, max_rows: int | None = None
) -> DataFrame:
    """Keep the measurements inside a track's edit segments, shifted by its empty edit.

    Measurements are matched to segments in order, and the one that steps past a
    segment's end is consumed by the step even if the next segment would hold it.
    With ``f`` the position of the first measurement past segment ``j``'s end,
    segment ``j`` is left at position ``j + max(f_i - i)`` over ``i <= j``.
    """
    empty = segments.filter("media_time = -1").groupBy(key).agg(
        F.max_by("duration", "seg_no").alias("_offset")
    )
    real = segments.filter("media_time <> -1").select(
        key, "media_time", (F.col("media_time") + F.col("duration")).alias("_end"), "seg_no"
    )
    kept = [c for c in measurements.columns if c != key]
    row_type = measurements.select(F.struct(*kept).alias("m")).schema["m"].dataType
    seg_type = "struct<media_time:double,seg_end:double,seg_no:bigint>"
    seg = F.struct(
        F.col("media_time").cast("double").alias("media_time"),
        F.col("_end").cast("double").alias("seg_end"),
        F.col("seg_no").cast("bigint").alias("seg_no"),
    )
    left = measurements.select(
        key, F.col("time").alias("_t"), F.lit(0).alias("_k"), F.col("ord").cast("bigint").alias("_o"),
        F.struct(*kept).alias("_m"), F.lit(None).cast(seg_type).alias("_seg"),
    )
    right = real.select(
        key, F.col("_end").alias("_t"), F.lit(1).alias("_k"), F.col("seg_no").cast("bigint").alias("_o"),
        F.lit(None).cast(row_type).alias("_m"), seg.alias("_seg"),
    )
    sized = [measurements, segments]
    timed = Ordered.of(left.unionByName(right), [key], ["_t", "_k", "_o"], max_rows, sized_by=sized)
    counted = timed.scan(_i=O.running_sum(F.when(F.col("_k") == 0, 1).otherwise(0)))
    passed = counted.rows().filter("_k = 1").select(key, "_seg.*", (F.col("_i") + 1).alias("_f"))
    ranked = Ordered.of(passed, [key], ["media_time", "seg_no"], max_rows, sized_by=[segments])
    ranked = ranked.scan(_j=O.index()).scan(_lead=O.running_max(F.col("_f") - F.col("_j")))
    left_at = ranked.rows().select(
        key, (F.col("_j") + F.col("_lead")).alias("_i"), F.lit(1).alias("_k"), F.col("seg_no").alias("_o"),
        F.lit(None).cast(row_type).alias("_m"), F.struct("media_time", "seg_end", "seg_no").alias("_seg"),
    )
    numbered = counted.rows().filter("_k = 0").select(key, "_i", "_k", "_o", "_m", "_seg")
    placed = Ordered.of(
        numbered.unionByName(left_at), [key], ["_i", "_k", "_o"], max_rows, sized_by=sized
    ).scan(
        _next=O.next_known(F.when(F.col("_k") == 1, F.struct("_i", "_seg.media_time")), False),
        _segments=O.group_total(F.col("_k")),
    )
    inside = (
        (F.col("_segments") == 0)
        | ((F.col("_i") < F.col("_next._i")) & (F.col("_m.time") >= F.col("_next.media_time")))
    )
    out = placed.df.filter((F.col("_k") == 0) & inside).select(key, "_m.*")
    shifted = out.join(empty, key, "left")
    return shifted.withColumn("time", F.col("time") + F.coalesce("_offset", F.lit(0.0))).drop("_offset")


# -- sampling along a track ----------------------------------------------------------


def sample_by_distance(
    df: DataFrame, keys: list[str], order: list[str], min_distance: float, max_rows: int | None = None, report: dict | None = None
) -> DataFrame:
    """Keep the first row, then each row farther than ``min_distance`` from the last kept.

    Rows without a position (null or not a number) are never kept.
    """
    located = df.withColumn("at_xyz", geo.ecef(F.col("lat"), F.col("lon")))
    bounded = max_rows is not None and max_rows <= MAX_ARRAY_ROWS
    small, large = (located, None) if bounded else by_size(located, keys, MAX_ARRAY_ROWS)
    xyz = "struct<x:double,y:double,z:double>"

    def step(state: Column, row: Column) -> tuple[Column, Column]:
        total = row["at_xyz"]["x"] + row["at_xyz"]["y"] + row["at_xyz"]["z"]
        keep = total.isNotNull() & ~F.isnan(total) & F.coalesce(geo.chord(state["xyz"], row["at_xyz"]) > min_distance, state["xyz"].isNull())
        here = F.struct(row["at_xyz"].alias("xyz"))
        return F.when(keep, here).otherwise(state), F.struct(keep.alias("_keep"))

    init = F.struct(F.lit(None).cast(xyz).alias("xyz"))
    folded = fold_bounded(small, keys, order, init, f"struct<xyz:{xyz}>", "struct<_keep:boolean>", step)
    if large is not None:

        def judge(kept, rows):
            n = len(rows["at_x"])
            if kept is None:
                return np.ones(n, bool), {"_keep": ~np.isnan(rows["at_x"])}
            distance = np.sqrt(sum((kept[c] - rows[c]) ** 2 for c in ("at_x", "at_y", "at_z")))
            return distance > min_distance, {"_keep": distance > min_distance}

        inputs = {f"at_{c}": F.col(f"at_xyz.{c}") for c in "xyz"}
        outs = T.StructType().add("_keep", "boolean")
        folded = folded.unionByName(last_kept(placed(large, order), inputs, "at_x", judge, outs, report))
    return folded.filter("_keep").drop("_keep", "at_xyz")


def sample_frames(
    frames: DataFrame, points: DataFrame, key: str, min_distance: float
) -> DataFrame:
    """Frames to take from each video: at least ``min_distance`` apart along its track."""
    ordered = Ordered.of(frames, [key], ["cts", "frame_no"]).scan(_i=O.index())
    shown = ordered.rows().withColumns({"frame_idx": F.col("_i") - 1, "time": F.col("cts")}).drop("_i")
    placed = interpolate(shown, points, [key], capture_id="frame_idx")
    on_track = placed.filter(
        within_track_buffered(F.col("time"), F.col("track_start"), F.col("track_end"))
    )
    flat = on_track.select(
        key, "frame_idx", "time", "at.lat", "at.lon", "at.alt", "at.angle"
    )
    return sample_by_distance(flat, [key], ["frame_idx"], min_distance)


def interval_frame_time(start: Column, frame_idx_1based: Column, interval: float, ratio: float = 1.0) -> Column:
    return start + (frame_idx_1based - 1) * interval * ratio


def frame_time(gps_epoch: Column, start: Column, relative: Column) -> Column:
    """GPS epoch when valid, else start time plus the time into the video."""
    return F.when(gps_epoch > 0, gps_epoch).otherwise(start + relative)


# -- point streams ---------------------------------------------------------------------


def drop_repeated_points(points: Ordered, fields: list[str] | None = None) -> Ordered:
    """Drop rows equal to the row before in every field (null equals null)."""
    same = F.struct(*(fields or ["time", "lon", "lat", "epoch_time", "angle"]))
    looked = points.scan(_i=O.index(), _before=O.prev(same))
    fresh = (F.col("_i") == 1) | ~F.col("_before").eqNullSafe(same)
    return looked.filter(fresh).drop("_i", "_before")


def backfill_epochs(points: Ordered) -> Ordered:
    """Missing epochs follow the nearest earlier known one, else the nearest later."""
    known = F.when(F.col("epoch_time").isNotNull(), F.struct("epoch_time", "time"))
    seen = points.scan(_lk=O.last_known(known), _nk=O.next_known(known))
    from_ = lambda side: F.col(f"{side}.epoch_time") + (F.col("time") - F.col(f"{side}.time"))
    filled = F.coalesce(F.col("epoch_time"), from_("_lk"), from_("_nk"))
    return seen.add(epoch_time=filled).drop("_lk", "_nk")


def spread_in_sample(rows: Ordered, sample_time: str, duration: str) -> Ordered:
    """Space the rows of a sample evenly over its duration (group = one sample)."""
    counted = rows.scan(_i=O.index(), _n=O.group_total(F.lit(1)))
    step = F.col(duration) / F.col("_n")
    return counted.add(time=F.col(sample_time) + (F.col("_i") - 1) * step).drop("_i", "_n")


def rebase_times(points: DataFrame, keys: list[str], offset: float = 0.0) -> DataFrame:
    first = points.groupBy(*keys).agg(F.min("time").alias("_t0"))
    return join_keys(points, first, keys).withColumn("time", F.col("time") - F.col("_t0") + offset).drop("_t0")


def next_sample_delta(rows: Ordered, scale: int) -> Ordered:
    """Whole ticks to the next row, 0 on the last."""
    looked = rows.scan(_next=O.nxt(F.col("time")))
    delta = ((F.col("_next") - F.col("time")) * scale).cast("bigint")
    return looked.add(delta=F.coalesce(delta, F.lit(0))).drop("_next")


_EXPAND = 10_000


def expand_runs(runs: DataFrame, key: str, value: str, max_rows: int | None = None) -> DataFrame:
    """(count, value) runs to one row per frame, with the value summed before it.

    Running totals are taken over runs, not frames; long runs expand in two
    steps so that no row ever holds an array of a whole run.
    """
    total = F.col("count") * F.col(value)
    based = Ordered.of(runs, [key], ["run_no"], max_rows).scan(
        _frames=O.running_sum(F.col("count")), _sum=O.running_sum(total)
    )
    chunks = based.rows().filter("count > 0").withColumns(
        {
            "_f0": F.col("_frames") - F.col("count"),
            "_s0": F.col("_sum") - total,
            "_chunk": F.explode(F.expr(f"sequence(0L, (count - 1) div {_EXPAND})")),
        }
    )
    last = F.least(F.col("count") - 1 - F.col("_chunk") * _EXPAND, F.lit(_EXPAND - 1))
    each = chunks.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    place = F.col("_chunk") * _EXPAND + F.col("_in")
    return each.select(
        key,
        (F.col("_f0") + place).alias("frame_idx"),
        F.col(value),
        (F.col("_s0") + place * F.col(value)).alias("before"),
    )


def frame_timeline(
    videos: DataFrame, delta_runs: DataFrame, offset_runs: DataFrame, key: str
) -> DataFrame:
    """Decode and composition time of every frame, in seconds.

    ``videos`` holds ``n_frames`` and ``timescale``; runs hold ``run_no, count``
    and ``delta`` / ``offset``. Frames past the end of either list get 0.
    """

    def padded(runs: DataFrame, value: str) -> DataFrame:
        sums = runs.groupBy(key).agg(F.sum("count").alias("_have"))
        gap = videos.join(sums, key, "left").select(
            key,
            F.lit(2**31 - 1).cast("bigint").alias("run_no"),
            (F.col("n_frames") - F.coalesce("_have", F.lit(0))).alias("count"),
            F.lit(0).cast("bigint").alias(value),
        )
        listed = runs.select(key, F.col("run_no").cast("bigint"), F.col("count").cast("bigint"), F.col(value).cast("bigint"))
        return listed.unionByName(gap.filter("count > 0"))

    decode = expand_runs(padded(delta_runs, "delta"), key, "delta")
    shown = expand_runs(padded(offset_runs, "offset"), key, "offset").drop("before")
    joined = decode.join(shown, [key, "frame_idx"], "left").join(videos, key)
    scale = F.col("timescale")
    # Some writers store signed offsets as unsigned 32-bit values.
    signed = F.when(F.col("offset") >= 2**31, F.col("offset") - 2**32).otherwise(F.col("offset"))
    return joined.filter("frame_idx < n_frames").select(
        key,
        "frame_idx",
        (F.col("before") / scale).alias("dts"),
        ((F.col("before") + F.coalesce(signed, F.lit(0))) / scale).alias("cts"),
        (F.col("delta") / scale).alias("delta"),
    )


def compress_runs(rows: Ordered, value: str) -> DataFrame:
    """Consecutive equal values to ``(run, count, value)``."""
    looked = rows.scan(_i=O.index(), _before=O.prev(F.col(value)))
    changed = ~F.col("_before").eqNullSafe(F.col(value)) | (F.col("_i") == 1)
    runs = looked.scan(run=O.running_sum(F.when(changed, 1).otherwise(0)))
    return runs.df.groupBy(*rows.keys, "run", value).agg(F.count(F.lit(1)).alias("count"))


def track_edits(
    points: DataFrame, key: str, segment: str, movie_scale: int, media_scale: int
) -> DataFrame:
    """Edit entries of a multi-track key: initial gap, then one per later track."""
    bounds = points.groupBy(key, segment).agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    ranked = Ordered.of(bounds, [key], [segment], sized_by=[points]).scan(_i=O.index()).rows()
    first = F.col("_i") == 1
    out = ranked.filter(~first | (F.col("t0") > 0))
    return out.select(
        key,
        segment,
        F.when(first, -1).otherwise((F.col("t0") * media_scale).cast("bigint")).alias("media_time"),
        F.when(first, (F.col("t0") * movie_scale).cast("bigint"))
        .otherwise(((F.col("t1") - F.col("t0")) * movie_scale).cast("bigint"))
        .alias("segment_duration"),
    )


def multiplex(streams: dict[str, DataFrame]) -> DataFrame:
    """All measurement streams in one table, told apart by ``sensor``; negative times go."""
    tagged = [df.withColumn("sensor", F.lit(name)) for name, df in streams.items()]
    merged = tagged[0]
    for other in tagged[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return drop_negative_times(merged)


def drop_negative_times(measurements: DataFrame) -> DataFrame:
    return measurements.filter("time >= 0")


def unsorted_groups(
    points: DataFrame, keys: list[str], arrival: str, max_rows: int | None = None
) -> DataFrame:
    """Groups whose times decrease in arrival order, as error rows."""
    looked = Ordered.of(points, keys, [arrival], max_rows).scan(_before=O.prev(F.col("time")))
    bad = looked.rows().filter("_before > time").select(*keys).distinct()
    return bad.withColumn("error", R.error(R.VALIDATION, "The track goes back in time"))


def merge_segments(points: DataFrame, segment: str = "segment_id") -> DataFrame:
    """All tracks of a file as one: the segment is no longer part of the key."""
    return points.drop(segment)
