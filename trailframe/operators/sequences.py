"""From loose captures to clean, ordered, numbered sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.functions import geo
from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators.blocks import by_size, last_kept, placed, total_splits
from trailframe.operators.fold import MAX_ARRAY_ROWS, fold_bounded, split_runs
from trailframe.operators.ordered import Ordered
from trailframe.runtime import materialize


@dataclass(frozen=True)
class Limits:
    """The defaults of every check, in metres, seconds, degrees, bytes."""

    cutoff_distance: float = 100.0
    cutoff_time: float = 60.0
    duplicate_distance: float = 0.1
    duplicate_angle: float = 5.0
    max_speed_kmh: float = 400.0
    max_images: int | None = 1000
    max_bytes: int | None = 110 * 1024**3
    max_pixels: int | None = 6_000_000_000
    zigzag_window: int = 5
    zigzag_ratio: float = 0.8
    zigzag_min_count: int = 1
    zigzag_jump: float = 30.0
    stationary_radius: float = 10.0


# Folder and camera: captures that share all of these form one group.
GROUP_KEYS = ["folder", "camera_uuid", "make", "model", "width", "height"]

DEFAULT_SIDE_PX = 1024


def group_key(columns: list[str] | None = None) -> Column:
    """One non-null text per distinct key; nulls group together."""
    return F.to_json(F.struct(*(columns or GROUP_KEYS)))


# -- time repair -----------------------------------------------------------


def repair_subseconds(captures: Ordered, time: str = "time") -> Ordered:
    """Spread captures that share a millisecond up to the next one or full second."""
    bucket = (F.col(time) * 1000).cast("bigint")
    marked = captures.scan(_i=O.index(), _before=O.prev(bucket), _n=O.group_total(F.lit(1)))
    opens = F.col("_before").isNull() | (F.col("_before") != bucket)
    head = F.when(opens, F.struct(F.col("_i").alias("i"), F.col(time).alias("t")))
    spread = marked.scan(_head=O.last_known(head), _following=O.next_known(head, current=False))
    t0, i0 = F.col("_head.t"), F.col("_head.i")
    second = F.floor(t0 + 1.0).cast("double")
    until = F.least(F.coalesce(F.col("_following.t"), second), second)
    size = F.coalesce(F.col("_following.i"), F.col("_n") + 1) - i0
    repaired = F.when(size > 1, t0 + (F.col("_i") - i0) * ((until - t0) / size)).otherwise(F.col(time))
    out = spread.add(**{time: repaired})
    return out.drop("_i", "_before", "_n", "_head", "_following")


# -- run splitting ----------------------------------------------------------


def number_runs(rows: Ordered, breaks: Column, name: str = "run") -> Ordered:
    """1-based run number; a row where ``breaks`` holds starts a new run.

    The first row opens run 1 whatever its flag says.
    """
    flagged = rows.scan(_at=O.index())
    starts = F.when((F.col("_at") == 1) | F.coalesce(breaks, F.lit(False)), 1).otherwise(0)
    return flagged.scan(**{name: O.running_sum(starts)}).drop("_at")


def split_when(rows: Ordered, decide, name: str = "run") -> Ordered:
    """Start a run wherever ``decide(previous, current)`` (structs) holds."""
    fields = [c for c in rows.df.columns if c != O.TILE]
    paired = rows.scan(_prev=O.prev(F.struct(*fields)))
    here = F.struct(*fields)
    flag = decide(F.col("_prev"), here)
    return number_runs(paired, flag, name).drop("_prev")


def split_by_count(captures: Ordered, max_images: int, name: str = "run") -> Ordered:
    """Blocks of ``max_images`` counted over the whole group."""
    numbered = captures.scan(_i=O.index())
    return numbered.add(**{name: F.expr(f"(_i - 1) div {max_images} + 1")}).drop("_i")


def split_by_time_gap(captures: Ordered, cutoff: float, name: str = "run") -> Ordered:
    with_prev = captures.scan(_pt=O.prev(F.col("time")))
    return number_runs(with_prev, F.col("time") - F.col("_pt") > cutoff, name).drop("_pt")


def split_by_distance_gap(captures: Ordered, cutoff: float, name: str = "run") -> Ordered:
    with_prev = with_step_distance(captures, "_step")
    return number_runs(with_prev, F.col("_step") > cutoff, name).drop("_step")


def with_step_distance(captures: Ordered, name: str) -> Ordered:
    """Chord distance from the previous row (null on the first)."""
    paired = captures.add(at_xyz=geo.ecef(F.col("lat"), F.col("lon"))).scan(_p=O.prev(F.col("at_xyz")))
    return paired.add(**{name: F.expr(geo.chord_sql("_p", "at_xyz"))}).drop("at_xyz", "_p")


def split_by_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    amount: Column,
    limit: int,
    name: str = "part",
    max_rows: int | None = None,
    carry: bool = True,
) -> DataFrame:
    """Split where the running total passes ``limit``; it restarts at each split.

    It restarts with the splitting row's amount (``carry``) or with nothing. A
    missing amount counts as nothing; amounts are not negative.
    """
    valued = df.withColumn("step_amount", F.coalesce(amount.cast("bigint"), F.lit(0)))
    bounded = max_rows is not None and max_rows <= MAX_ARRAY_ROWS
    small, large = (valued, None) if bounded else by_size(valued, keys, MAX_ARRAY_ROWS)

    def step(total: Column, row: Column) -> tuple[Column, Column]:
        over = total + row["step_amount"] > limit
        return F.when(over, row["step_amount"] if carry else F.lit(0)).otherwise(total + row["step_amount"]), over

    out = split_runs(small, keys, order, F.lit(0), "bigint", step, name)
    if large is not None:
        rows = placed(large, order)
        splits = total_splits(rows, "step_amount", limit, carry).withColumn("_split", F.lit(1))
        flagged = rows.join(splits, ["_g", "_i"], "left")
        numbered = Ordered.of(flagged, ["_g"], ["_i"]).scan(**{name: O.running_sum(F.coalesce("_split", F.lit(0)))}).rows()
        out = out.unionByName(numbered.withColumn(name, F.col(name).cast("int")).drop("_g", "_i", "_block", "_split"))
    return out.drop("step_amount")


def pixels() -> Column:
    """Pixel count, with a default side where the size is unknown."""
    side = F.lit(DEFAULT_SIDE_PX)
    return F.coalesce(F.col("width"), side).cast("bigint") * F.coalesce(F.col("height"), side)


def split_by_limits(captures: Ordered, limits: Limits, by_distance: bool = False) -> DataFrame:
    """Count, time, distance, byte and pixel rules together.

    A piece is ``(run, _by_bytes, _by_pixels)`` inside its group.

    Counting ignores the other rules; bytes restart at count and time splits;
    pixels restart at all of them.
    """
    runs = _count_and_time_runs(captures, limits, by_distance)
    keys, order = [*captures.keys, "run"], captures.order
    df = runs.rows()
    bound = limits.max_images
    if limits.max_bytes is not None:
        size = F.coalesce(F.col("filesize"), F.lit(0))
        df = split_by_total(df, keys, order, size, limits.max_bytes, "_by_bytes", bound)
    else:
        df = df.withColumn("_by_bytes", F.lit(0))
    if limits.max_pixels is not None:
        keys = [*keys, "_by_bytes"]
        df = split_by_total(df, keys, order, pixels(), limits.max_pixels, "_by_pixels", bound)
    else:
        df = df.withColumn("_by_pixels", F.lit(0))
    return df


def _count_and_time_runs(captures: Ordered, limits: Limits, by_distance: bool = False) -> Ordered:
    marked = captures.scan(_i=O.index(), _pt=O.prev(F.col("time")))
    splits = F.col("_i") == 1
    if by_distance:
        marked = with_step_distance(marked, "_step")
        splits = splits | F.coalesce(F.col("_step") > limits.cutoff_distance, F.lit(False))
    if limits.max_images is not None:
        splits = splits | (F.col("_i") % limits.max_images == (1 if limits.max_images > 1 else 0))
    if limits.cutoff_time is not None:
        splits = splits | F.coalesce(F.col("time") - F.col("_pt") > limits.cutoff_time, F.lit(False))
    flag = F.when(splits, 1).otherwise(0)
    return marked.scan(run=O.running_sum(flag)).drop("_i", "_pt", "_step")


# -- checks -------------------------------------------------------------------


def on_null_island(lat: Column, lon: Column) -> Column:
    return (lat == 0) & (lon == 0)


def mark_duplicates(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    max_distance: float,
    max_angle: float,
    max_rows: int | None = None,
    report: dict | None = None,
) -> DataFrame:
    """Compare every row with the last kept one; adds ``duplicate``, ``distance``, ``angle_diff``.

    A row without a position (null or not a number) is no duplicate and isn't
    compared with; an unknown heading agrees with any.
    """
    located = df.withColumn("at_xyz", geo.ecef(F.col("lat"), F.col("lon")))
    bounded = max_rows is not None and max_rows <= MAX_ARRAY_ROWS
    small, large = (located, None) if bounded else by_size(located, keys, MAX_ARRAY_ROWS)

    def step(state: Column, row: Column) -> tuple[Column, Column]:
        verdict = _duplicate_of(state["xyz"], state["angle"], row, max_distance, max_angle)
        kept = F.struct(row["at_xyz"].alias("xyz"), known(row["angle"]).alias("angle"))
        return F.when(verdict["duplicate"] | ~placed_at(row["at_xyz"]), state).otherwise(kept), verdict

    xyz = "struct<x:double,y:double,z:double>"
    init = F.struct(F.lit(None).cast(xyz).alias("xyz"), F.lit(None).cast("double").alias("angle"))
    verdict_type = "struct<duplicate:boolean,distance:double,angle_diff:double>"
    out = fold_bounded(small, keys, order, init, f"struct<xyz:{xyz},angle:double>", verdict_type, step)
    if large is None:
        return out.drop("at_xyz")

    def judge(kept, rows):
        n = len(rows["at_x"])
        nothing = {"duplicate": np.zeros(n, bool), "distance": np.full(n, np.nan), "angle_diff": np.full(n, np.nan)}
        if kept is None:
            return np.ones(n, bool), nothing
        distance = np.sqrt(sum((kept[c] - rows[c]) ** 2 for c in ("at_x", "at_y", "at_z")))
        gap = np.abs(rows["angle"] - kept["angle"])
        diff = np.where(gap > 180, 360 - gap, gap)
        duplicate = (distance <= max_distance) & (np.isnan(diff) | (diff <= max_angle))
        return ~duplicate, {"duplicate": duplicate, "distance": distance, "angle_diff": diff}

    outs = T.StructType().add("duplicate", "boolean").add("distance", "double").add("angle_diff", "double")
    inputs = {**{f"at_{c}": F.col(f"at_xyz.{c}") for c in "xyz"}, "angle": F.col("angle")}
    folded = last_kept(placed(large, order), inputs, "at_x", judge, outs, report)
    return out.unionByName(folded).drop("at_xyz")


def known(value: Column) -> Column:
    """Null where the value isn't a number."""
    return F.when(~F.isnan(value), value)


def placed_at(xyz: Column) -> Column:
    total = xyz["x"] + xyz["y"] + xyz["z"]
    return total.isNotNull() & ~F.isnan(total)


def _duplicate_of(
    kept_xyz: Column, kept_angle: Column, row: Column, max_distance: float, max_angle: float
) -> Column:
    here = placed_at(row["at_xyz"])
    distance = F.when(here, geo.chord(kept_xyz, row["at_xyz"]))
    diff = geo.diff_bearing(kept_angle, known(row["angle"]))
    close = F.coalesce(distance <= max_distance, F.lit(False))
    aligned = diff.isNull() | (diff <= max_angle)
    return F.struct(
        (close & aligned).alias("duplicate"),
        distance.alias("distance"),
        F.when(kept_xyz.isNotNull() & here, diff).alias("angle_diff"),
    )


def fill_headings(captures: Ordered, reset: bool = False) -> Ordered:
    """Missing heading: bearing to the next row; the last row repeats the one before."""
    start = captures.add(angle=F.lit(None).cast("double")) if reset else captures
    looked = start.scan(_next=O.nxt(F.struct("lat", "lon")))
    toward = geo.bearing(F.col("lat"), F.col("lon"), F.col("_next.lat"), F.col("_next.lon"))
    turned = looked.add(_filled=F.coalesce(F.col("angle"), toward))
    carried = turned.scan(_last=O.prev(F.col("_filled")))
    angle = F.coalesce(F.col("_filled"), F.col("_last"), F.lit(0.0))
    return carried.add(angle=angle).drop("_next", "_filled", "_last")


def mark_zigzag(captures: Ordered, limits: Limits, name: str = "zigzag") -> Ordered:
    """Flag captures that jump away from the path and back.

    ``_depth`` says how many rows before this one are outliers seen from here.
    """
    window = limits.zigzag_window
    located = captures.add(at_xyz=geo.ecef(F.col("lat"), F.col("lon")))
    looked = located.scan(
        _count=O.group_total(F.lit(1)),
        **{f"_b{k}": O.prev(F.col("at_xyz"), k) for k in range(1, window + 1)},
    )
    ref = f"_b{window}"
    back = geo.chord_sql("at_xyz", ref)
    depth = "0"
    for k in reversed(range(1, window)):
        jumped = f"{geo.chord_sql(f'_b{k}', 'at_xyz')} > {limits.zigzag_jump!r}D"
        nearer = f"{back} < {geo.chord_sql(f'_b{k}', ref)} * {limits.zigzag_ratio!r}D"
        depth = f"CASE WHEN coalesce({jumped} AND {nearer}, false) THEN 1 + {depth} ELSE 0 END"
    deep = looked.add(_depth=F.expr(depth))
    ahead = deep.scan(**{f"_a{k}": O.nxt(F.col("_depth"), k) for k in range(1, window)})
    hit = F.expr(" OR ".join(f"coalesce(_a{k} >= {k}, false)" for k in range(1, window)))
    flagged = ahead.add(_hit=(hit & (F.col("_count") > window)).cast("int"))
    counted = flagged.scan(_hits=O.group_total(F.col("_hit")))
    verdict = (F.col("_hit") == 1) & (F.col("_hits") >= limits.zigzag_min_count)
    temps = ["at_xyz", "_count", "_depth", "_hit", "_hits"]
    temps += [f"_b{k}" for k in range(1, window + 1)] + [f"_a{k}" for k in range(1, window)]
    return counted.add(**{name: verdict}).drop(*temps)


def average_speed(
    distance: Column, first_time: Column, last_time: Column, first_epoch=None, last_epoch=None
) -> Column:
    """Metres per second over a path; null when no time passes."""
    elapsed = last_time - first_time
    if first_epoch is not None:
        valid = (first_epoch > 0) & (last_epoch > 0)
        elapsed = F.when(F.coalesce(valid, F.lit(False)), last_epoch - first_epoch).otherwise(elapsed)
    return F.try_divide(distance, elapsed)


def path_stats(points: Ordered, epoch: str | None = None) -> DataFrame:
    """Per group: ``n``, path ``length`` and average ``speed`` (0 below two rows)."""
    stepped = with_step_distance(points, "_step")
    at = F.struct(*[F.col(o) for o in points.order])
    time = F.col("time")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"),
        F.min_by(time, at).alias("_t0"),
        F.max_by(time, at).alias("_t1"),
    ]
    ends = []
    if epoch:
        aggs += [F.min_by(epoch, at).alias("_e0"), F.max_by(epoch, at).alias("_e1")]
        ends = [F.col("_e0"), F.col("_e1")]
    grouped = stepped.df.groupBy(*points.keys).agg(*aggs)
    speed = average_speed(F.col("length"), F.col("_t0"), F.col("_t1"), *ends)
    out = grouped.withColumn("speed", F.when(F.col("n") < 2, 0.0).otherwise(speed))
    return out.drop("_t0", "_t1", "_e0", "_e1")


def mark_too_fast(captures: Ordered, max_speed_kmh: float, name: str = "too_fast") -> Ordered:
    """Flag every row of a group whose average speed is over the limit."""
    stepped = with_step_distance(captures, "_step").scan(
        _n=O.group_total(F.lit(1)),
        _length=O.group_total(F.col("_step")),
        _t0=O.group_min(F.col("time")),
        _t1=O.group_max(F.col("time")),
    )
    kmh = average_speed(F.col("_length"), F.col("_t0"), F.col("_t1")) * 3.6
    fast = F.coalesce((F.col("_n") >= 2) & (kmh > max_speed_kmh), F.lit(False))
    out = stepped.add(**{name: fast, f"{name}_kmh": kmh})
    return out.drop("_step", "_n", "_length", "_t0", "_t1")


# -- videos -------------------------------------------------------------------


def video_shape(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per video: point count, radius around the first point, null-island flag, speed.

    Every row gets its video's first position and its step in one pass over the
    ordered rows; one grouping by the same keys follows.
    """
    at = F.struct(*[F.col(o) for o in order])
    ordered = Ordered.of(points, keys, order).scan(_first=O.group_min(F.struct(at.alias("at"), "lat", "lon")))
    stepped = with_step_distance(ordered, "_step").df
    off = geo.gps_distance(F.col("_first.lat"), F.col("_first.lon"), F.col("lat"), F.col("lon"))
    shape = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"),
        F.min_by("time", at).alias("_t0"),
        F.max_by("time", at).alias("_t1"),
        F.max(off).alias("radius"),
        F.bool_or(on_null_island(F.col("lat"), F.col("lon"))).alias("null_island"),
    )
    speed = average_speed(F.col("length"), F.col("_t0"), F.col("_t1"))
    return shape.withColumn("speed", F.when(F.col("n") < 2, 0.0).otherwise(speed)).drop("_t0", "_t1")


def check_videos(
    videos: DataFrame, points: DataFrame, key: str, order: list[str], limits: Limits
) -> DataFrame:
    """First failing rule wins: stationary, too large, null island, too fast."""
    shape = video_shape(points, [key], order)
    joined = videos.join(shape, key, "left")
    kmh = F.col("speed") * 3.6
    still = F.coalesce(F.col("radius") <= limits.stationary_radius, F.lit(True))
    large = F.lit(False) if limits.max_bytes is None else F.col("filesize") > limits.max_bytes
    fast = (F.col("n") >= 2) & (kmh > limits.max_speed_kmh)
    speed_text = F.format_string(
        "moves at %.3f km/h where %.3f km/h are allowed", kmh, F.lit(limits.max_speed_kmh)
    )
    verdict = (
        F.when(still, R.error(R.STATIONARY_VIDEO, "track stays within the stationary radius"))
        .when(large, R.error(R.FILE_TOO_LARGE, "file is larger than allowed"))
        .when(F.col("null_island"), R.error(R.NULL_ISLAND, "position is latitude 0, longitude 0"))
        .when(fast, R.error(R.TOO_FAST, speed_text))
    )
    return joined.withColumn("error", verdict)


# -- the whole flow -------------------------------------------------------------


def _check_runs(df: DataFrame, keys: list[str], order: list[str], limits: Limits) -> DataFrame:
    """One fold per count/time run: byte and pixel splits, null island, duplicates."""
    prepared = df.withColumns(
        {
            "at_xyz": geo.ecef(F.col("lat"), F.col("lon")),
            "_bytes": F.coalesce(F.col("filesize"), F.lit(0)).cast("bigint"),
            "_px": pixels(),
        }
    )
    no_limit = 2**62
    max_bytes = no_limit if limits.max_bytes is None else limits.max_bytes
    max_px = no_limit if limits.max_pixels is None else limits.max_pixels
    xyz = "struct<x:double,y:double,z:double>"
    state_type = f"struct<sub:int,bytes:bigint,px:bigint,xyz:{xyz},angle:double>"
    out_type = "struct<sub:int,issue:string,distance:double,angle_diff:double>"

    def step(state: Column, row: Column) -> tuple[Column, Column]:
        total_bytes = state["bytes"] + row["_bytes"]
        total_px = state["px"] + row["_px"]
        opening = state["sub"] < 0
        by_bytes = opening | (total_bytes > max_bytes)
        split = by_bytes | (total_px > max_px)
        nothing = F.lit(None)
        kept_xyz = F.when(split, nothing).otherwise(state["xyz"])
        kept_angle = F.when(split, nothing).otherwise(state["angle"])
        verdict = _duplicate_of(
            kept_xyz, kept_angle, row, limits.duplicate_distance, limits.duplicate_angle
        )
        island = on_null_island(row["lat"], row["lon"])
        dropped = F.coalesce(island, F.lit(False)) | verdict["duplicate"] | ~placed_at(row["at_xyz"])
        sub = state["sub"] + F.when(split, 1).otherwise(0)
        next_state = F.struct(
            sub.alias("sub"),
            F.when(by_bytes, row["_bytes"]).otherwise(total_bytes).alias("bytes"),
            F.when(split, row["_px"]).otherwise(total_px).alias("px"),
            F.when(dropped, kept_xyz).otherwise(row["at_xyz"]).alias("xyz"),
            F.when(dropped, kept_angle).otherwise(known(row["angle"])).alias("angle"),
        )
        issue = F.when(island, R.NULL_ISLAND).when(verdict["duplicate"], R.DUPLICATION)
        out = F.struct(
            sub.alias("sub"),
            issue.alias("issue"),
            F.when(issue == R.DUPLICATION, verdict["distance"]).alias("distance"),
            F.when(issue == R.DUPLICATION, verdict["angle_diff"]).alias("angle_diff"),
        )
        return next_state, out

    init = F.struct(
        F.lit(-1).alias("sub"),
        F.lit(0).alias("bytes"),
        F.lit(0).alias("px"),
        F.lit(None).cast(xyz).alias("xyz"),
        F.lit(None).cast("double").alias("angle"),
    )
    folded = fold_bounded(prepared, keys, order, init, state_type, out_type, step)
    return folded.drop("at_xyz", "_bytes", "_px")


def _check_runs_unbounded(
    df: DataFrame, keys: list[str], order: list[str], limits: Limits
) -> DataFrame:
    """The same checks where a run may have any number of rows."""
    size = F.coalesce(F.col("filesize"), F.lit(0))
    out = df.withColumn("_b", F.lit(0)).withColumn("_p", F.lit(0))
    if limits.max_bytes is not None:
        out = split_by_total(out.drop("_b"), keys, order, size, limits.max_bytes, "_b")
    if limits.max_pixels is not None:
        out = split_by_total(out.drop("_p"), [*keys, "_b"], order, pixels(), limits.max_pixels, "_p")
    out = out.withColumn("_island", on_null_island(F.col("lat"), F.col("lon")))
    subs = [*keys, "_b", "_p", "_island"]
    out = mark_duplicates(out, subs, order, limits.duplicate_distance, limits.duplicate_angle)
    issue = F.when(F.col("_island"), R.NULL_ISLAND).when(F.col("duplicate"), R.DUPLICATION)
    # (bytes part, pixel part) ordered as one number; neither part reaches 2**31.
    sub = F.col("_b").cast("bigint") * F.lit(2**31) + F.col("_p")
    marked = out.withColumn("issue", issue).withColumn("sub", sub)
    for name in ("distance", "angle_diff"):
        marked = marked.withColumn(name, F.when(F.col("issue") == R.DUPLICATION, F.col(name)))
    return marked.drop("_b", "_p", "_island", "duplicate")


def clean_captures(
    captures: DataFrame,
    limits: Limits = Limits(),
    reset_headings: bool = False,
    skip_zigzag: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """All capture checks in their fixed order, before the final numbering.

    Every input row comes back once, either in a sequence (``issue`` null) or
    with the first check it failed. A sequence is ``(group_key, seq)``.
    """
    keyed = captures.withColumns({"group_key": group_key(), "_sort": F.col("time")})
    grouped = Ordered.of(keyed, ["group_key"], ["_sort", "basename"], max_rows, sized_by=[keyed], spread=True)
    order = grouped.order
    runs = _count_and_time_runs(repair_subseconds(grouped), limits)
    bounded = limits.max_images is not None and limits.max_images <= MAX_ARRAY_ROWS
    check = _check_runs if bounded else _check_runs_unbounded
    checked = check(runs.df, ["group_key", "run"], order, limits)

    # From here a sequence is a run part; rows already rejected sit apart.
    checked = checked.withColumn("_ok", F.col("issue").isNull())
    keys = ["group_key", "run", "sub", "_ok"]
    parts = Ordered(checked, keys, order) if bounded else Ordered.of(checked, keys, order)
    parts = mark_too_fast(fill_headings(parts, reset_headings), limits.max_speed_kmh)
    if skip_zigzag:
        parts = parts.add(zigzag=F.lit(False))
    else:
        parts = mark_zigzag(parts, limits)
    later = F.when(F.col("too_fast"), R.TOO_FAST).when(F.col("zigzag"), R.ZIGZAG)
    parts = parts.add(issue=F.coalesce(F.col("issue"), later))
    parts = parts.add(_ok=F.col("issue").isNull()).drop("too_fast", "too_fast_kmh", "zigzag")
    stepped = with_step_distance(parts, "_step")

    # Kept rows of a group in order: a new sequence at a new part or a long step.
    tiled = grouped.tiled
    kept = Ordered(stepped.df, ["group_key", "_ok"], order, tiled)
    kept = kept.scan(_before=O.prev(F.struct("run", "sub")))
    opens = ~F.col("_before").eqNullSafe(F.struct("run", "sub")) | (
        F.coalesce(F.col("_step") > limits.cutoff_distance, F.lit(False))
    )
    kept = kept.scan(seq=O.running_sum(F.when(opens, 1).otherwise(0)))
    done = kept.rows().withColumn("seq", F.when(F.col("_ok"), F.col("seq")))
    return done.drop("_sort", "_ok", "_step", "_before", "run", "sub")


def number_sequences(cleaned: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Dense 0-based ``sequence_id`` ordered by group, then start.

    Groups, not rows, are numbered globally: each group gets the number of
    sequences before it and adds its own ``seq``.
    """
    stored = materialize(cleaned, "sequences")
    groups = stored.groupBy("group_key").agg(F.max("seq").alias("_n"))
    groups = groups.filter("_n IS NOT NULL")
    ranked = Ordered.of(groups, [], ["group_key"], max_rows).scan(_upto=O.running_sum(F.col("_n")))
    offsets = ranked.rows().select("group_key", (F.col("_upto") - F.col("_n")).alias("_offset"))
    joined = stored.join(offsets, "group_key", "left")
    return joined.withColumn("sequence_id", F.col("_offset") + F.col("seq") - 1).drop("_offset")


def issue_to_error(issue: Column, limits: Limits) -> Column:
    """Error struct for the issue names produced by ``clean_captures``."""
    duplicate = (
        f"within {limits.duplicate_distance} m and {limits.duplicate_angle} degrees of the capture kept before it"
    )
    return (
        F.when(issue == R.NULL_ISLAND, R.error(R.NULL_ISLAND, "position is latitude 0, longitude 0"))
        .when(
            issue == R.DUPLICATION,
            R.error(R.DUPLICATION, duplicate, distance=F.col("distance"), angle_diff=F.col("angle_diff")),
        )
        .when(
            issue == R.TOO_FAST,
            R.error(R.TOO_FAST, f"moves faster than {limits.max_speed_kmh:.3f} km/h"),
        )
        .when(issue == R.ZIGZAG, R.error(R.ZIGZAG, "track turns back and forth"))
    )


def process_captures(
    captures: DataFrame,
    limits: Limits = Limits(),
    reset_headings: bool = False,
    skip_zigzag: bool = False,
) -> DataFrame:
    """Captures in, numbered sequences and error rows out."""
    cleaned = clean_captures(captures, limits, reset_headings, skip_zigzag)
    numbered = number_sequences(cleaned)
    out = numbered.withColumn("error", issue_to_error(F.col("issue"), limits))
    return out.drop("issue", "distance", "angle_diff", "seq", "group_key")
