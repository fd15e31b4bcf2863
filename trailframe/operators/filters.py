"""GPS noise and outlier removal on point tracks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.functions import geo
from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators.blocks import by_size, carried_states, placed, with_states
from trailframe.operators.fold import stream_sorted
from trailframe.operators.ordered import Ordered, join_keys
from trailframe.operators.sequences import number_runs, with_step_distance
from trailframe.runtime import freeze, materialize

# Fixes to trust, highest dilution of precision (x100), GPS precision in metres.
GOOD_FIXES = (2, 3)
MAX_DOP100 = 1000
GPS_PRECISION_M = 15.0


def trusted_fix(fix: Column, fixes: tuple[int, ...] = GOOD_FIXES) -> Column:
    return fix.isNull() | fix.isin(*fixes)


def precise_enough(precision: Column, limit: float = MAX_DOP100) -> Column:
    return precision.isNull() | (precision <= limit)


def valid_fix(fix: Column) -> Column:
    """A GPS fix is absent, none (0), two- or three-dimensional."""
    return fix.isNull() | fix.isin(0, 2, 3)


def upper_whiskers(
    df: DataFrame, keys: list[str], value: str, tie: str, max_rows: int | None = None
) -> DataFrame:
    """Per group Q3 + 1.5 IQR with the median left out of both halves.

    The quartiles are read off at their exact ranks, so no group's values are
    ever gathered. Null below two values.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value, tie)
    ranked = Ordered.of(known, keys, [value, tie], max_rows, sized_by=[df]).scan(
        _i=O.index(), _n=O.group_total(F.lit(1))
    )
    half = F.expr("_n div 2")
    low, high = F.expr("(_n div 2 + 1) div 2"), F.expr("_n div 2 div 2 + 1")
    at = lambda rank: F.max(F.when(F.col("_i") == rank, F.col(value)))
    upper = F.col("_n") - half
    quartiles = ranked.df.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        ((at(low) + at(high)) / 2).alias("_q1"),
        ((at(upper + low) + at(upper + high)) / 2).alias("_q3"),
    )
    whisker = F.col("_q3") + (F.col("_q3") - F.col("_q1")) * 1.5
    return quartiles.select(*keys, F.when(F.col("_n") >= 2, whisker).alias("whisker"))


def majority_cluster(clusters: DataFrame, keys: list[str], size: str = "n") -> DataFrame:
    """The cluster with most points per group; the earliest one on ties."""
    sized = clusters.groupBy(*keys, "cluster").agg(F.sum(size).alias("_n"))
    best = F.max_by("cluster", F.struct(F.col("_n"), -F.col("cluster")))
    return sized.groupBy(*keys).agg(best.alias("cluster"))


def run_table(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per run: size, first and last position and time."""
    at = F.struct(*order)
    here = F.struct("time", "lat", "lon")
    return points.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(here, at).alias("head"), F.max_by(here, at).alias("tail")
    )


_MERGED = ["track", "run", "n", "cluster"]
_PLACE = ["t0", "x0", "y0", "z0", "t1", "x1", "y1", "z1"]
# Tracks of up to so many runs are merged by one task.
MAX_RUNS = 50_000


def _take(tails: list[tuple], head: tuple, max_speed: float) -> tuple | None:
    """Remove and return the earliest chain's tail from which a run's head can be reached."""
    t0, x0, y0, z0 = head
    for at, (_, t1, x1, y1, z1) in enumerate(tails):
        elapsed = abs(t0 - t1)
        if elapsed > 0 and ((x0 - x1) ** 2 + (y0 - y1) ** 2 + (z0 - z1) ** 2) ** 0.5 / elapsed <= max_speed:
            return tails.pop(at)
    return None


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tracks in order: each run goes on the earliest chain that reaches it, or begins one.

    That is what comes out when each run in turn takes the first later free run
    in its reach: either way a pair is joined unless one of both has an earlier
    partner. Only the chains' tails are held. No two places are farther apart
    than the Earth is wide, so a tail that old is reached by any run, and no
    chain begins while there is one: tails are no more than the runs of that time.
    """
    track, tails, label = None, [], {}
    for batch in batches:
        clusters = []
        columns = [batch[c].tolist() for c in ("track", "run", "max_speed", *_PLACE)]
        for own, run, speed, *place in zip(*columns):
            if own != track:
                track, tails, label = own, [], {}
            found = _take(tails, place[:4], speed)
            cluster = run if found is None else label.pop(found[0])
            label[run] = cluster
            tails.append((run, *place[4:]))
            clusters.append(cluster)
        yield batch[["track", "run", "n"]].assign(cluster=clusters)


def _chain(rows: pd.DataFrame, state: list[float]) -> tuple[pd.DataFrame, list[float]]:
    """A block of a track: which chain each run is on, by its first run here or the tail it came in on (``via``)."""
    tails = [tuple(state[i : i + 5]) for i in range(0, len(state), 5)]
    label = {t[0]: (-1, int(t[0])) for t in tails}
    out = []
    for run, speed, *place in zip(*[rows[c].tolist() for c in ("run", "max_speed", *_PLACE)]):
        found = _take(tails, place[:4], speed)
        on = (run, -1) if found is None else label.pop(found[0])
        label[run] = on
        tails.append((float(run), *place[4:]))
        out.append(on)
    found = pd.DataFrame({"_g": rows["_g"], "run": rows["run"], "head": [h for h, _ in out], "via": [v for _, v in out]})
    return found, [float(x) for t in tails for x in t]


def _merge_large(flat: DataFrame, report: dict | None) -> DataFrame:
    """``_g, run, cluster`` of tracks whose runs are dealt into blocks."""
    slim = freeze(placed(flat, ["run"]).select("_g", "_i", "_block", "run", "max_speed", *_PLACE))
    states = carried_states(slim, _chain, report)
    on = materialize(with_states(slim, states, _chain, "_g bigint, run bigint, head bigint, via bigint"), "chains")
    # Follow the tails that blocks hand on to the runs that began their chains, doubling the way in each round.
    handed = states.select("_g", F.explode(F.filter("entry", lambda x, i: i % 5 == 0).cast("array<bigint>")).alias("run")).distinct()
    ways = materialize(on.join(handed, ["_g", "run"]), "handed")
    while not ways.filter("head < 0").isEmpty():
        beyond = ways.select("_g", F.col("run").alias("via"), F.col("head").alias("_head"), F.col("via").alias("_via"))
        joined = ways.join(beyond, ["_g", "via"], "left")
        known = F.col("head") >= 0
        ways = materialize(
            joined.select("_g", "run", F.when(known, F.col("head")).otherwise(F.col("_head")).alias("head"), F.when(known, F.col("via")).otherwise(F.col("_via")).alias("via")),
            "handed",
        )
    ends = ways.select("_g", F.col("run").alias("via"), F.col("head").alias("begun"))
    return on.join(ends, ["_g", "via"], "left").select("_g", "run", F.when(F.col("head") >= 0, F.col("head")).otherwise(F.col("begun")).alias("cluster"))


def merge_runs(runs: DataFrame, key: str, max_speed: str = "max_speed", report: dict | None = None) -> DataFrame:
    """One-dimensional density merge of a track's runs into clusters; run numbers are not negative."""
    start = geo.ecef(F.col("head.lat"), F.col("head.lon"))
    end = geo.ecef(F.col("tail.lat"), F.col("tail.lon"))
    flat = runs.select(
        F.col(key).alias("track"), "run", "n", F.col(max_speed).alias("max_speed"),
        F.col("head.time").alias("t0"), F.col("tail.time").alias("t1"), start.alias("a"), end.alias("b"),
    )
    flat = flat.select(
        "track", F.col("run").cast("bigint").alias("run"), "n", "max_speed", "t0", "t1",
        *[F.col(f"a.{c}").alias(f"{c}0") for c in "xyz"],
        *[F.col(f"b.{c}").alias(f"{c}1") for c in "xyz"],
    )
    small, large = by_size(flat, ["track"], MAX_RUNS)
    track = T.StructField("track", runs.schema[key].dataType)
    schema = T.StructType([track, *[T.StructField(c, T.LongType()) for c in _MERGED[1:]]])
    out = stream_sorted(small, ["track"], ["run"], _merge, schema)
    if large is not None:
        large = materialize(large, "large-tracks")
        merged = large.select("_g", "track", "run", "n").join(_merge_large(large, report), ["_g", "run"])
        out = out.unionByName(merged.select(*_MERGED))
    return out.withColumnRenamed("track", key)


def mark_outliers(
    points: DataFrame, key: str, order: list[str], precision: float = GPS_PRECISION_M, max_rows: int | None = None
) -> DataFrame:
    """Flag points outside the main cluster of their track (column ``outlier``).

    Tracks with fewer than two steps or two known speeds pass unchanged.
    """
    tracks = Ordered.of(points, [key], order, max_rows)
    stepped = with_step_distance(tracks, "_step")
    steps = stepped.rows().select(key, "_step", order[-1])
    reach = upper_whiskers(steps, [key], "_step", order[-1], max_rows).withColumnRenamed("whisker", "_reach")
    speeds = points.select(key, "ground_speed", order[-1])
    pace = upper_whiskers(speeds, [key], "ground_speed", order[-1], max_rows)
    limits = join_keys(reach, pace.withColumnRenamed("whisker", "max_speed"), [key])
    judged = limits.filter("_reach IS NOT NULL AND max_speed IS NOT NULL").withColumn(
        "_reach", F.greatest(F.lit(2 * precision), F.col("_reach"))
    )
    joined = stepped.with_df(stepped.df.join(judged, key, "left"))
    split = number_runs(joined, F.col("_step") > F.col("_reach"))
    known = split.df.filter("max_speed IS NOT NULL")
    runs = run_table(known, [key, "max_speed"], order)
    # Runs are few next to points; cutting here keeps the fold from running twice.
    clusters = freeze(merge_runs(runs, key))
    best = majority_cluster(clusters, [key]).withColumnRenamed("cluster", "_best")
    members = clusters.join(best, key).select(
        key, "run", (F.col("cluster") != F.col("_best")).alias("outlier")
    )
    flagged = split.rows().join(members, [key, "run"], "left")
    return flagged.withColumn("outlier", F.coalesce("outlier", F.lit(False))).drop(
        "run", "_step", "_reach", "max_speed"
    )


def remove_outliers(points: DataFrame, key: str, order: list[str], precision: float = GPS_PRECISION_M) -> DataFrame:
    return mark_outliers(points, key, order, precision).filter(~F.col("outlier")).drop("outlier")


def remove_noisy_points(points: DataFrame, key: str, order: list[str], precision: float = GPS_PRECISION_M) -> DataFrame:
    """Untrusted fixes, then imprecise points, then outliers."""
    kept = points.filter(trusted_fix(F.col("fix")) & precise_enough(F.col("precision")))
    return remove_outliers(kept, key, order, precision)


def classify_videos(
    videos: DataFrame, points: DataFrame, key: str, order: list[str], precision: float = GPS_PRECISION_M
) -> DataFrame:
    """Outcome per video: its file type, or why its GPS data is unusable.

    ``videos`` says whether a telemetry track exists (``has_track``) and whether
    its vendor's points go through the noise filter (``is_gopro``).
    """
    filtered = points.join(videos.filter("is_gopro").select(key), key, "left_semi")
    clean = remove_noisy_points(filtered, key, order, precision)
    raw_n = points.groupBy(key).agg(F.count(F.lit(1)).alias("_raw"))
    clean_n = clean.groupBy(key).agg(F.count(F.lit(1)).alias("_clean"))
    joined = videos.join(raw_n, key, "left").join(clean_n, key, "left")
    not_found = R.error(R.VIDEO_GPS_NOT_FOUND, "The video has no telemetry track")
    verdict = (
        F.when(~F.col("has_track"), not_found)
        .when(F.col("_raw").isNull(), R.error(R.GPX_EMPTY, "The telemetry track has no points"))
        .when(F.col("is_gopro") & F.col("_clean").isNull(), R.error(R.GPS_NOISE, "No point of the track is trusted"))
    )
    filetype = F.when(F.col("is_gopro"), "gopro").otherwise("video")
    return joined.withColumns({"error": verdict, "filetype": filetype}).drop("_raw", "_clean")
