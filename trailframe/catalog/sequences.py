"""Grouping, splitting and cleaning of capture sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, sql_bearing, sql_dist, sql_x, sql_y, sql_z, table
from trailframe.functions import geo
from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators import sequences as S
from trailframe.operators.ordered import Ordered

# Parameters fit for the sparse synthetic tracks (hours and hundreds of metres apart).
LIMITS = S.Limits(
    cutoff_distance=1000.0,
    cutoff_time=43200.0,
    duplicate_distance=150.0,
    duplicate_angle=90.0,
    max_speed_kmh=0.08,
    max_images=40,
    max_bytes=700,
    max_pixels=30_000_000,
    zigzag_jump=300.0,
)
ORDER = ["time", "ord"]
GK = (
    "folder || '|' || coalesce(camera_uuid, '~') || '|' || coalesce(make, '~') || '|' || model"
    " || '|' || coalesce(width::VARCHAR, '~') || '|' || coalesce(height::VARCHAR, '~')"
)
W = "(PARTITION BY track_id ORDER BY time, ord)"
STEP = sql_dist("plat", "plon", "lat", "lon")
STEPS = f"""{CAP}, pairs AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
    lag(time) OVER w AS ptime, row_number() OVER w AS i FROM cap WINDOW w AS {W}),
  steps AS (SELECT *, {STEP} AS step FROM pairs)"""


def tracks(spark, sf_dir, *drop) -> Ordered:
    return Ordered.of(captures(spark, sf_dir).drop(*drop), ["track_id"], ORDER)


@query(
    "a1_group_by_folder_and_camera",
    f"""WITH {CAP} SELECT folder, camera_uuid, make, model, width, height::BIGINT AS height, count(*) AS n,
      min(time) AS first_time FROM cap GROUP BY ALL""",
)
def a1(spark, sf_dir):
    df = captures(spark, sf_dir)
    return df.groupBy(*S.GROUP_KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"))


@query(
    "a3_path_length_and_speed",
    f"""WITH {STEPS} SELECT track_id, count(*) AS n, round(coalesce(sum(step), 0), 4) AS length,
      CASE WHEN count(*) < 2 THEN 0 ELSE round(sum(step) / nullif(max(time) - min(time), 0), 6) END AS speed
      FROM steps GROUP BY track_id""",
)
def a3(spark, sf_dir):
    stats = S.path_stats(tracks(spark, sf_dir))
    return stats.select(
        "track_id", "n", F.round("length", 4).alias("length"), F.round("speed", 6).alias("speed")
    )


@query(
    "a3_speed_from_gps_epoch",
    f"""WITH {STEPS}, e AS (SELECT *, CASE WHEN ord % 5 <> 0 THEN time * 2 ELSE 0 END AS epoch FROM steps),
      g AS (SELECT track_id, count(*) AS n, sum(step) AS len, min(time) AS t0, max(time) AS t1,
        arg_min(epoch, i) AS e0, arg_max(epoch, i) AS e1 FROM e GROUP BY track_id)
      SELECT track_id, CASE WHEN n < 2 THEN 0 ELSE round(len / nullif(
        CASE WHEN e0 > 0 AND e1 > 0 THEN e1 - e0 ELSE t1 - t0 END, 0), 6) END AS speed FROM g""",
)
def a3_epoch(spark, sf_dir):
    epoch = F.when(F.col("ord") % 5 != 0, F.col("time") * 2).otherwise(F.lit(0.0))
    stats = S.path_stats(tracks(spark, sf_dir).add(epoch=epoch), "epoch")
    return stats.select("track_id", F.round("speed", 6).alias("speed"))


@query(
    "a4_capture_speed_limit",
    f"""WITH {STEPS}, g AS (SELECT track_id, count(*) AS n, sum(step) / nullif(max(time) - min(time), 0) * 3.6e0 AS kmh
        FROM steps GROUP BY track_id)
      SELECT ord, coalesce(n >= 2 AND kmh > 0.05e0, false) AS too_fast FROM cap JOIN g USING (track_id)""",
)
def a4(spark, sf_dir):
    return S.mark_too_fast(tracks(spark, sf_dir), 0.05).rows().select("ord", "too_fast")


@query(
    "a5_stationary_video",
    f"""WITH {CAP}, f AS (SELECT track_id, arg_min(lat, (time, ord)) AS flat, arg_min(lon, (time, ord)) AS flon
        FROM cap GROUP BY track_id)
      SELECT track_id, max({sql_dist('flat', 'flon', 'lat', 'lon')}) <= 4000 AS stationary
      FROM cap JOIN f USING (track_id) GROUP BY track_id""",
)
def a5(spark, sf_dir):
    shape = S.video_shape(captures(spark, sf_dir), ["track_id"], ORDER)
    return shape.select("track_id", (F.col("radius") <= 4000).alias("stationary"))


# Users seen as videos: size from the id, points from their events.
VIDEO_LIMITS = S.Limits(max_bytes=900, max_speed_kmh=0.09, stationary_radius=1500.0)


def video_points(spark, sf_dir):
    island = (F.col("track_id") % 17 == 3) & (F.col("ord") % 5 == 0)
    return captures(spark, sf_dir).select(
        "track_id", "ord", "time",
        F.when(island, 0.0).otherwise(F.col("lat")).alias("lat"),
        F.when(island, 0.0).otherwise(F.col("lon")).alias("lon"),
    )


@query(
    "a6_video_limits",
    f"""WITH {CAP}, pts AS (SELECT track_id, ord, time,
        CASE WHEN track_id % 17 = 3 AND ord % 5 = 0 THEN 0 ELSE lat END AS lat,
        CASE WHEN track_id % 17 = 3 AND ord % 5 = 0 THEN 0 ELSE lon END AS lon FROM cap),
      p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, first(lat) OVER w AS flat, first(lon) OVER w AS flon
        FROM pts WINDOW w AS {W}),
      g AS (SELECT track_id, count(*) AS n, max({sql_dist('flat', 'flon', 'lat', 'lon')}) AS radius,
        bool_or(lat = 0 AND lon = 0) AS island,
        sum({STEP}) / nullif(max(time) - min(time), 0) * 3.6e0 AS kmh FROM p GROUP BY track_id),
      v AS (SELECT c_custkey AS track_id, c_custkey * 7 % 1000 AS filesize FROM customer)
      SELECT v.track_id, CASE WHEN coalesce(radius <= 1500, true) THEN 'StationaryVideoError'
        WHEN filesize > 900 THEN 'FileTooLargeError' WHEN island THEN 'NullIslandError'
        WHEN n >= 2 AND kmh > 0.09e0 THEN 'CaptureSpeedTooFastError' END AS error_type
      FROM v LEFT JOIN g USING (track_id)""",
)
def a6(spark, sf_dir):
    videos = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("track_id"), (F.col("c_custkey") * 7 % 1000).alias("filesize")
    )
    out = S.check_videos(videos, video_points(spark, sf_dir), "track_id", ORDER, VIDEO_LIMITS)
    return out.select("track_id", F.col("error.type").alias("error_type"))


@query("f16_video_null_island",
    f"""WITH {CAP} SELECT track_id, bool_or(track_id % 17 = 3 AND ord % 5 = 0) AS null_island FROM cap GROUP BY track_id""")
def f16(spark, sf_dir):
    island = S.on_null_island(F.col("lat"), F.col("lon"))
    return video_points(spark, sf_dir).groupBy("track_id").agg(F.bool_or(island).alias("null_island"))


@query("f5_null_island",
    f"""WITH {CAP} SELECT ord, CASE WHEN track_id % 17 = 3 AND ord % 5 = 0 THEN 'NullIslandError' END AS error_type FROM cap""")
def f5(spark, sf_dir):
    bad = S.on_null_island(F.col("lat"), F.col("lon"))
    err = F.when(bad, R.error(R.NULL_ISLAND, "position is latitude 0, longitude 0"))
    return video_points(spark, sf_dir).select("ord", err["type"].alias("error_type"))


@query(
    "w1_pairwise",
    f"""WITH {CAP} SELECT ord AS left_ord, lead(ord) OVER w AS right_ord FROM cap
      WINDOW w AS {W} QUALIFY right_ord IS NOT NULL""",
)
def w1(spark, sf_dir):
    paired = tracks(spark, sf_dir).scan(right_ord=O.nxt(F.col("ord"))).rows()
    return paired.filter("right_ord IS NOT NULL").select(F.col("ord").alias("left_ord"), "right_ord")


W2_SQL = """tied AS (SELECT * REPLACE (floor(time / 21600) * 21600 AS time), {key} AS gk FROM cap),
  ranked AS (SELECT *, (time * 1000)::BIGINT AS bk, row_number() OVER (PARTITION BY gk ORDER BY time, basename) AS i FROM tied),
  heads AS (SELECT gk, bk, min(i) AS i0, count(*) AS cnt, min(time) AS t0 FROM ranked GROUP BY gk, bk),
  nexts AS (SELECT *, least(coalesce(lead(t0) OVER (PARTITION BY gk ORDER BY bk), floor(t0 + 1)), floor(t0 + 1)) AS nt FROM heads),
  repaired AS (SELECT ranked.* REPLACE (CASE WHEN cnt > 1 THEN t0 + (i - i0) * ((nt - t0) / cnt) ELSE time END AS time)
    FROM ranked JOIN nexts USING (gk, bk))"""


def tied(spark, sf_dir):
    return captures(spark, sf_dir).withColumn("time", F.floor(F.col("time") / 21600) * 21600.0)


@query(
    "w2_subsecond_repair",
    f"WITH {CAP}, {W2_SQL.format(key='track_id')} SELECT ord, round(time, 6) AS time FROM repaired",
)
def w2(spark, sf_dir):
    df = tied(spark, sf_dir).withColumn("_sort", F.col("time"))
    fixed = S.repair_subseconds(Ordered.of(df, ["track_id"], ["_sort", "basename"]))
    return fixed.rows().select("ord", F.round("time", 6).alias("time"))


@query(
    "w3_stateful_splitter",
    f"""WITH RECURSIVE {CAP}, r AS (SELECT track_id, ord, coalesce(filesize, 0) AS v, row_number() OVER w AS i
        FROM cap WINDOW w AS {W}),
      f AS (SELECT track_id, ord, i, CASE WHEN v > 150 THEN 0 ELSE v END AS total, 0 AS run FROM r WHERE i = 1
        UNION ALL SELECT r.track_id, r.ord, r.i,
          CASE WHEN f.total + r.v > 150 THEN 0 ELSE f.total + r.v END,
          CASE WHEN f.total + r.v > 150 THEN f.run + 1 ELSE f.run END
        FROM f JOIN r ON r.track_id = f.track_id AND r.i = f.i + 1)
      SELECT ord, run FROM f""",
)
def w3(spark, sf_dir):
    """Start a run when a running total passes 150, and clear the total there."""
    value = captures(spark, sf_dir).select("track_id", "time", "ord", "filesize")
    return S.split_by_total(value, ["track_id"], ORDER, F.col("filesize"), 150, "run", carry=False).select("ord", "run")


@query("w4_split_by_image_count", f"""WITH {CAP} SELECT ord, (row_number() OVER {W} - 1) // 20 + 1 AS run FROM cap""")
def w4(spark, sf_dir):
    return S.split_by_count(tracks(spark, sf_dir), 20).rows().select("ord", "run")


@query("w5_split_by_time_gap",
    f"""WITH {STEPS} SELECT ord, (sum(CASE WHEN i = 1 OR time - ptime > 43200 THEN 1 ELSE 0 END) OVER {W})::BIGINT AS run FROM steps""")
def w5(spark, sf_dir):
    return S.split_by_time_gap(tracks(spark, sf_dir), 43200.0).rows().select("ord", "run")


@query("w6_split_by_distance_gap",
    f"""WITH {STEPS} SELECT ord, (sum(CASE WHEN i = 1 OR step > 1000 THEN 1 ELSE 0 END) OVER {W})::BIGINT AS run FROM steps""")
def w6(spark, sf_dir):
    return S.split_by_distance_gap(tracks(spark, sf_dir), 1000.0).rows().select("ord", "run")


TOTAL_SQL = """WITH RECURSIVE {cap}, r AS (SELECT track_id, ord, {amount} AS v, row_number() OVER w AS i FROM cap WINDOW w AS {w}),
      f AS (SELECT track_id, ord, i, v AS total, 0 AS part FROM r WHERE i = 1
        UNION ALL SELECT r.track_id, r.ord, r.i, CASE WHEN f.total + r.v > {limit} THEN r.v ELSE f.total + r.v END,
          CASE WHEN f.total + r.v > {limit} THEN f.part + 1 ELSE f.part END
        FROM f JOIN r ON r.track_id = f.track_id AND r.i = f.i + 1)
      SELECT ord, part FROM f"""


@query("w7_split_by_total_bytes", TOTAL_SQL.format(cap=CAP, w=W, amount="coalesce(filesize, 0)", limit=300))
def w7(spark, sf_dir):
    df = captures(spark, sf_dir).select("track_id", "time", "ord", "filesize")
    out = S.split_by_total(df, ["track_id"], ORDER, F.coalesce("filesize", F.lit(0)), 300)
    return out.select("ord", "part")


@query(
    "w8_split_by_total_pixels",
    TOTAL_SQL.format(cap=CAP, w=W, amount="coalesce(width, 1024) * coalesce(height, 1024)", limit=20_000_000),
)
def w8(spark, sf_dir):
    df = captures(spark, sf_dir).select("track_id", "time", "ord", "width", "height")
    return S.split_by_total(df, ["track_id"], ORDER, S.pixels(), 20_000_000).select("ord", "part")


@query(
    "w9_split_by_all_limits",
    f"""WITH RECURSIVE {STEPS}, r AS (SELECT track_id, ord, i, coalesce(filesize, 0) AS b,
        coalesce(width, 1024) * coalesce(height, 1024) AS px,
        i = 1 OR (i - 1) % 40 = 0 OR time - ptime > 43200 OR step > 1000 AS brk FROM steps),
      f AS (SELECT track_id, ord, i, b AS tb, px AS tp, 1 AS piece FROM r WHERE i = 1
        UNION ALL SELECT track_id, ord, i, CASE WHEN sb THEN b ELSE nb END, CASE WHEN sb OR np > 30000000 THEN px ELSE np END,
          CASE WHEN sb OR np > 30000000 THEN piece + 1 ELSE piece END
        FROM (SELECT r.*, f.piece, f.tb + r.b AS nb, f.tp + r.px AS np, r.brk OR f.tb + r.b > 700 AS sb
          FROM f JOIN r ON r.track_id = f.track_id AND r.i = f.i + 1))
      SELECT ord, piece::BIGINT AS piece FROM f""",
)
def w9(spark, sf_dir):
    split = S.split_by_limits(tracks(spark, sf_dir), LIMITS, by_distance=True)
    pieces = Ordered.of(split, ["track_id"], ORDER, sized_by=[captures(spark, sf_dir)])
    here = F.struct("run", "_by_bytes", "_by_pixels")
    moved = pieces.scan(_before=O.prev(here))
    out = S.number_runs(moved, ~F.col("_before").eqNullSafe(here), "piece")
    return out.rows().select("ord", "piece")


@query(
    "w10_duplicate_removal",
    f"""WITH RECURSIVE {CAP}, r AS (SELECT track_id, ord, lat, lon, angle, row_number() OVER w AS i FROM cap WINDOW w AS {W}),
      f AS (SELECT track_id, ord, i, lat, lon, angle, false AS duplicate, NULL::DOUBLE AS distance, NULL::DOUBLE AS angle_diff
          FROM r WHERE i = 1
        UNION ALL SELECT track_id, ord, i, CASE WHEN dup THEN plat ELSE lat END, CASE WHEN dup THEN plon ELSE lon END,
          CASE WHEN dup THEN pangle ELSE angle END, dup, d, ad
        FROM (SELECT *, d <= 150 AND (ad IS NULL OR ad <= 90) AS dup FROM (
          SELECT r.*, f.lat AS plat, f.lon AS plon, f.angle AS pangle, {sql_dist('f.lat', 'f.lon', 'r.lat', 'r.lon')} AS d,
            CASE WHEN abs(r.angle - f.angle) > 180 THEN 360 - abs(r.angle - f.angle) ELSE abs(r.angle - f.angle) END AS ad
          FROM f JOIN r ON r.track_id = f.track_id AND r.i = f.i + 1)))
      SELECT ord, duplicate, round(distance, 6) AS distance, angle_diff FROM f""",
)
def w10(spark, sf_dir):
    df = captures(spark, sf_dir).select("track_id", "time", "ord", "lat", "lon", "angle")
    out = S.mark_duplicates(df, ["track_id"], ORDER, 150.0, 90.0)
    return out.select("ord", "duplicate", F.round("distance", 6).alias("distance"), "angle_diff")


@query(
    "w11_fill_headings",
    f"""WITH {CAP}, n AS (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM cap WINDOW w AS {W}),
      a AS (SELECT *, coalesce(angle, {sql_bearing('lat', 'lon', 'nlat', 'nlon')}) AS filled FROM n)
      SELECT ord, round(coalesce(filled, lag(filled) OVER {W}, 0), 6) AS angle FROM a""",
)
def w11(spark, sf_dir):
    return S.fill_headings(tracks(spark, sf_dir)).rows().select("ord", F.round("angle", 6).alias("angle"))


def _zigzag_sql(source: str, window: str) -> str:
    lags = ", ".join(f"lag({a}) OVER w AS _x" for a in ())
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for k in range(1, 6) for c in ("x", "y", "z"))
    dist = lambda a, b: f"sqrt((x{a}-x{b})*(x{a}-x{b})+(y{a}-y{b})*(y{a}-y{b})+(z{a}-z{b})*(z{a}-z{b}))"
    away = lambda k: (
        f"coalesce({dist(k, '')} > 300 AND {dist('', 5)} < {dist(k, 5)} * 0.8e0, false)"
    )
    depth = "0"
    for k in (4, 3, 2, 1):
        depth = f"CASE WHEN {away(k)} THEN 1 + {depth} ELSE 0 END"
    hit = " OR ".join(f"coalesce(lead(depth, {k}) OVER w >= {k}, false)" for k in range(1, 5))
    return f"""zx AS (SELECT *, {sql_x('lat', 'lon')} AS x, {sql_y('lat', 'lon')} AS y, {sql_z('lat')} AS z FROM {source}),
      zl AS (SELECT *, {lags} FROM zx WINDOW w AS {window}),
      zd AS (SELECT *, {depth} AS depth FROM zl),
      zz AS (SELECT *, {hit} AS zigzag FROM zd WINDOW w AS {window})"""


@query("w12_zigzag", f"WITH {CAP}, {_zigzag_sql('cap', W)} SELECT ord, zigzag FROM zz")
def w12(spark, sf_dir):
    return S.mark_zigzag(tracks(spark, sf_dir), LIMITS).rows().select("ord", "zigzag")


@query(
    "w17_split_on_predicate",
    f"""WITH {STEPS} SELECT ord, (sum(CASE WHEN i = 1 OR step > 800 THEN 1 ELSE 0 END) OVER {W})::BIGINT AS run FROM steps""",
)
def w17(spark, sf_dir):
    far = lambda p, c: geo.farther_than(
        geo.gps_distance(p["lat"], p["lon"], c["lat"], c["lon"]), 800.0
    )
    points = captures(spark, sf_dir).select("track_id", "time", "ord", "lat", "lon")
    return S.split_when(Ordered.of(points, ["track_id"], ORDER), far).rows().select("ord", "run")


RUN_KEYS_SQL = f"""{STEPS}, runs AS (SELECT *, sum(CASE WHEN i = 1 OR time - ptime > 43200 THEN 1 ELSE 0 END) OVER {W} AS run FROM steps)"""


@query(
    "w25_sequence_numbering",
    f"""WITH {RUN_KEYS_SQL}, k AS (SELECT track_id, run, row_number() OVER (ORDER BY track_id, run) - 1 AS sequence_id
        FROM runs GROUP BY track_id, run)
      SELECT ord, sequence_id FROM runs JOIN k USING (track_id, run)""",
)
def w25(spark, sf_dir):
    runs = S.split_by_time_gap(tracks(spark, sf_dir), 43200.0).rows().select("ord", "track_id", "run")
    per_group = runs.groupBy("track_id").agg(F.max("run").alias("_n"))
    sized = [captures(spark, sf_dir)]
    ranked = Ordered.of(per_group, [], ["track_id"], sized_by=sized).scan(_upto=O.running_sum(F.col("_n")))
    offsets = ranked.rows().select("track_id", (F.col("_upto") - F.col("_n")).alias("_offset"))
    joined = runs.join(offsets, "track_id")
    return joined.select("ord", (F.col("_offset") + F.col("run") - 1).alias("sequence_id"))


def flagship_input(spark, sf_dir):
    """Captures with tied times and a few null-island rows."""
    island = F.col("ord") % 101 == 0
    df = tied(spark, sf_dir)
    return df.withColumns({c: F.when(island, 0.0).otherwise(F.col(c)) for c in ("lat", "lon")})


GW = "(PARTITION BY gk, run, sub, ok ORDER BY time, basename)"
CLEAN_SQL = f"""{CAP.replace('cap AS', 'cap0 AS', 1)},
  cap AS (SELECT * REPLACE (CASE WHEN ord % 101 = 0 THEN 0 ELSE lat END AS lat, CASE WHEN ord % 101 = 0 THEN 0 ELSE lon END AS lon) FROM cap0),
  {W2_SQL.format(key=GK)},
  flagged AS (SELECT *, CASE WHEN i % 40 = 1 OR time - lag(time) OVER (PARTITION BY gk ORDER BY i) > 43200 THEN 1 ELSE 0 END AS brk FROM repaired),
  runned AS (SELECT *, sum(brk) OVER (PARTITION BY gk ORDER BY i) AS run FROM flagged),
  r AS (SELECT gk, run, row_number() OVER (PARTITION BY gk, run ORDER BY i) AS rn, ord, angle, lat = 0 AND lon = 0 AS island,
    {sql_x('lat', 'lon')} AS x, {sql_y('lat', 'lon')} AS y, {sql_z('lat')} AS z,
    coalesce(filesize, 0) AS b, coalesce(width, 1024) * coalesce(height, 1024) AS px FROM runned),
  f AS (SELECT gk, run, rn, ord, b AS tb, px AS tp, 0 AS sub,
      CASE WHEN NOT island THEN x END AS kx, CASE WHEN NOT island THEN y END AS ky, CASE WHEN NOT island THEN z END AS kz,
      CASE WHEN NOT island THEN angle END AS ka, CASE WHEN island THEN 'NullIslandError' END AS issue FROM r WHERE rn = 1
    UNION ALL SELECT gk, run, rn, ord, CASE WHEN sb THEN b ELSE nb END, CASE WHEN sp THEN px ELSE np END, CASE WHEN sp THEN sub + 1 ELSE sub END,
      CASE WHEN island OR dup THEN px0 ELSE x END, CASE WHEN island OR dup THEN py0 ELSE y END, CASE WHEN island OR dup THEN pz0 ELSE z END,
      CASE WHEN island OR dup THEN pa0 ELSE angle END,
      CASE WHEN island THEN 'NullIslandError' WHEN dup THEN 'DuplicationError' END
    FROM (SELECT *, coalesce(sqrt((x-px0)*(x-px0)+(y-py0)*(y-py0)+(z-pz0)*(z-pz0)) <= 150, false)
        AND (pa0 IS NULL OR angle IS NULL OR CASE WHEN abs(angle-pa0) > 180 THEN 360 - abs(angle-pa0) ELSE abs(angle-pa0) END <= 90) AS dup
      FROM (SELECT *, CASE WHEN NOT sp THEN kx END AS px0, CASE WHEN NOT sp THEN ky END AS py0, CASE WHEN NOT sp THEN kz END AS pz0,
          CASE WHEN NOT sp THEN ka END AS pa0
        FROM (SELECT *, sb OR np > 30000000 AS sp FROM (SELECT r.*, f.sub, f.kx, f.ky, f.kz, f.ka, f.tb + r.b AS nb, f.tp + r.px AS np, f.tb + r.b > 700 AS sb
          FROM f JOIN r ON r.gk = f.gk AND r.run = f.run AND r.rn = f.rn + 1))))),
  c0 AS (SELECT runned.gk, runned.run, f.sub, f.issue, f.issue IS NULL AS ok, ord, time, basename, lat, lon, angle,
      {sql_x('lat', 'lon')} AS cx, {sql_y('lat', 'lon')} AS cy, {sql_z('lat')} AS cz FROM runned JOIN f USING (ord)),
  h0 AS (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon,
      sqrt((cx-lag(cx) OVER w)*(cx-lag(cx) OVER w)+(cy-lag(cy) OVER w)*(cy-lag(cy) OVER w)+(cz-lag(cz) OVER w)*(cz-lag(cz) OVER w)) AS st
    FROM c0 WINDOW w AS {GW}),
  h1 AS (SELECT *, coalesce(angle, {sql_bearing('lat', 'lon', 'nlat', 'nlon')}) AS filled,
      sum(st) OVER g / nullif(max(time) OVER g - min(time) OVER g, 0) * 3.6e0 AS kmh, count(*) OVER g AS n
    FROM h0 WINDOW g AS (PARTITION BY gk, run, sub, ok)),
  h2 AS (SELECT *, coalesce(filled, lag(filled) OVER w, 0) AS heading, coalesce(n >= 2 AND kmh > 0.08e0, false) AS fast FROM h1 WINDOW w AS {GW}),
  {_zigzag_sql('h2', GW)},
  i1 AS (SELECT * REPLACE (coalesce(issue, CASE WHEN fast THEN 'CaptureSpeedTooFastError' WHEN zigzag THEN 'ZigZagError' END) AS issue) FROM zz),
  i2 AS (SELECT *, sqrt((cx-lag(cx) OVER w)*(cx-lag(cx) OVER w)+(cy-lag(cy) OVER w)*(cy-lag(cy) OVER w)+(cz-lag(cz) OVER w)*(cz-lag(cz) OVER w)) AS st2
    FROM i1 WINDOW w AS (PARTITION BY gk, run, sub, issue IS NULL ORDER BY time, basename)),
  kept AS (SELECT *, sum(CASE WHEN st2 IS NULL OR st2 > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY gk ORDER BY time, basename) AS seq
    FROM i2 WHERE issue IS NULL),
  seqs AS (SELECT gk, seq, min(folder) AS folder FROM kept JOIN (SELECT ord, folder FROM cap) USING (ord) GROUP BY gk, seq)"""


@query(
    "w30_process_sequences",
    f"""WITH RECURSIVE {CLEAN_SQL}
      SELECT i2.ord, round(i2.time, 4) AS time, CASE WHEN i2.issue IS NULL THEN round(i2.heading, 4) END AS angle,
        i2.issue AS error_type, kept.seq::BIGINT AS seq_in_group,
        count(*) FILTER (kept.seq IS NOT NULL) OVER (PARTITION BY i2.gk, kept.seq) AS n_in_sequence
      FROM i2 LEFT JOIN kept USING (ord)""",
)
def w30(spark, sf_dir):
    """Every capture with its repaired time, heading, error or place in a sequence."""
    cleaned = S.clean_captures(flagship_input(spark, sf_dir), LIMITS)
    from pyspark.sql import Window

    # Sequences hold at most max_images rows; rejected rows are told apart by their id.
    apart = F.when(F.col("seq").isNull(), F.col("ord"))
    members = Window.partitionBy("group_key", "seq", apart)
    return cleaned.select(
        "ord",
        F.round("time", 4).alias("time"),
        F.when(F.col("issue").isNull(), F.round("angle", 4)).alias("angle"),
        F.col("issue").alias("error_type"),
        F.col("seq").alias("seq_in_group"),
        F.when(F.col("seq").isNotNull(), F.count(F.lit(1)).over(members)).otherwise(F.lit(0)).alias("n_in_sequence"),
    )


@query(
    "w30_numbered_sequences",
    f"""WITH RECURSIVE {CLEAN_SQL}, agg AS (SELECT gk, seq, count(*) AS n, round(min(time), 4) AS t0, round(max(time), 4) AS t1
        FROM kept GROUP BY gk, seq)
      SELECT n, t0, t1 FROM agg""",
)
def w30_numbered(spark, sf_dir):
    """Per numbered sequence: size and time range."""
    out = S.process_captures(flagship_input(spark, sf_dir), LIMITS).filter("sequence_id IS NOT NULL")
    per = out.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("time"), 4).alias("t0"),
        F.round(F.max("time"), 4).alias("t1"),
    )
    return per.drop("sequence_id")


@query(
    "a25_conservation",
    f"""WITH {CAP} SELECT count(*) AS captures_in, count(*) AS accounted, count(*) AS distinct_rows FROM cap""",
)
def a25(spark, sf_dir):
    """Rows in = rows in sequences + error rows, each exactly once."""
    raw = captures(spark, sf_dir).select("ord", F.lit(1).alias("_in"), F.lit(0).alias("_out"))
    cleaned = S.clean_captures(flagship_input(spark, sf_dir), LIMITS)
    placed = F.when(F.col("seq").isNotNull() != F.col("issue").isNotNull(), 1).otherwise(0)
    both = raw.unionByName(cleaned.select("ord", F.lit(0).alias("_in"), placed.alias("_out")))
    per_row = both.groupBy("ord").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    return per_row.agg(
        F.sum("_in").alias("captures_in"), F.sum("_out").alias("accounted"), F.count(F.lit(1)).alias("distinct_rows")
    )
