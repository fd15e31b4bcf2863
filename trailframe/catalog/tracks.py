"""Interpolation along tracks and point-stream arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, sql_bearing, sql_dist, table
from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators import sequences as S
from trailframe.operators import tracks as K
from trailframe.operators.ordered import Ordered

KEYS = ["track_id"]
ORDER = ["time", "ord"]
W = "(PARTITION BY track_id ORDER BY time, ord)"

# Clicks play the photos, every other event a GPS log point of the same track.
TYPED = """, CASE WHEN ord % 5 = 0 THEN 0 ELSE time * 2 END AS epoch_time, ord % 4 AS fix,
  CASE WHEN ord % 6 <> 0 THEN alt END AS precision, lat - 30 AS ground_speed"""
BRACKET = f"""{CAP}, c AS (SELECT * FROM cap WHERE kind = 'click'),
  p0 AS (SELECT track_id, ord, time, {{"pt": struct_pack(t := time, lat := lat, lon := lon, alt := alt, epoch_time := epoch_time,
      fix := fix, precision := precision, ground_speed := ground_speed)}}.pt AS pt
    FROM (SELECT *{TYPED} FROM cap) WHERE kind <> 'click'),
  p AS (SELECT *, lag(pt) OVER w AS prv, lead(pt) OVER w AS nxt, first(time) OVER w AS t0,
      max(time) OVER (PARTITION BY track_id) AS t1 FROM p0 WINDOW w AS {W}),
  bounds AS (SELECT track_id, min(time) AS t0, max(time) AS t1 FROM p GROUP BY track_id),
  j AS (SELECT c.track_id, c.ord, c.time, b.pt AS bp, b.prv AS bprv, a.pt AS ap, a.nxt AS anxt
    FROM c ASOF LEFT JOIN p b ON c.track_id = b.track_id AND c.time > b.time
      ASOF LEFT JOIN p a ON c.track_id = a.track_id AND c.time <= a.time),
  s AS (SELECT track_id, ord, time, CASE WHEN bp IS NULL THEN ap WHEN ap IS NULL THEN coalesce(bprv, bp) ELSE bp END AS s,
      CASE WHEN ap IS NULL THEN bp WHEN bp IS NULL THEN coalesce(anxt, ap) ELSE ap END AS e FROM j),
  f AS (SELECT *, s.lat AS slat, s.lon AS slon, e.lat AS elat, e.lon AS elon,
      CASE WHEN s.t = e.t THEN 0 ELSE (time - s.t) / (e.t - s.t) END AS w FROM s WHERE s IS NOT NULL)"""
AT = f"""round(slat + (elat - slat) * w, 6) AS lat, round(slon + (elon - slon) * w, 6) AS lon,
  round(s.alt + (e.alt - s.alt) * w, 4) AS alt, round({sql_bearing('slat', 'slon', 'elat', 'elon')}, 4) AS angle"""


def photos(spark, sf_dir):
    return captures(spark, sf_dir).filter("kind = 'click'").select("track_id", "ord", "time")


def log_points(spark, sf_dir):
    df = captures(spark, sf_dir).filter("kind <> 'click'")
    return df.select(
        "track_id", "ord", "time", "lat", "lon", "alt",
        F.when(F.col("ord") % 5 == 0, 0.0).otherwise(F.col("time") * 2).alias("epoch_time"),
        (F.col("ord") % 4).alias("fix"),
        F.when(F.col("ord") % 6 != 0, F.col("alt")).alias("precision"),
        (F.col("lat") - 30).alias("ground_speed"),
    )


def at_columns():
    return [
        F.round("at.lat", 6).alias("lat"),
        F.round("at.lon", 6).alias("lon"),
        F.round("at.alt", 4).alias("alt"),
        F.round("at.angle", 4).alias("angle"),
    ]


@query("j1_interpolate_along_track", f"WITH {BRACKET} SELECT ord, {AT} FROM f")
def j1(spark, sf_dir):
    placed = K.interpolate(photos(spark, sf_dir), log_points(spark, sf_dir), KEYS)
    return placed.filter("at IS NOT NULL").select("ord", *at_columns())


@query(
    "j2_extrapolate_at_ends",
    f"WITH {BRACKET} SELECT ord, {AT} FROM f JOIN bounds USING (track_id) WHERE time < t0 OR time > t1",
)
def j2(spark, sf_dir):
    placed = K.interpolate(photos(spark, sf_dir), log_points(spark, sf_dir), KEYS)
    return placed.filter("time < track_start OR time > track_end").select("ord", *at_columns())


CT = "substr(strftime(make_timestamp(round({} * 1e6)::BIGINT), '%Y_%m_%d_%H_%M_%S_%f'), 1, 23)"


@query(
    "j3_outside_track_rejection",
    f"""WITH {BRACKET}, o AS (SELECT ord, time, t0, t1, t0 - time > 0.001e0 OR time - t1 > 0.001e0 AS off FROM c JOIN bounds USING (track_id))
      SELECT ord, CASE WHEN off THEN 'OutsideGPXTrackError' END AS error_type,
        CASE WHEN off THEN {CT.format('time')} END AS image_time,
        CASE WHEN off THEN {CT.format('t0')} END AS gpx_start_time,
        CASE WHEN off THEN {CT.format('t1')} END AS gpx_end_time FROM o""",
)
def j3(spark, sf_dir):
    tagged = K.geotag(photos(spark, sf_dir), log_points(spark, sf_dir), KEYS)
    names = ["image_time", "gpx_start_time", "gpx_end_time"]
    known = tagged.filter("error IS NULL OR error.type <> 'GPXEmptyError'")
    return known.select(
        "ord", F.col("error.type").alias("error_type"), *[F.col("error.vars")[n].alias(n) for n in names]
    )


SEG = "floor(time / 604800)::BIGINT * 3 + ord % 3"


def segmented(spark, sf_dir):
    seg = F.floor(F.col("time") / 604800) * 3 + F.col("ord") % 3
    return log_points(spark, sf_dir).withColumn("segment_id", seg)


@query(
    "j4_multi_track_choice",
    f"""WITH {CAP}, c AS (SELECT * FROM cap WHERE kind = 'click'),
      b AS (SELECT track_id, {SEG} AS segment_id, min(time) AS t0, max(time) AS t1 FROM cap WHERE kind <> 'click' GROUP BY ALL)
      SELECT c.ord, coalesce(arg_min(segment_id, (t0, segment_id)) FILTER (t1 >= time), arg_max(segment_id, (t0, segment_id))) AS segment_id
      FROM c JOIN b USING (track_id) GROUP BY c.ord""",
)
def j4(spark, sf_dir):
    picked = K.pick_track(photos(spark, sf_dir), segmented(spark, sf_dir), KEYS)
    return picked.filter("segment_id IS NOT NULL").select("ord", "segment_id")


@query(
    "j4_multi_track_interpolation",
    f"""WITH {CAP}, c AS (SELECT * FROM cap WHERE kind = 'click'), q AS (SELECT *, {SEG} AS seg FROM cap WHERE kind <> 'click'),
      b AS (SELECT track_id, seg, min(time) AS t0, max(time) AS t1 FROM q GROUP BY ALL),
      pick AS (SELECT c.track_id, c.ord, c.time, coalesce(arg_min(seg, (t0, seg)) FILTER (t1 >= time), arg_max(seg, (t0, seg))) AS seg
        FROM c JOIN b USING (track_id) GROUP BY ALL),
      p AS (SELECT track_id, seg, time, struct_pack(t := time, lat := lat, lon := lon) AS pt, lag(pt) OVER w AS prv, lead(pt) OVER w AS nxt
        FROM q WINDOW w AS (PARTITION BY track_id, seg ORDER BY time, ord)),
      j AS (SELECT c.ord, c.time, b.pt AS bp, b.prv AS bprv, a.pt AS ap, a.nxt AS anxt
        FROM pick c ASOF LEFT JOIN p b ON c.track_id = b.track_id AND c.seg = b.seg AND c.time > b.time
          ASOF LEFT JOIN p a ON c.track_id = a.track_id AND c.seg = a.seg AND c.time <= a.time),
      s AS (SELECT ord, time, CASE WHEN bp IS NULL THEN ap WHEN ap IS NULL THEN coalesce(bprv, bp) ELSE bp END AS s,
        CASE WHEN ap IS NULL THEN bp WHEN bp IS NULL THEN coalesce(anxt, ap) ELSE ap END AS e FROM j),
      f AS (SELECT *, CASE WHEN s.t = e.t THEN 0 ELSE (time - s.t) / (e.t - s.t) END AS w FROM s)
      SELECT ord, round(s.lat + (e.lat - s.lat) * w, 6) AS lat, round(s.lon + (e.lon - s.lon) * w, 6) AS lon FROM f""",
)
def j4_interpolated(spark, sf_dir):
    placed = K.interpolate_tracks(photos(spark, sf_dir), segmented(spark, sf_dir), KEYS)
    return placed.filter("at IS NOT NULL").select("ord", *at_columns()[:2])


@query(
    "j5_typed_field_interpolation",
    f"""WITH {BRACKET} SELECT ord, CASE WHEN s.epoch_time > 0 AND e.epoch_time > 0
        THEN round(s.epoch_time + (e.epoch_time - s.epoch_time) * w, 3) END AS epoch_time, s.fix AS fix,
        round(s.precision + (e.precision - s.precision) * w, 4) AS precision,
        round(s.ground_speed + (e.ground_speed - s.ground_speed) * w, 4) AS ground_speed FROM f""",
)
def j5(spark, sf_dir):
    placed = K.interpolate(photos(spark, sf_dir), log_points(spark, sf_dir), KEYS, fields=K.GPS_FIELDS)
    return placed.filter("at IS NOT NULL").select(
        "ord",
        F.round("at.epoch_time", 3).alias("epoch_time"),
        "at.fix",
        F.round("at.precision", 4).alias("precision"),
        F.round("at.ground_speed", 4).alias("ground_speed"),
    )


@query(
    "j5_motion_field_interpolation",
    f"""WITH {BRACKET} SELECT ord, round(s.lat * 2 + (e.lat * 2 - s.lat * 2) * w, 4) AS velocity_east,
        round(s.ground_speed + (e.ground_speed - s.ground_speed) * w, 4) AS speed_accuracy, s.fix AS gps_fix_type FROM f""",
)
def j5_motion(spark, sf_dir):
    points = log_points(spark, sf_dir).withColumns(
        {
            "time_gps_epoch": F.col("epoch_time"),
            "gps_fix_type": F.col("fix"),
            "horizontal_accuracy": F.col("lat"),
            "vertical_accuracy": F.col("lon"),
            "velocity_east": F.col("lat") * 2,
            "velocity_north": F.col("lon") * 2,
            "velocity_up": F.lit(0.0),
            "speed_accuracy": F.col("ground_speed"),
        }
    )
    placed = K.interpolate(photos(spark, sf_dir), points, KEYS, fields=K.MOTION_FIELDS)
    return placed.filter("at IS NOT NULL").select(
        "ord",
        F.round("at.velocity_east", 4).alias("velocity_east"),
        F.round("at.speed_accuracy", 4).alias("speed_accuracy"),
        "at.gps_fix_type",
    )


@query(
    "j6_align_captures_to_track_start",
    f"""WITH {CAP}, p AS (SELECT track_id, min(time) AS p0 FROM cap WHERE kind <> 'click' GROUP BY track_id),
      c AS (SELECT *, min(time) OVER (PARTITION BY track_id) AS c0 FROM cap WHERE kind = 'click')
      SELECT ord, round(time + (coalesce(p0 - c0, 0) + 2.5e0), 6) AS time FROM c LEFT JOIN p USING (track_id)""",
)
def j6(spark, sf_dir):
    moved = K.align_captures(photos(spark, sf_dir), log_points(spark, sf_dir), KEYS, 2.5, True)
    return moved.select("ord", F.round("time", 6).alias("time"))


@query(
    "j6_relative_track_times",
    f"""WITH {CAP}, c AS (SELECT track_id, min(time) AS c0 FROM cap WHERE kind = 'click' GROUP BY track_id),
      p AS (SELECT *, min(time) OVER (PARTITION BY track_id) AS p0 FROM cap WHERE kind <> 'click')
      SELECT ord, round(c0 + (time - p0), 6) AS time FROM p LEFT JOIN c USING (track_id)""",
)
def j6_points(spark, sf_dir):
    relative = K.rebase_times(log_points(spark, sf_dir), KEYS)
    moved = K.align_points(relative, photos(spark, sf_dir), KEYS)
    return moved.select("ord", F.round("time", 6).alias("time"))


EDITS_SQL = f"""{CAP}, m AS (SELECT track_id, ord, time - 1704067200 AS time, row_number() OVER {W} AS i FROM cap),
  seg AS (SELECT track_id, k AS seg_no, k * 200000 + 10000e0 AS st, k * 200000 + 10000e0 + CASE WHEN k % 4 = 1 THEN 5000 ELSE 150000 END AS en
    FROM (SELECT DISTINCT track_id FROM cap WHERE track_id % 3 <> 0), range(0, 12) r(k)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY st) - 1 AS j FROM seg)"""


@query(
    "j15_edit_list_filter",
    f"""WITH RECURSIVE {EDITS_SQL},
      walk AS (SELECT m.track_id, m.ord, m.time, m.i, 0 AS j, false AS keep FROM m WHERE false
        UNION ALL SELECT * FROM (SELECT track_id, 0 AS ord, 0e0 AS time, 0 AS i, 0 AS j, false AS keep FROM m WHERE i = 1)
        UNION ALL SELECT m.track_id, m.ord, m.time, m.i, CASE WHEN rk.en IS NOT NULL AND m.time > rk.en THEN w.j + 1 ELSE w.j END,
          coalesce(m.time >= rk.st AND m.time <= rk.en, false)
        FROM walk w JOIN m ON m.track_id = w.track_id AND m.i = w.i + 1 LEFT JOIN rk ON rk.track_id = w.track_id AND rk.j = w.j)
      SELECT ord, round(time + CASE WHEN track_id % 2 = 0 THEN 4.5e0 ELSE 0 END, 6) AS time FROM walk
      WHERE i > 0 AND (keep OR track_id % 3 = 0)""",
)
def j15(spark, sf_dir):
    cap = captures(spark, sf_dir)
    measured = cap.select("track_id", "ord", (F.col("time") - 1704067200).alias("time"))
    tracks = cap.select("track_id").distinct()
    real = tracks.filter("track_id % 3 <> 0").select("track_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seg_no"))
    length = F.when(F.col("seg_no") % 4 == 1, 5000.0).otherwise(150000.0)
    real = real.withColumns({"media_time": F.col("seg_no") * 200000 + 10000.0, "duration": length})
    empty = tracks.filter("track_id % 2 = 0").select(
        "track_id", F.lit(-1).alias("seg_no"), F.lit(-1.0).alias("media_time"), F.lit(4.5).alias("duration")
    )
    kept = K.apply_edit_list(measured, real.unionByName(empty), "track_id")
    return kept.select("ord", F.round("time", 6).alias("time"))


def _sync_sql(mode: str) -> str:
    offset = "0e0" if mode == "rebase" else "coalesce(g0 - e0, 0)"
    strict = "CASE WHEN e.track_id IS NULL THEN 'VideoGPSNotFoundError' END" if mode == "strict_sync" else "NULL"
    return f"""WITH {CAP}, g AS (SELECT *, min(time) OVER (PARTITION BY track_id) AS g0 FROM cap WHERE kind <> 'click'),
      e AS (SELECT track_id, arg_min(struct_pack(e := epoch), (time, ord)).e AS e0 FROM (SELECT *, CASE WHEN ord % 4 <> 0 THEN time + 7200 END AS epoch
        FROM cap WHERE kind = 'click' AND track_id % 3 <> 0) GROUP BY track_id)
      SELECT ord, round(time - g0 + {offset}, 6) AS time, {strict}::VARCHAR AS error_type FROM g LEFT JOIN e ON g.track_id = e.track_id"""


def _sync(spark, sf_dir, mode):
    epoch = F.when(F.col("ord") % 4 != 0, F.col("time") + 7200)
    native = photos(spark, sf_dir).filter("track_id % 3 <> 0").withColumn("epoch_time", epoch)
    gpx = log_points(spark, sf_dir).drop("epoch_time")
    out = K.sync_to_video(gpx, native, "track_id", mode)
    return out.select("ord", F.round("time", 6).alias("time"), F.col("error.type").alias("error_type"))


@query("j16_clock_sync", _sync_sql("sync"))
def j16(spark, sf_dir):
    return _sync(spark, sf_dir, "sync")


@query("j16_clock_strict_sync", _sync_sql("strict_sync"))
def j16_strict(spark, sf_dir):
    return _sync(spark, sf_dir, "strict_sync")


@query("j16_clock_rebase", _sync_sql("rebase"))
def j16_rebase(spark, sf_dir):
    return _sync(spark, sf_dir, "rebase")


def _downsample_sql(source: str, key: str, order: str, limit: float) -> str:
    d = sql_dist("f.lat", "f.lon", "r.lat", "r.lon")
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
      f AS (SELECT {key}, rn, lat, lon, true AS keep FROM r WHERE rn = 1
        UNION ALL SELECT {key}, rn, CASE WHEN far THEN lat ELSE flat END, CASE WHEN far THEN lon ELSE flon END, far
        FROM (SELECT r.{key}, r.rn, r.lat, r.lon, f.lat AS flat, f.lon AS flon, {d} > {limit} AS far
          FROM f JOIN r ON r.{key} = f.{key} AND r.rn = f.rn + 1))"""


@query(
    "w13_distance_downsampling",
    f"""WITH RECURSIVE {CAP}, {_downsample_sql('cap', 'track_id', 'time, ord', 900.0)}
      SELECT ord FROM r JOIN f USING (track_id, rn) WHERE keep""",
)
def w13(spark, sf_dir):
    df = captures(spark, sf_dir).select("track_id", "time", "ord", "lat", "lon")
    return K.sample_by_distance(df, KEYS, ORDER, 900.0).select("ord")


@query(
    "w14_frame_sampling",
    f"""WITH RECURSIVE {BRACKET}, ix AS (SELECT ord, row_number() OVER {W} - 1 AS frame_idx FROM c),
      g AS (SELECT f.track_id, frame_idx, f.time, slat + (elat - slat) * w AS lat, slon + (elon - slon) * w AS lon
        FROM f JOIN ix USING (ord) JOIN bounds b ON b.track_id = f.track_id WHERE f.time >= b.t0 - 0.001e0 AND f.time <= b.t1 + 0.001e0),
      {_downsample_sql('g', 'track_id', 'frame_idx', 600.0).replace(' f AS', ' ff AS').replace('FROM f JOIN', 'FROM ff JOIN').replace('f.', 'ff.').replace('fff.', 'ff.')}
      SELECT r.track_id, frame_idx, round(r.lat, 6) AS lat, round(r.lon, 6) AS lon FROM r JOIN ff USING (track_id, rn) WHERE keep""",
)
def w14(spark, sf_dir):
    frames = photos(spark, sf_dir).select("track_id", F.col("ord").alias("frame_no"), F.col("time").alias("cts"))
    out = K.sample_frames(frames, log_points(spark, sf_dir), "track_id", 600.0)
    return out.select("track_id", "frame_idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("f8_time_range_filter",
    f"""WITH {BRACKET} SELECT c.ord FROM c JOIN bounds USING (track_id) WHERE time >= t0 - 0.001e0 AND time <= t1 + 0.001e0""")
def f8(spark, sf_dir):
    ends = log_points(spark, sf_dir).groupBy("track_id").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    joined = photos(spark, sf_dir).join(ends, "track_id")
    return joined.filter(K.within_track_buffered(F.col("time"), F.col("t0"), F.col("t1"))).select("ord")


@query(
    "w15_interval_frame_times",
    f"""WITH {CAP}, i AS (SELECT ord, row_number() OVER {W} AS idx, min(time) OVER (PARTITION BY track_id) AS t0 FROM cap WHERE kind = 'click')
      SELECT ord, round(t0 + (idx - 1) * 2e0 * 0.5e0, 6) AS time FROM i""",
)
def w15(spark, sf_dir):
    rows = Ordered.of(photos(spark, sf_dir), KEYS, ORDER).scan(_i=O.index(), _t0=O.group_min(F.col("time")))
    at = K.interval_frame_time(F.col("_t0"), F.col("_i"), 2.0, 0.5)
    return rows.rows().select("ord", F.round(at, 6).alias("time"))


@query("w16_frame_time_choice",
    f"""WITH {CAP} SELECT ord, round(CASE WHEN ord % 5 <> 0 AND time * 2 > 0 THEN time * 2 ELSE 1000 + time END, 6) AS time FROM cap WHERE kind <> 'click'""")
def w16(spark, sf_dir):
    at = K.frame_time(F.col("epoch_time"), F.lit(1000.0), F.col("time"))
    return log_points(spark, sf_dir).select("ord", F.round(at, 6).alias("time"))


@query(
    "w21_consecutive_duplicate_points",
    f"""WITH {CAP}, v AS (SELECT track_id, time, ord, lon, floor(alt / 20) AS epoch_time FROM cap),
      l AS (SELECT *, row_number() OVER w AS i, lag(lon) OVER w AS plon, lag(epoch_time) OVER w AS pe FROM v WINDOW w AS {W})
      SELECT ord FROM l WHERE i = 1 OR lon IS DISTINCT FROM plon OR epoch_time IS DISTINCT FROM pe""",
)
def w21(spark, sf_dir):
    df = captures(spark, sf_dir).withColumn("epoch_time", F.floor(F.col("alt") / 20))
    rows = Ordered.of(df.select("track_id", "time", "ord", "lon", "epoch_time"), KEYS, ORDER)
    return K.drop_repeated_points(rows, ["lon", "epoch_time"]).rows().select("ord")


@query(
    "w22_epoch_backfill",
    f"""WITH {CAP}, k AS (SELECT *, CASE WHEN ord % 4 = 1 THEN time + 3600 END AS e FROM cap),
      b AS (SELECT *, last_value(CASE WHEN e IS NOT NULL THEN struct_pack(e := e, t := time) END IGNORE NULLS)
          OVER (PARTITION BY track_id ORDER BY time, ord ROWS UNBOUNDED PRECEDING) AS lk,
        first_value(CASE WHEN e IS NOT NULL THEN struct_pack(e := e, t := time) END IGNORE NULLS)
          OVER (PARTITION BY track_id ORDER BY time, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nk FROM k)
      SELECT ord, round(coalesce(e, lk.e + (time - lk.t), nk.e + (time - nk.t)), 6) AS epoch_time FROM b""",
)
def w22(spark, sf_dir):
    epoch = F.when(F.col("ord") % 4 == 1, F.col("time") + 3600)
    rows = Ordered.of(captures(spark, sf_dir).withColumn("epoch_time", epoch), KEYS, ORDER)
    return K.backfill_epochs(rows).rows().select("ord", F.round("epoch_time", 6).alias("epoch_time"))


@query(
    "w23_spread_points_in_sample",
    f"""WITH {CAP}, s AS (SELECT ord, floor(time / 86400) * 86400 AS st, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id, floor(time / 86400)) AS n
        FROM cap WINDOW w AS (PARTITION BY track_id, floor(time / 86400) ORDER BY time, ord))
      SELECT ord, round(st + (i - 1) * (600e0 / n), 3) AS time FROM s""",
)
def w23(spark, sf_dir):
    day = F.floor(F.col("time") / 86400).alias("day")
    df = captures(spark, sf_dir).select("track_id", "ord", "time", day)
    df = df.withColumns({"sample_time": F.col("day") * 86400.0, "duration": F.lit(600.0), "_sort": F.col("time")})
    rows = Ordered.of(df, ["track_id", "day"], ["_sort", "ord"])
    out = K.spread_in_sample(rows, "sample_time", "duration").rows()
    return out.select("ord", F.round("time", 3).alias("time"))


@query("w24_rebase_times", f"WITH {CAP} SELECT ord, round(time - min(time) OVER (PARTITION BY track_id) + 5, 6) AS time FROM cap")
def w24(spark, sf_dir):
    return K.rebase_times(captures(spark, sf_dir), KEYS, 5.0).select("ord", F.round("time", 6).alias("time"))


@query("w26_next_sample_delta",
    f"WITH {CAP} SELECT ord, coalesce(trunc((lead(time) OVER {W} - time) * 90)::BIGINT, 0) AS delta FROM cap")
def w26(spark, sf_dir):
    rows = Ordered.of(captures(spark, sf_dir), KEYS, ORDER)
    return K.next_sample_delta(rows, 90).rows().select("ord", "delta")


@query(
    "w27_frame_timeline",
    f"""WITH {CAP}, d AS (SELECT track_id, ord, ord % 6 + 1 AS n, ord % 50 + 1 AS delta FROM cap),
      v AS (SELECT track_id, sum(n) + CASE WHEN track_id % 2 = 0 THEN 3 ELSE -1 END AS n_frames FROM d GROUP BY track_id),
      dx AS (SELECT track_id, delta, row_number() OVER (PARTITION BY track_id ORDER BY ord, k) - 1 AS frame_idx FROM (SELECT *, unnest(range(n)) AS k FROM d)),
      ox AS (SELECT track_id, off, row_number() OVER (PARTITION BY track_id ORDER BY ord, k) - 1 AS frame_idx
        FROM (SELECT track_id, ord, CASE WHEN ord % 3 = 0 THEN -(ord % 40) ELSE ord % 40 END AS off, unnest(range(ord % 6 + 2)) AS k FROM cap WHERE ord % 2 = 0)),
      fr AS (SELECT track_id, n_frames, unnest(range(n_frames::BIGINT)) AS frame_idx FROM v),
      j AS (SELECT fr.track_id, fr.frame_idx, coalesce(delta, 0) AS delta, coalesce(off, 0) AS off
        FROM fr LEFT JOIN dx USING (track_id, frame_idx) LEFT JOIN ox USING (track_id, frame_idx)),
      s AS (SELECT *, sum(delta) OVER (PARTITION BY track_id ORDER BY frame_idx) - delta AS before FROM j)
      SELECT track_id, frame_idx, round(before / 600e0, 6) AS dts, round((before + off) / 600e0, 6) AS cts, round(delta / 600e0, 6) AS delta FROM s""",
)
def w27(spark, sf_dir):
    cap = captures(spark, sf_dir).select("track_id", "ord")
    o = F.col("ord")
    deltas = cap.select("track_id", o.alias("run_no"), (o % 6 + 1).alias("count"), (o % 50 + 1).alias("delta"))
    extra = F.when(F.col("track_id") % 2 == 0, 3).otherwise(-1)
    videos = deltas.groupBy("track_id").agg(F.sum("count").alias("n_frames")).select(
        "track_id", (F.col("n_frames") + extra).alias("n_frames"), F.lit(600).alias("timescale")
    )
    # Negative offsets arrive as unsigned 32-bit values.
    size = o % 40
    raw = F.when((o % 3 == 0) & (size > 0), F.lit(2**32) - size).otherwise(size)
    offsets = cap.filter("ord % 2 = 0").select(
        "track_id", o.alias("run_no"), (o % 6 + 2).alias("count"), raw.alias("offset")
    )
    out = K.frame_timeline(videos, deltas, offsets, "track_id")
    return out.select("track_id", "frame_idx", *[F.round(c, 6).alias(c) for c in ("dts", "cts", "delta")])


@query(
    "w28_run_length_compression",
    f"""WITH {CAP}, l AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS ch FROM cap WINDOW w AS {W}),
      r AS (SELECT *, sum(ch) OVER {W} AS run FROM l) SELECT track_id, run::BIGINT AS run, kind, count(*) AS count FROM r GROUP BY ALL""",
)
def w28(spark, sf_dir):
    rows = Ordered.of(captures(spark, sf_dir).select("track_id", "time", "ord", "kind"), KEYS, ORDER)
    return K.compress_runs(rows, "kind")


@query(
    "w29_track_gap_list",
    f"""WITH {CAP}, b AS (SELECT track_id, {SEG} AS segment_id, min(time) AS t0, max(time) AS t1 FROM cap WHERE kind <> 'click' GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY segment_id) AS i FROM b)
      SELECT track_id, segment_id, CASE WHEN i = 1 THEN -1 ELSE trunc(t0 * 1000)::BIGINT END AS media_time,
        CASE WHEN i = 1 THEN trunc(t0 * 600)::BIGINT ELSE trunc((t1 - t0) * 600)::BIGINT END AS segment_duration FROM r""",
)
def w29(spark, sf_dir):
    return K.track_edits(segmented(spark, sf_dir), "track_id", "segment_id", 600, 1000)


@query("x4_merge_tracks_of_file",
    f"""WITH {CAP} SELECT track_id, count(*) AS n, min(time) AS t0, max(time) AS t1 FROM cap WHERE kind <> 'click' GROUP BY track_id""")
def x4(spark, sf_dir):
    merged = K.merge_segments(segmented(spark, sf_dir))
    return merged.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1")
    )


# The event kinds, taken as sensors.
SENSORS = ("click", "error", "purchase", "signup", "view")


@query(
    "x5_multiplex_sensors",
    f"""WITH {CAP}, m AS (SELECT track_id, ord, kind AS sensor, time - 1705000000 AS t FROM cap)
      SELECT ord, sensor, row_number() OVER (PARTITION BY track_id ORDER BY t, ord) AS position FROM m WHERE t >= 0""",
)
def x5(spark, sf_dir):
    df = captures(spark, sf_dir).withColumn("time", F.col("time") - 1705000000)
    streams = {k: df.filter(F.col("kind") == k).select("track_id", "ord", "time") for k in SENSORS}
    merged = Ordered.of(K.multiplex(streams), KEYS, ORDER).scan(position=O.index())
    return merged.rows().select("ord", "sensor", "position")


@query("f12_negative_time_drop", f"WITH {CAP} SELECT ord FROM cap WHERE time - 1705000000 >= 0")
def f12(spark, sf_dir):
    df = captures(spark, sf_dir).withColumn("time", F.col("time") - 1705000000)
    return K.drop_negative_times(df).select("ord")


@query(
    "f13_unsorted_track_check",
    """WITH l AS (SELECT o_custkey AS track_id, o_orderdate AS t, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
      SELECT DISTINCT track_id, 'MetadataValidationError' AS error_type FROM l WHERE p > t""",
)
def f13(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("time")
    )
    bad = K.unsorted_groups(orders, KEYS, "ord")
    return bad.select("track_id", F.col("error.type").alias("error_type"))


@query("o1_sort_by_time_and_name", f"WITH {CAP} SELECT filename, row_number() OVER (PARTITION BY track_id ORDER BY time, basename) AS position FROM cap")
def o1(spark, sf_dir):
    rows = Ordered.of(captures(spark, sf_dir), KEYS, ["time", "basename"]).scan(position=O.index())
    return rows.rows().select("filename", "position")


@query("o2_stable_sort_by_time", f"WITH {CAP} SELECT ord, row_number() OVER (PARTITION BY track_id ORDER BY floor(time / 86400), ord) AS position FROM cap")
def o2(spark, sf_dir):
    df = captures(spark, sf_dir).withColumn("day", F.floor(F.col("time") / 86400))
    rows = Ordered.of(df, KEYS, ["day", "ord"]).scan(position=O.index())
    return rows.rows().select("ord", "position")


@query("o5_sort_frames_by_composition_time",
    f"WITH {CAP} SELECT ord, row_number() OVER (PARTITION BY track_id ORDER BY time + (ord % 3) * 40000, ord) - 1 AS frame_idx FROM cap")
def o5(spark, sf_dir):
    df = captures(spark, sf_dir).withColumn("cts", F.col("time") + (F.col("ord") % 3) * 40000)
    rows = Ordered.of(df, KEYS, ["cts", "ord"]).scan(_i=O.index())
    return rows.rows().select("ord", (F.col("_i") - 1).alias("frame_idx"))
