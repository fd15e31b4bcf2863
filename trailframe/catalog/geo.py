"""Geodesy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, sql_bearing, sql_dist, sql_x, sql_y, sql_z
from trailframe.functions import geo
from trailframe.operators import ordered as O
from trailframe.operators.ordered import Ordered

# Consecutive captures of a track, as the SQL side sees them.
PAIRS = f"""{CAP}, pairs AS (
  SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
    lag(time) OVER w AS ptime, lag(angle) OVER w AS pangle
  FROM cap WINDOW w AS (PARTITION BY track_id ORDER BY time, ord))"""

D = sql_dist("plat", "plon", "lat", "lon")


def pairs(spark, sf_dir) -> DataFrame:
    tracks = Ordered.of(captures(spark, sf_dir), ["track_id"], ["time", "ord"])
    return tracks.scan(
        plat=O.prev(F.col("lat")),
        plon=O.prev(F.col("lon")),
        ptime=O.prev(F.col("time")),
        pangle=O.prev(F.col("angle")),
    ).rows()


def step_distance():
    return geo.gps_distance(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))


@query(
    "c1_ecef",
    f"""WITH {CAP} SELECT ord, round({sql_x('lat', 'lon')}, 4) AS x,
      round({sql_y('lat', 'lon')}, 4) AS y, round({sql_z('lat')}, 4) AS z FROM cap""",
)
def c1(spark, sf_dir):
    xyz = geo.ecef(F.col("lat"), F.col("lon"))
    df = captures(spark, sf_dir).select("ord", xyz.alias("p"))
    return df.select("ord", *[F.round(f"p.{a}", 4).alias(a) for a in "xyz"])


@query("c2_gps_distance", f"WITH {PAIRS} SELECT ord, round({D}, 6) AS distance FROM pairs")
def c2(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", F.round(step_distance(), 6).alias("distance"))


@query(
    "c3_bearing",
    f"WITH {PAIRS} SELECT ord, round({sql_bearing('plat', 'plon', 'lat', 'lon')}, 6) AS bearing FROM pairs",
)
def c3(spark, sf_dir):
    b = geo.bearing(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return pairs(spark, sf_dir).select("ord", F.round(b, 6).alias("bearing"))


@query(
    "c4_diff_bearing",
    f"""WITH {PAIRS} SELECT ord, CASE WHEN abs(angle - pangle) > 180 THEN 360 - abs(angle - pangle)
      ELSE abs(angle - pangle) END AS diff FROM pairs""",
)
def c4(spark, sf_dir):
    diff = geo.diff_bearing(F.col("pangle"), F.col("angle"))
    return pairs(spark, sf_dir).select("ord", diff.alias("diff"))


@query(
    "c5_point_speed",
    f"""WITH {PAIRS} SELECT ord, round({D} / abs(time - ptime), 6) AS speed
      FROM pairs WHERE ptime IS NOT NULL AND time <> ptime""",
)
def c5(spark, sf_dir):
    speed = geo.point_speed(step_distance(), F.col("ptime"), F.col("time"))
    df = pairs(spark, sf_dir).filter("ptime IS NOT NULL AND time <> ptime")
    return df.select("ord", F.round(speed, 6).alias("speed"))


@query(
    "c6_pair_predicates",
    f"""WITH {PAIRS}, m AS (SELECT ord, {D} AS d, abs(time - ptime) AS dt FROM pairs WHERE ptime IS NOT NULL)
      SELECT ord, d > 500 AS far, d / dt <= 0.01e0 AS slow, d > 500 AND d / dt <= 0.01e0 AS far_and_slow FROM m
      WHERE dt > 0""",
)
def c6(spark, sf_dir):
    d = step_distance()
    far = geo.farther_than(d, 500.0)
    slow = geo.not_faster_than(geo.point_speed(d, F.col("ptime"), F.col("time")), 0.01)
    df = pairs(spark, sf_dir).filter("ptime IS NOT NULL AND time <> ptime")
    return df.select("ord", far.alias("far"), slow.alias("slow"), geo.both(far, slow).alias("far_and_slow"))


@query(
    "c7_interpolation_weight",
    f"""WITH {PAIRS} SELECT ord, CASE WHEN ptime = time THEN 0e0
      ELSE round((floor(time) - ptime) / (time - ptime), 6) END AS weight FROM pairs WHERE ptime IS NOT NULL""",
)
def c7(spark, sf_dir):
    w = geo.weight(F.floor("time").cast("double"), F.col("ptime"), F.col("time"))
    df = pairs(spark, sf_dir).filter("ptime IS NOT NULL")
    return df.select("ord", F.round(w, 6).alias("weight"))
