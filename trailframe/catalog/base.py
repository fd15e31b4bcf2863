"""Registry of named queries, each with its check in standard SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(events: DataFrame) -> Column:
    """Microseconds since 1970 of the zone-less event time, in any session zone."""
    zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, {zero}, ts)")
    return F.unix_micros("ts")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table seen as geotagged captures (it has no coordinates itself)."""
    ev = table(spark, sf_dir, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    return ev.select(
        uid.alias("track_id"),
        eid.alias("ord"),
        F.col("event_type").alias("kind"),
        (micros(ev) / F.lit(1e6)).alias("time"),
        (37.0 + (uid % 50) * 0.2 + F.floor("value") * 0.0001).alias("lat"),
        (-122.0 + (eid % 13) * 0.0002).alias("lon"),
        F.when(eid % 7 != 0, F.col("value")).alias("alt"),
        F.when(eid % 3 != 0, ((eid * 37) % 360).cast("double")).alias("angle"),
        F.concat(F.lit("/cap/"), text(uid), F.lit("/"), F.lpad(text(eid), 9, "0"), F.lit(".jpg")).alias("filename"),
        F.concat(F.lit("/cap/"), text(uid)).alias("folder"),
        F.concat(F.lpad(text(eid), 9, "0"), F.lit(".jpg")).alias("basename"),
        F.when(uid % 5 != 0, F.concat(F.lit("Make"), text(uid % 3))).alias("make"),
        F.concat(F.lit("Model"), text(uid % 4)).alias("model"),
        F.when(uid % 11 != 0, 1920 + uid % 3).cast("bigint").alias("width"),
        F.when(uid % 11 != 0, F.lit(1080)).cast("bigint").alias("height"),
        F.when(uid % 3 != 0, F.concat(F.lit("cam"), text(eid % 2))).alias("camera_uuid"),
        F.when(eid % 13 != 0, eid % 97).alias("filesize"),
        F.md5(text(eid).cast("binary")).alias("md5sum"),
    )


# The same view for the SQL side; `e0` keeps literals in double precision.
CAP = """cap AS (
  SELECT user_id AS track_id, event_id AS ord, event_type AS kind,
    epoch_us(ts) / 1e6 AS time,
    37e0 + (user_id % 50) * 0.2e0 + floor(value) * 0.0001e0 AS lat,
    -122e0 + (event_id % 13) * 0.0002e0 AS lon,
    CASE WHEN event_id % 7 <> 0 THEN value END AS alt,
    CASE WHEN event_id % 3 <> 0 THEN ((event_id * 37) % 360)::DOUBLE END AS angle,
    '/cap/' || user_id || '/' || lpad(event_id::VARCHAR, 9, '0') || '.jpg' AS filename,
    '/cap/' || user_id AS folder,
    lpad(event_id::VARCHAR, 9, '0') || '.jpg' AS basename,
    CASE WHEN user_id % 5 <> 0 THEN 'Make' || (user_id % 3) END AS make,
    'Model' || (user_id % 4) AS model,
    CASE WHEN user_id % 11 <> 0 THEN 1920 + user_id % 3 END AS width,
    CASE WHEN user_id % 11 <> 0 THEN 1080 END AS height,
    CASE WHEN user_id % 3 <> 0 THEN 'cam' || (event_id % 2) END AS camera_uuid,
    CASE WHEN event_id % 13 <> 0 THEN event_id % 97 END AS filesize,
    md5(event_id::VARCHAR) AS md5sum
  FROM events)"""

A2, B2 = 6378137.0 * 6378137.0, 6356752.314245 * 6356752.314245


def sql_norm(lat: str) -> str:
    return f"sqrt({A2!r}::DOUBLE * cos(radians({lat})) * cos(radians({lat})) + {B2!r}::DOUBLE * sin(radians({lat})) * sin(radians({lat})))"


def sql_x(lat: str, lon: str) -> str:
    return f"({A2!r}::DOUBLE * cos(radians({lat})) / {sql_norm(lat)} * cos(radians({lon})))"


def sql_y(lat: str, lon: str) -> str:
    return f"({A2!r}::DOUBLE * cos(radians({lat})) / {sql_norm(lat)} * sin(radians({lon})))"


def sql_z(lat: str) -> str:
    return f"({B2!r}::DOUBLE * sin(radians({lat})) / {sql_norm(lat)})"


def sql_dist(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dx = f"({sql_x(lat1, lon1)} - {sql_x(lat2, lon2)})"
    dy = f"({sql_y(lat1, lon1)} - {sql_y(lat2, lon2)})"
    dz = f"({sql_z(lat1)} - {sql_z(lat2)})"
    return f"sqrt({dx} * {dx} + {dy} * {dy} + {dz} * {dz})"


def sql_bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    raw = f"(radians({lon2}) - radians({lon1}))"
    d = f"(CASE WHEN {raw} > pi() THEN {raw} - 2 * pi() WHEN {raw} < -pi() THEN {raw} + 2 * pi() ELSE {raw} END)"
    east = f"sin({d}) * cos(radians({lat2}))"
    north = (
        f"cos(radians({lat1})) * sin(radians({lat2}))"
        f" - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})"
    )
    return f"((degrees(atan2({east}, {north})) + 360e0) % 360e0)"
