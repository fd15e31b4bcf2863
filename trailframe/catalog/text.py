"""Datetime, coordinate and record-text queries over texts built from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, micros, query, table
from trailframe.functions import records as R
from trailframe.functions import timeparse as P

S = "string"


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast(S), n, "0")


def civil(us: Column) -> dict[str, Column]:
    """Text parts of a UTC time: day, h, m, s and micros."""
    sec = F.floor(us / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(sec / 86400).cast("int"))
    left = F.pmod(sec, F.lit(86400))
    return {
        "day": F.date_format(day, "yyyy-MM-dd"),
        "h": _pad(F.floor(left / 3600), 2),
        "m": _pad(F.floor(F.pmod(left, F.lit(3600)) / 60), 2),
        "s": _pad(F.pmod(left, F.lit(60)), 2),
        "f": _pad(F.pmod(us, F.lit(1_000_000)), 6),
    }


def events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    df = ev.select("event_id", "user_id", "value", micros(ev).alias("us"))
    return df.withColumns({f"t_{k}": c for k, c in civil(F.col("us")).items()})


def clock(fraction: bool = True) -> Column:
    parts = [F.col("t_h"), F.lit(":"), F.col("t_m"), F.lit(":"), F.col("t_s")]
    return F.concat(*parts, *([F.lit("."), F.col("t_f")] if fraction else []))


US = "epoch_us(ts)"
SEC = f"({US} // 1000000)"


@query("c8_as_unix_time", f"SELECT event_id, {US} / 1e6 - CASE WHEN event_id % 3 = 0 THEN 3600 ELSE 0 END AS unix FROM events")
def c8(spark, sf_dir):
    eid = F.col("event_id")
    zone = F.when(eid % 3 == 0, "+01:00").when(eid % 3 == 1, "Z").otherwise("")
    text = F.concat(F.col("t_day"), F.lit("T"), clock(), zone)
    return events(spark, sf_dir).select("event_id", P.as_unix_time(P.parse_iso(text)).alias("unix"))


@query("c9_capture_time_format",
    "SELECT event_id, substr(strftime(ts, '%Y_%m_%d_%H_%M_%S_%f'), 1, 23) AS capture_time, (epoch_us(ts) // 1000) / 1e3 AS parsed FROM events")
def c9(spark, sf_dir):
    text = R.format_capture_time(F.col("us") / F.lit(1e6))
    df = events(spark, sf_dir).select("event_id", text.alias("capture_time"))
    return df.withColumn("parsed", R.parse_capture_time(F.col("capture_time")))


@query(
    "c10_dms_to_decimal",
    """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN round((event_id % 90) + (event_id % 60) / 60e0 + floor(value * 100) / 100e0 / 3600e0, 9) END AS decimal FROM events""",
)
def c10(spark, sf_dir):
    eid = F.col("event_id")
    d = lambda n, m: F.struct(n.cast("bigint").alias("num"), m.cast("bigint").alias("den"))
    one = F.lit(1)
    minutes = d(eid % 60, F.when(eid % 10 == 0, 0).otherwise(1))
    dms = F.array(d(eid % 90, one), minutes, d(F.floor(F.col("value") * 100), F.lit(100)))
    return events(spark, sf_dir).select("event_id", F.round(P.dms_to_decimal(dms), 9).alias("decimal"))


@query(
    "c12_coordinate_text",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN round((event_id % 180) + 0.5e0, 9) WHEN 1 THEN round(-((event_id % 180) + 0.5e0), 9)
      WHEN 2 THEN round(-((event_id % 180) + (event_id % 60 + 0.25e0) / 60), 9) END AS degrees FROM events""",
)
def c12(spark, sf_dir):
    eid = F.col("event_id")
    deg = (eid % 180).cast(S)
    text = (
        F.when(eid % 4 < 2, F.concat(deg, F.lit(".5")))
        .when(eid % 4 == 2, F.concat(deg, F.lit(","), (eid % 60).cast(S), F.lit(".25W")))
        .otherwise(F.lit("unknown"))
    )
    ref = F.when(eid % 4 == 1, "S")
    return events(spark, sf_dir).select("event_id", F.round(P.parse_coordinate(text, ref), 9).alias("degrees"))


@query("c13_alternative_datetimes", f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN {SEC}::DOUBLE ELSE {US} / 1e6 END AS unix FROM events WHERE event_id % 5 <> 4")
def c13(spark, sf_dir):
    eid = F.col("event_id")
    day, spaced = F.col("t_day"), F.regexp_replace("t_day", "-", ":")
    text = (
        F.when(eid % 5 == 4, F.lit("not a time"))
        .when(eid % 4 == 0, F.concat(day, F.lit("T"), clock(), F.lit("Z")))
        .when(eid % 4 == 1, F.concat(day, F.lit(" "), clock()))
        .when(eid % 4 == 2, F.concat(spaced, F.lit(" "), clock(), F.lit(" extra")))
        .otherwise(F.concat(spaced, F.lit(" "), clock(False)))
    )
    parsed = P.first_datetime(text, [P.parse_iso, P.parse_gps_datetime])
    out = events(spark, sf_dir).select("event_id", P.as_unix_time(parsed).alias("unix"))
    return out.filter("unix IS NOT NULL")


@query("c14_time_text_duration",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN hour(ts) * 3600 WHEN 1 THEN hour(ts) * 3600 + minute(ts) * 60
      WHEN 2 THEN (epoch_us(ts) % 86400000000) / 1e6 END::DOUBLE AS seconds FROM events""")
def c14(spark, sf_dir):
    eid = F.col("event_id")
    hm = F.concat("t_h", F.lit(":"), "t_m")
    text = F.when(eid % 4 == 0, F.col("t_h")).when(eid % 4 == 1, hm).when(eid % 4 == 2, clock()).otherwise(F.lit("1:x:2"))
    return events(spark, sf_dir).select("event_id", P.duration(text).alias("seconds"))


@query("c15_rational_duration",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round((event_id % 24) * 3600 + (event_id % 119) / 2e0 * 60 + (event_id % 300) / 5e0, 6) END AS seconds FROM events""")
def c15(spark, sf_dir):
    eid = F.col("event_id")
    ratio = lambda n, d: F.struct(n.cast("bigint").alias("num"), d.cast("bigint").alias("den"))
    values = F.array(
        ratio(eid % 24, F.lit(1)), ratio(eid % 119, F.when(eid % 7 == 0, 0).otherwise(2)), ratio(eid % 300, F.lit(5))
    )
    return events(spark, sf_dir).select("event_id", F.round(P.ratio_duration(values), 6).alias("seconds"))


@query(
    "c16_gps_datetime",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {US} / 1e6 WHEN 1 THEN ({US} - 19800000000) / 1e6 WHEN 2 THEN ({US} + 28800000000) / 1e6
      ELSE (({SEC} // 86400) + 1) * 86400e0 END AS unix FROM events""",
)
def c16(spark, sf_dir):
    """Zones, and 24:00:00 as the next midnight."""
    eid = F.col("event_id")
    date = F.regexp_replace("t_day", "-", ":")
    time = (
        F.when(eid % 4 == 0, F.concat(clock(), F.lit("Z")))
        .when(eid % 4 == 1, F.concat(clock(), F.lit("+05:30")))
        .when(eid % 4 == 2, F.concat(clock(), F.lit("-08:00")))
        .otherwise(F.lit("24:00:00"))
    )
    return events(spark, sf_dir).select("event_id", P.as_unix_time(P.parse_gps_parts(date, time)).alias("unix"))


@query(
    "c17_camera_datetime",
    f"""SELECT event_id, round({SEC} + CASE event_id % 3 WHEN 0 THEN (event_id % 1000) / 1e3 WHEN 1 THEN ({US} % 1000000) / 1e6 ELSE (event_id % 10) / 1e1 END
      - CASE WHEN event_id % 2 = 0 THEN 7200 ELSE 0 END, 5) AS unix FROM events""",
)
def c17(spark, sf_dir):
    eid = F.col("event_id")
    date = F.regexp_replace("t_day", "-", ":")
    text = F.concat(date, F.lit(" "), clock(fraction=True))
    subsec = (
        F.when(eid % 3 == 0, _pad(eid % 1000, 3))
        .when(eid % 3 == 1, F.lit("junk"))
        .otherwise(F.concat((eid % 10).cast(S), F.lit(" junk")))
    )
    offset = F.when(eid % 2 == 0, "+02:00")
    parsed = P.parse_camera_datetime(text, subsec, offset)
    return events(spark, sf_dir).select("event_id", F.round(P.as_unix_time(parsed), 5).alias("unix"))


@query("c18_offset_normalisation",
    """SELECT event_id, CASE WHEN d >= 86400 THEN d % 86400 WHEN d <= -86400 THEN -((-d) % 86400) ELSE d END AS seconds
      FROM (SELECT event_id, ((event_id % 400) - 200) * 1000e0 AS d FROM events)""")
def c18(spark, sf_dir):
    eid = F.col("event_id")
    delta = ((eid % 400) - 200) * 1000.0
    return events(spark, sf_dir).select("event_id", (P.normalize_offset(delta) + 0.0).alias("seconds"))


@query("c35_epoch_of_1904", f"SELECT event_id, ({SEC} + 2082844800) - 2082844800 AS unix FROM events")
def c35(spark, sf_dir):
    ticks = F.floor(F.col("us") / 1_000_000) + 2_082_844_800
    return events(spark, sf_dir).select("event_id", P.since_1904(ticks).alias("unix"))


@query(
    "c29_point_pack_unpack",
    f"""WITH {CAP} SELECT ord, trunc(time * 1000) / 1000 AS time, round(lon, 7) AS lon, round(lat, 7) AS lat, round(alt, 3) AS alt, angle,
      CASE WHEN ord % 3 <> 0 THEN time END AS gps_epoch, CASE WHEN ord % 3 <> 0 THEN CASE WHEN alt IS NULL THEN 2 ELSE 3 END END AS fix,
      CASE WHEN ord % 3 <> 0 THEN 'gps' ELSE 'point' END AS point_kind FROM cap""",
)
def c29(spark, sf_dir):
    epoch = F.when(F.col("ord") % 3 != 0, F.col("time"))
    packed = R.pack_point(*[F.col(c) for c in ("time", "lon", "lat", "alt", "angle")], epoch)
    df = captures(spark, sf_dir).select("ord", packed.alias("entry"))
    return df.select("ord", R.unpack_point(F.col("entry")).alias("p")).select("ord", "p.*")


@query(
    "c36_error_struct",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'NullIslandError' WHEN event_id % 4 = 1 THEN 'DuplicationError' END AS error_type,
      CASE WHEN event_id % 4 = 0 THEN 'at zero' WHEN event_id % 4 = 1 THEN 'same as before' END AS message,
      CASE WHEN event_id % 4 = 1 THEN (event_id % 100)::VARCHAR END AS distance FROM events""",
)
def c36(spark, sf_dir):
    eid = F.col("event_id")
    err = F.when(eid % 4 == 0, R.error(R.NULL_ISLAND, "at zero")).when(
        eid % 4 == 1, R.error(R.DUPLICATION, "same as before", distance=eid % 100)
    )
    df = events(spark, sf_dir).select("event_id", err.alias("e"))
    return df.select(
        "event_id", F.col("e.type").alias("error_type"), "e.message", F.col("e.vars")["distance"].alias("distance")
    )


@query(
    "c37_content_addressed_key",
    f"""WITH {CAP} SELECT ord, 'key_' || md5sum || CASE ord % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.zip' WHEN 2 THEN '.mp4' ELSE '' END AS session_key FROM cap""",
)
def c37(spark, sf_dir):
    o = F.col("ord")
    kind = F.when(o % 4 == 0, "image").when(o % 4 == 1, "zip").when(o % 4 == 2, "camm").otherwise("other")
    key = R.content_key(F.col("md5sum"), kind, "key_", R.KEY_SUFFIXES)
    return captures(spark, sf_dir).select("ord", key.alias("session_key"))


@query(
    "c38_point_kind_normalisation",
    f"""WITH {CAP}, e AS (SELECT *, CASE WHEN ord % 5 <> 0 THEN CASE WHEN ord % 4 = 0 THEN 0 ELSE time END END AS epoch, CASE WHEN ord % 2 = 0 THEN 3 END AS fix FROM cap)
      SELECT ord, CASE WHEN epoch > 0 THEN 'gps' ELSE 'mini_gps' END AS point_kind, CASE WHEN epoch > 0 THEN epoch END AS time_gps_epoch,
        CASE WHEN epoch > 0 THEN coalesce(fix, CASE WHEN alt IS NULL THEN 2 ELSE 3 END) END AS gps_fix_type FROM e""",
)
def c38(spark, sf_dir):
    o = F.col("ord")
    epoch = F.when(o % 5 != 0, F.when(o % 4 == 0, 0.0).otherwise(F.col("time")))
    fix = F.when(o % 2 == 0, 3)
    df = captures(spark, sf_dir).select("ord", R.normalize_point(epoch, fix, F.col("alt")).alias("p"))
    return df.select("ord", "p.*")


@query("f10_hex_digest_check",
    """SELECT doc_id, length(k) >= 4 AND NOT regexp_matches(k, '[^0-9a-fA-F]') AS ok FROM (SELECT doc_id,
      CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN substr(md5(text), 1, 3) WHEN 2 THEN md5(text) || 'g' ELSE upper(md5(text)) END AS k FROM documents)""")
def f10(spark, sf_dir):
    digest, i = F.md5(F.col("text").cast("binary")), F.col("doc_id") % 4
    key = (
        F.when(i == 0, digest).when(i == 1, F.substring(digest, 1, 3))
        .when(i == 2, F.concat(digest, F.lit("g"))).otherwise(F.upper(digest))
    )
    return table(spark, sf_dir, "documents").select("doc_id", R.is_hex_digest(key).alias("ok"))
