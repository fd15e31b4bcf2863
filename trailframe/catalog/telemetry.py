"""Logged telemetry: NMEA sentences, raw readings, sample streams, source choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import query, table
from trailframe.catalog.text import SEC, US, clock, events
from trailframe.functions import nmea
from trailframe.functions import telemetry as Y
from trailframe.operators import ordered as O
from trailframe.operators import telemetry as M
from trailframe.operators.ordered import Ordered


def dashcam_lines(spark, sf_dir):
    """One dash-cam line per event: camera clock behind by an hour, some junk.

    Users differ in the sentence types they log; every seventh line is damaged.
    """
    eid = F.col("event_id")
    df = events(spark, sf_dir)
    user = F.col("user_id")
    day = F.concat(F.substring("t_day", 9, 2), F.substring("t_day", 6, 2), F.substring("t_day", 3, 2))
    hms = F.concat("t_h", "t_m", "t_s", F.lit("."), F.substring("t_f", 1, 2))
    place = F.concat(
        F.lit("37"), F.lpad((eid % 60).cast("string"), 2, "0"), F.lit(".25,N,"),
        F.lit("122"), F.lpad((eid % 50).cast("string"), 2, "0"), F.lit(".5,W,"),
    )
    rmc = F.concat(F.lit("GPRMC,"), hms, F.lit(",A,"), place, F.lit("0.1,,"), day, F.lit(",,,A"))
    gga = F.concat(F.lit("GPGGA,"), hms, F.lit(","), place, (eid % 3).cast("string"), F.lit(",08,0.5,"), (eid % 90).cast("string"), F.lit(".5,M,-34.0,M,,"))
    gll = F.concat(F.lit("GPGLL,"), place, hms, F.lit(",A,A"))
    kind = F.when(user % 3 == 0, eid % 3).when(user % 3 == 1, 1 + eid % 2).otherwise(2)
    body = F.when(kind == 0, rmc).when(kind == 1, gga).otherwise(gll)
    good = F.lpad(F.hex(nmea.checksum(body).cast("bigint")), 2, "0")
    ending = F.when(eid % 7 == 0, F.lit("ZZ")).otherwise(good)
    camera_ms = F.floor(F.col("us") / 1000) - 3_600_000
    line = F.concat(F.lit("["), camera_ms.cast("string"), F.lit("]$"), body, F.lit("*"), ending)
    return df.select(user.alias("file"), eid.alias("ord"), line.alias("line"))


# What the lines above encode; centiseconds survive in the sentence clock.
LOG = f"""ev AS (SELECT user_id AS file, event_id AS ord, epoch_us(ts) AS us,
      CASE user_id % 3 WHEN 0 THEN event_id % 3 WHEN 1 THEN 1 + event_id % 2 ELSE 2 END AS kind FROM events WHERE event_id % 7 <> 0),
    sn AS (SELECT *, (us // 1000 - 3600000) / 1e3 AS camera, kind <> 1 OR ord % 3 >= 1 AS valid, us - us % 10000 AS gps_us FROM ev),
    cand AS (SELECT *, CASE WHEN kind = 0 THEN gps_us ELSE
        (((us // 1000 - 3600000) // 86400000) + CASE WHEN ((us // 1000 - 3600000) // 1000) % 86400 - (gps_us // 1000000) % 86400 > 43200 THEN 1
          WHEN (gps_us // 1000000) % 86400 - ((us // 1000 - 3600000) // 1000) % 86400 > 43200 THEN -1 ELSE 0 END) * 86400000000 + gps_us % 86400000000 END AS fixed_us,
      CASE WHEN kind = 0 THEN 0 ELSE 1 END AS rk FROM sn WHERE valid),
    off AS (SELECT file, round(arg_min(fixed_us, (rk, ord)) / 1e6 - arg_min(camera, (rk, ord)), 3) AS clock_offset FROM cand GROUP BY file)"""


@query("s8_dashcam_log_lines", f"WITH {LOG} SELECT file, ord, camera AS epoch_s, ['RMC', 'GGA', 'GLL'][kind + 1] AS type, valid FROM sn")
def s8(spark, sf_dir):
    log = M.read_log(dashcam_lines(spark, sf_dir))
    return log.select("file", "ord", "epoch_s", "s.type", "s.valid")


@query("a17_clock_offset", f"WITH {LOG} SELECT DISTINCT sn.file, coalesce(clock_offset, 0) AS clock_offset FROM sn LEFT JOIN off USING (file)")
def a17(spark, sf_dir):
    return M.clock_offsets(M.read_log(dashcam_lines(spark, sf_dir)), "file")


@query("a16_preferred_sentence_type",
    f"WITH {LOG} SELECT file, ['RMC', 'GGA', 'GLL'][min(kind) + 1] AS type, count(*) FILTER (kind = mk) AS n FROM (SELECT *, min(kind) OVER (PARTITION BY file) AS mk FROM sn WHERE valid) GROUP BY file")
def a16(spark, sf_dir):
    log = M.read_log(dashcam_lines(spark, sf_dir)).filter("s.valid")
    best = M.preferred(log, ["file"], M.sentence_rank(F.col("s.type")))
    return best.groupBy("file", F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c28_sentence_to_point",
    f"""WITH {LOG}, v AS (SELECT *, min(kind) OVER (PARTITION BY file) AS mk FROM sn WHERE valid)
      SELECT file, ord, round(camera + clock_offset, 3) AS time, round(37 + (ord % 60 + 0.25e0) / 60, 9) AS lat, round(-(122 + (ord % 50 + 0.5e0) / 60), 9) AS lon,
        CASE WHEN kind = 1 THEN ord % 90 + 0.5e0 END AS alt, CASE WHEN kind = 1 THEN 3 END AS fix FROM v JOIN off USING (file) WHERE kind = mk""",
)
def c28(spark, sf_dir):
    lines = dashcam_lines(spark, sf_dir)
    points = M.log_points(M.read_log(lines), "file", sized_by=[lines])
    return points.select(
        "file", "ord", "time", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "alt", "fix"
    )


def raw_points(spark, sf_dir):
    eid = F.col("event_id")
    df = events(spark, sf_dir)
    return df.withColumns(
        {
            "raw5": F.array(eid * 10000, -eid * 20000, eid * 10, eid % 1000, eid % 100),
            "scal5": F.array(F.lit(10000000), F.lit(10000000), F.lit(1000), F.when(eid % 9 == 0, 0).otherwise(1000), F.lit(100)),
            "stamp": F.concat(F.substring(F.regexp_replace("t_day", "-", ""), 3, 6), "t_h", "t_m", "t_s", F.lit("."), F.substring("t_f", 1, 3)),
        }
    )


@query(
    "c30_five_value_gps",
    f"""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id * 10000 / 1e7 END AS lat, CASE WHEN event_id % 9 <> 0 THEN (event_id % 1000) / 1e3 END AS ground_speed,
      ({US} // 1000) / 1e3 AS epoch_time FROM events""",
)
def c30(spark, sf_dir):
    p = Y.five_value_point(F.col("raw5"), F.col("scal5"))
    df = raw_points(spark, sf_dir).select("event_id", p.alias("p"), Y.compact_stamp_to_epoch(F.col("stamp")).alias("epoch_time"))
    return df.select("event_id", "p.lat", "p.ground_speed", "epoch_time")


@query(
    "c31_nine_value_gps",
    """SELECT event_id, 946684800 + (event_id % 9000) * 86400 + (event_id % 86400000) / 1e3 AS epoch_time, round((event_id % 900) / 1e2 * 100, 6) AS precision, [0, 2, 3][event_id % 3 + 1]::BIGINT AS fix FROM events""",
)
def c31(spark, sf_dir):
    eid = F.col("event_id")
    fix = F.when(eid % 3 == 0, 0).when(eid % 3 == 1, 2).otherwise(3)
    raw = F.array(eid, eid, eid, eid, eid, eid % 9000, eid % 86400000, eid % 900, fix.cast("bigint"))
    scales = F.array(*[F.lit(x) for x in (10000000, 10000000, 1000, 1000, 100, 1, 1000, 100, 1)])
    df = events(spark, sf_dir).select("event_id", Y.nine_value_point(raw, scales).alias("p"))
    return df.select("event_id", "p.epoch_time", F.round("p.precision", 6).alias("precision"), F.col("p.fix").cast("bigint").alias("fix"))


@query(
    "c32_sensor_calibration",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round((0.5e0 * x + 0.25e0 * y) / 10, 6) ELSE round(-y / 10e0, 6) END AS a,
      CASE WHEN event_id % 2 = 0 THEN round(y / 10e0, 6) ELSE round(x / 10e0, 6) END AS b, round(z / 10e0, 6) AS c
      FROM (SELECT event_id, event_id % 100 AS x, event_id % 70 AS y, event_id % 30 AS z FROM events)""",
)
def c32(spark, sf_dir):
    eid = F.col("event_id")
    values = F.array(eid % 100, eid % 70, eid % 30)
    real = F.array(*[F.lit(v) for v in (0.5, 0.25, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    swap = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0)])
    matrix = Y.calibration_matrix(F.when(eid % 2 == 0, real).otherwise(swap), F.lit("yXz"), F.lit("xYz"))
    # "yXz" over "xYz": y from -Y, X from -x.
    fixed = F.when(eid % 2 == 0, real).otherwise(matrix)
    out = Y.calibrate(values, F.array(F.lit(10.0)), fixed)
    df = events(spark, sf_dir).select("event_id", out.alias("v"))
    sign = F.when(eid % 2 == 0, 1).otherwise(-1)
    return df.select(
        "event_id", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1] * sign, 6).alias("b"), F.round(F.col("v")[2], 6).alias("c")
    )


@query("c33_unit_fixes", "SELECT event_id, round(value / 3.6e0, 9) AS speed, round(value * 100, 6) AS precision FROM events")
def c33(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select(
        "event_id", F.round(Y.kmh_to_ms(v), 9).alias("speed"), F.round(Y.metres_to_dop100(v), 6).alias("precision")
    )


@query("c34_edit_list_units",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id / 90000e0 END AS media_time, (event_id % 1000) / 600e0 AS duration FROM events")
def c34(spark, sf_dir):
    eid = F.col("event_id")
    ticks = F.when(eid % 5 == 0, -1).otherwise(eid)
    seg = Y.edit_to_seconds(ticks, eid % 1000, F.lit(90000), F.lit(600))
    return events(spark, sf_dir).select("event_id", seg.alias("s")).select("event_id", "s.*")


def element_stream(spark, sf_dir):
    """Per user: sample time markers, sometimes a duration, then two readings."""
    eid = F.col("event_id")
    df = events(spark, sf_dir)
    marker = eid % 4 == 0
    item = lambda i, tag, text, when: F.struct(
        (eid * 10 + i).alias("ord"), F.lit(tag).alias("tag"), F.when(when, text).cast("string").alias("text")
    )
    items = F.array(
        item(0, "SampleTime", (eid / 4).cast("bigint"), marker),
        item(1, "SampleDuration", eid % 16 + 1, marker & (eid % 8 == 0)),
        item(2, "GPSLongitude", eid % 180, ~(marker & (eid < 0))),
        item(3, "GPSLatitude", eid % 90, ~(marker & (eid < 0))),
    )
    rows = df.select(F.col("user_id").alias("file"), F.explode(items).alias("e")).select("file", "e.*")
    return rows.filter("text IS NOT NULL")


@query(
    "s11_sample_grouping",
    """WITH m AS (SELECT user_id AS file, event_id, event_id % 4 = 0 AS marker, event_id % 4 = 0 AND event_id % 8 = 0 AS dur FROM events),
      s AS (SELECT *, sum(marker::INT) OVER w AS sample, last_value(CASE WHEN marker THEN event_id // 4 END IGNORE NULLS) OVER w AS st,
        last_value(CASE WHEN dur THEN event_id % 16 + 1 END IGNORE NULLS) OVER w AS d FROM m WINDOW w AS (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
      l AS (SELECT file, sample, arg_max(struct_pack(d := d), event_id).d AS d FROM s GROUP BY file, sample)
      SELECT s.file, s.sample::BIGINT AS sample, st::DOUBLE AS sample_time, l.d::DOUBLE AS duration, 2 * count(*) AS n FROM s JOIN l USING (file, sample)
      WHERE st IS NOT NULL AND l.d IS NOT NULL GROUP BY ALL""",
)
def s11(spark, sf_dir):
    grouped = M.group_samples(element_stream(spark, sf_dir), "file", "SampleTime", "SampleDuration")
    return grouped.groupBy("file", "sample", "sample_time", "duration").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a24_list_length_consistency",
    """WITH g AS (SELECT o_custkey AS file, count(*) AS n FROM orders GROUP BY o_custkey),
      o AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderkey % 90 AS v FROM orders)
      SELECT o.file, ord, v::DOUBLE AS lat, CASE WHEN ord < n - 1 THEN (v + 1)::DOUBLE END AS alt,
        CASE WHEN o.file % 3 = 0 THEN 1700000000e0 END AS epoch_time FROM o JOIN g USING (file) WHERE o.file % 5 <> 0""",
)
def a24(spark, sf_dir):
    """A file per customer: too few longitudes in every fifth, one epoch in every third."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("ord"))
    v = (F.col("ord") % 90).cast("string")
    ranked = O.Ordered.of(o, ["file"], ["ord"]).scan(_i=O.index(), _n=O.group_total(F.lit(1))).rows()
    items = F.array(
        F.struct(F.lit("Lat").alias("tag"), v.alias("text")),
        F.struct(F.lit("Lon").alias("tag"), F.when((F.col("file") % 5 != 0) | (F.col("_i") > 1), v).alias("text")),
        F.struct(F.lit("Alt").alias("tag"), F.when(F.col("_i") < F.col("_n"), (F.col("ord") % 90 + 1).cast("string")).alias("text")),
        F.struct(F.lit("Epoch").alias("tag"), F.when((F.col("file") % 3 == 0) & (F.col("_i") == 1), "2023-11-14T22:13:20Z").alias("text")),
    )
    rows = ranked.select("file", "ord", F.explode(items).alias("e")).select("file", "ord", "e.*")
    out = M.align_lists(rows, ["file"], "Lon", "Lat", {"alt": "Alt"}, epoch="Epoch")
    return out.select("file", "ord", "lat", "alt", "epoch_time")


NAMES = "CASE event_id % 9 WHEN 0 THEN 'Hero' || (event_id % 12) || ' Black' WHEN 1 THEN 'GoPro Max' ELSE 'Camera ' || (event_id % 50) END"


@query(
    "a19_preferred_device_name",
    f"""SELECT user_id AS file, trim(arg_min(name, (CASE WHEN lower(name) LIKE '%hero%' THEN 0 WHEN lower(name) LIKE '%gopro%' THEN 1 ELSE 2 END, name))) AS name
      FROM (SELECT user_id, {NAMES} AS name FROM events) GROUP BY user_id""",
)
def a19(spark, sf_dir):
    eid = F.col("event_id")
    i = eid % 9
    name = (
        F.when(i == 0, F.concat(F.lit("Hero"), (eid % 12).cast("string"), F.lit(" Black")))
        .when(i == 1, "GoPro Max").otherwise(F.concat(F.lit("Camera "), (eid % 50).cast("string")))
    )
    df = events(spark, sf_dir).select(F.col("user_id").alias("file"), name.alias("name"))
    return M.preferred_device(df, "file")


@query(
    "a20_first_device_stream",
    """WITH p AS (SELECT user_id AS file, event_id AS ord, event_id // 100 AS sample, event_id % 3 AS device, event_id % 2 AS stream, CASE WHEN event_id % 5 < 2 THEN 9 ELSE 5 END AS vals FROM events),
      f AS (SELECT file, arg_min(device, (sample, device)) AS fd FROM p GROUP BY file),
      o AS (SELECT p.*, row_number() OVER () AS x FROM p JOIN f USING (file) WHERE device = fd),
      b AS (SELECT file, sample, min((stream, CASE WHEN vals = 9 THEN 0 ELSE 1 END)) AS best FROM o GROUP BY file, sample)
      SELECT o.file, ord FROM o JOIN b USING (file, sample) WHERE (stream, CASE WHEN vals = 9 THEN 0 ELSE 1 END) = best""",
)
def a20(spark, sf_dir):
    eid = F.col("event_id")
    df = events(spark, sf_dir).select(
        F.col("user_id").alias("file"), eid.alias("ord"), F.floor(eid / 100).alias("sample"),
        (eid % 3).alias("device"), (eid % 3).alias("device_no"), (eid % 2).alias("stream"),
        F.when(eid % 5 < 2, 9).otherwise(5).alias("values"),
    )
    return M.first_device(df, "file").select("file", "ord")


def streams(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")
    q = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("file"), n.alias("stream_no"),
        F.when(q % 3 == 0, "audio").otherwise("video").alias("codec_type"),
        F.when(q % 7 != 0, q * 10).alias("width"), F.when(q % 7 != 0, q * 5).alias("height"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") * 1000.0).alias("creation_time"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") * 1.5).alias("duration"),
    )


STREAMS = """s AS (SELECT l_orderkey AS file, l_partkey * 100000 + l_suppkey * 100 + l_quantity::BIGINT AS stream_no, CASE WHEN q % 3 = 0 THEN 'audio' ELSE 'video' END AS codec_type,
      CASE WHEN q % 7 <> 0 THEN q * 10 END AS width, CASE WHEN q % 7 <> 0 THEN q * 5 END AS height,
      CASE WHEN l_partkey % 3 = 0 THEN l_partkey * 1000e0 END - CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey * 1.5e0 END AS start
    FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem))"""


@query("a21_highest_resolution_stream",
    f"WITH {STREAMS} SELECT file, arg_max(stream_no, (coalesce(width, 0) * coalesce(height, 0), -stream_no)) AS stream_no FROM s WHERE codec_type = 'video' GROUP BY file")
def a21(spark, sf_dir):
    return M.largest_stream(streams(spark, sf_dir), "file").select("file", "stream_no")


@query(
    "a22_recording_start_time",
    f"""WITH {STREAMS} SELECT file, arg_min(start, (CASE WHEN codec_type = 'video' THEN 0 ELSE 1 END, CASE WHEN codec_type = 'video' THEN -coalesce(width, 0) * coalesce(height, 0) ELSE 0 END, stream_no))
      AS start_time FROM s GROUP BY file""",
)
def a22(spark, sf_dir):
    return M.recording_start(streams(spark, sf_dir), "file")


@query(
    "a23_first_source_with_data",
    """WITH p AS (SELECT user_id AS file, event_id AS ord, CASE WHEN user_id % 4 = 0 THEN 2 + event_id % 2 WHEN user_id % 4 = 1 THEN event_id % 3 ELSE 1 + event_id % 4 END AS source FROM events)
      SELECT file, ord, source FROM (SELECT *, min(source) OVER (PARTITION BY file) AS b FROM p) WHERE source = b""",
)
def a23(spark, sf_dir):
    eid = F.col("event_id")
    u = F.col("user_id")
    source = F.when(u % 4 == 0, 2 + eid % 2).when(u % 4 == 1, eid % 3).otherwise(1 + eid % 4)
    df = events(spark, sf_dir).select(u.alias("file"), eid.alias("ord"), source.alias("source"))
    return M.first_source_with_data(df, ["file"], F.col("source"))


@query(
    "o6_frames_across_streams",
    """SELECT user_id AS file, event_id // 3 AS frame_idx, max(CASE WHEN event_id % 3 = 0 THEN 'f' || event_id END) AS v,
      max(CASE WHEN event_id % 3 = 1 THEN 'f' || event_id END) AS "1" FROM events GROUP BY ALL""",
)
def o6(spark, sf_dir):
    eid = F.col("event_id")
    stream = F.when(eid % 3 == 0, "v").when(eid % 3 == 1, "1").otherwise("2")
    df = events(spark, sf_dir).select(
        F.col("user_id").alias("file"), F.floor(eid / 3).alias("frame_idx"), stream.alias("stream"),
        F.concat(F.lit("f"), eid.cast("string")).alias("path"),
    )
    return M.group_frames(df, ["file"], ["v", "1"])


@query(
    "a23_tool_xml_tracks",
    f"""WITH e AS (SELECT user_id AS file, event_id AS ord, epoch_us(ts) AS us, event_id % 180 AS lon, event_id % 90 AS lat FROM events),
      a AS (SELECT file, ord, us / 1e6 - min(us) OVER (PARTITION BY file) / 1e6 AS time, lon, lat FROM e WHERE file % 3 = 0),
      m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM e WHERE file % 3 <> 0),
      d AS (SELECT *, i // 3 AS s, lag(lon * 1000 + lat) OVER (PARTITION BY file, i // 3 ORDER BY ord) AS p FROM m),
      b AS (SELECT file, ord, s, lon, lat, count(*) OVER (PARTITION BY file, s) AS k, row_number() OVER (PARTITION BY file, s ORDER BY ord) - 1 AS j
        FROM d WHERE p IS DISTINCT FROM lon * 1000 + lat)
      SELECT file, round(time, 4) AS time, lon::DOUBLE AS lon, lat::DOUBLE AS lat, NULL::BIGINT AS fix, 0::BIGINT AS source_no FROM a
      UNION ALL SELECT file, round(s * 10 + j * (6e0 / k), 4), lon, lat, 3, 2 FROM b""",
)
def a23_tracks(spark, sf_dir):
    """Every third user's video lists its track; the others give samples of three points."""
    ev = events(spark, sf_dir)
    u, e = F.col("user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    rows = Ordered.of(ev, ["user_id"], ["event_id"]).scan(_i=O.index()).rows()
    listed = u % 3 == 0
    opens = ~listed & ((F.col("_i") - 1) % 3 == 0)
    ns = F.when(listed, "QuickTime:").otherwise("Track1:")
    item = lambda i, tag, value, when: F.struct(
        (e * 10 + i).alias("ord"), F.concat(ns, F.lit(tag)).alias("tag"), F.when(when, value).alias("text")
    )
    stamp = F.concat("t_day", F.lit("T"), clock(), F.lit("Z"))
    items = F.array(
        item(0, "SampleTime", text((F.col("_i") - 1) / 3 * 10.0), opens),
        item(1, "SampleDuration", F.lit("6"), opens),
        item(2, "GPSMeasureMode", F.lit("3"), opens),
        item(3, "GPSDateTime", stamp, listed),
        item(4, "GPSLongitude", text(e % 180), F.lit(True)),
        item(5, "GPSLatitude", text(e % 90), F.lit(True)),
    )
    elements = rows.select(u.alias("file"), F.explode(items).alias("x")).select("file", "x.*").filter("text IS NOT NULL")
    out = M.tool_video_tracks(elements, "file")
    return out.select("file", F.round("time", 4).alias("time"), "lon", "lat", F.col("fix").cast("bigint").alias("fix"), F.col("source_no").cast("bigint").alias("source_no"))
