"""Sources and sinks: files that Spark writes from the tables, then reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, table
from trailframe.catalog.matching import LISTING, listing
from trailframe.catalog.text import events
from trailframe.catalog.tracks import W
from trailframe.functions import paths
from trailframe.functions import records as R
from trailframe.operators import telemetry as M
from trailframe.operators.ordered import number_globally
from trailframe.runtime import scratch_path
from trailframe.sources import readers, writers


def per_user_files(df, spark, label):
    """One text file per user from ``(track_id, ord, value)`` rows, lines in order."""
    path = scratch_path(spark, label)
    name = F.concat(F.lit("track_id="), F.coalesce(F.col("track_id").cast("string"), F.lit("none")), F.lit(".txt"))
    writers.write_named_files(df, path, name, ["ord"])
    return path


def user_of(column: str = "file"):
    return F.regexp_extract(column, r"track_id=(-?\w+)", 1).try_cast("bigint").alias("track_id")


def user_lines(spark, sf_dir):
    o = F.col("ord")
    return captures(spark, sf_dir).select("track_id", "ord", F.concat(F.lit("line "), o.cast("string")).alias("value"))


@query(
    "s1_media_listing",
    f"WITH {CAP} SELECT track_id, 1::BIGINT AS n_files, sum(length('line ' || ord) + 1)::BIGINT AS bytes FROM cap GROUP BY track_id",
)
def s1(spark, sf_dir):
    path = per_user_files(user_lines(spark, sf_dir), spark, "listing")
    files = readers.list_files(spark, [path])
    return files.groupBy(user_of("path")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


@query(
    "s2_file_finders",
    f"""WITH {LISTING} SELECT CASE ord % 5 WHEN 3 THEN 'xml' WHEN 4 THEN 'video' ELSE 'image' END AS kind,
      count(DISTINCT path) AS n FROM li GROUP BY kind""",
)
def s2(spark, sf_dir):
    files = listing(spark, sf_dir).dropDuplicates(["path"])
    kinds = files.select(paths.media_kind(F.col("path")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s15_content_hash",
    f"WITH {CAP} SELECT track_id, md5(string_agg('line ' || ord || chr(10), '' ORDER BY ord)) AS md5sum FROM cap GROUP BY track_id")
def s15(spark, sf_dir):
    path = per_user_files(user_lines(spark, sf_dir), spark, "hashing")
    return readers.hash_files(spark, [path]).select(user_of("path"), "md5sum")


RECORDS = f"""{CAP}, rec AS (SELECT *, ord % 9 = 4 AS bad FROM cap)"""


def with_errors(spark, sf_dir):
    o = F.col("ord")
    cap = captures(spark, sf_dir)
    return cap.withColumns(
        {"sequence_id": F.col("track_id"), "error": F.when(o % 9 == 4, R.error(R.ZIGZAG, "jumps", k=o))}
    )


@query(
    "s3_record_reader",
    f"""WITH {RECORDS} SELECT filename, round(lat, 6) AS lat, round(lon, 6) AS lon, alt, angle, (epoch_us(ts) // 1000) / 1e3 AS time, make, track_id::VARCHAR AS sequence_id, filesize
      FROM rec JOIN events ON event_id = ord WHERE NOT bad""",
)
def s3(spark, sf_dir):
    path = scratch_path(spark, "records")
    writers.write_image_records(with_errors(spark, sf_dir), path)
    images = readers.image_records(readers.read_records(spark, path)).filter("error IS NULL")
    return images.select(
        "filename", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt", "angle", "time", "make", "sequence_id", "filesize"
    )


@query(
    "s4_record_writer",
    f"""WITH {RECORDS} SELECT ord, CASE WHEN NOT bad THEN round(lat, 7) END AS lat, CASE WHEN NOT bad THEN round(alt, 3) END AS alt, CASE WHEN NOT bad THEN angle END AS heading,
      CASE WHEN NOT bad THEN substr(strftime(make_timestamp(round(time * 1e6)::BIGINT), '%Y_%m_%d_%H_%M_%S_%f'), 1, 23) END AS capture_time,
      CASE WHEN bad THEN 'ZigZagError' END AS error_type, CASE WHEN bad THEN ord::VARCHAR END AS var FROM rec""",
)
def s4(spark, sf_dir):
    df = with_errors(spark, sf_dir)
    text = df.select("ord", writers.image_record(df).alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return text.select(
        "ord",
        at("$.MAPLatitude").cast("double").alias("lat"),
        at("$.MAPAltitude").cast("double").alias("alt"),
        at("$.MAPCompassHeading.TrueHeading").cast("double").alias("heading"),
        at("$.MAPCaptureTime").alias("capture_time"),
        at("$.error.type").alias("error_type"),
        at("$.error.vars.k").alias("var"),
    )


@query(
    "s4_video_records",
    f"""WITH {CAP} SELECT track_id, row_number() OVER {W} - 1 AS position, (round(time * 1e6)::BIGINT // 1000) / 1e3 AS time, round(lat, 6) AS lat, round(lon, 6) AS lon, alt, angle,
      CASE WHEN ord % 4 = 0 THEN time + 60 END AS gps_epoch FROM cap WHERE track_id % 7 <> 2""",
)
def s4_videos(spark, sf_dir):
    """A video a user with its whole track; every seventh without one, which the rules refuse."""
    o = F.col("ord")
    epoch = F.when(o % 4 == 0, F.col("time") + 60)
    point = F.struct(o, "time", "lon", "lat", "alt", "angle", epoch.alias("epoch"))
    point = F.struct("time", o.alias("o"), point.alias("p"))
    videos = captures(spark, sf_dir).groupBy("track_id").agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda x: x["p"]).alias("points"), F.first("make").alias("make"), F.first("model").alias("model")
    )
    videos = videos.withColumns(
        {
            "points": F.when(F.col("track_id") % 7 != 2, F.col("points")), "filename": F.concat(F.lit("/v/"), F.col("track_id").cast("string")),
            "filetype": F.lit("gopro"), "filesize": F.col("track_id"), "md5sum": F.lit("ab"), "camera_uuid": F.lit("c"), "error": R.no_error(),
        }
    )
    path = scratch_path(spark, "videos")
    writers.write_video_records(videos, path)
    records = readers.read_records(spark, path)
    good = readers.video_records(records).filter("error IS NULL").select("filename")
    points = readers.video_points(records).join(good, "filename", "left_semi")
    return points.select(
        F.regexp_extract("filename", r"(\d+)$", 1).cast("bigint").alias("track_id"), F.col("ord").cast("bigint").alias("position"),
        F.round("time", 3).alias("time"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt", "angle", "gps_epoch",
    )


def gpx_points(spark, sf_dir):
    o = F.col("ord")
    return captures(spark, sf_dir).select(
        F.col("track_id").cast("string").alias("track"), "ord", "time", "lat", "lon", "alt", F.col("basename").alias("name"),
        F.when(o % 4 == 0, F.col("time") + 60).alias("gps_epoch"),
    )


GPX = f"""{CAP} SELECT track_id::VARCHAR AS name, row_number() OVER {W} - 1 AS position, (round((time + CASE WHEN ord % 4 = 0 THEN 60 ELSE 0 END) * 1e6)::BIGINT // 1000) / 1e3 AS time,
    round(lat, 6) AS lat, alt, CASE WHEN alt IS NULL THEN 2 ELSE 3 END AS fix FROM cap"""


@query("s5_gpx_reader", f"WITH {GPX}")
def s5(spark, sf_dir):
    return gpx_round_trip(spark, sf_dir)


def gpx_round_trip(spark, sf_dir):
    path = scratch_path(spark, "gpx")
    lines = writers.gpx_lines(gpx_points(spark, sf_dir), "track", ["time", "ord"], F.lit(1))
    writers.write_gpx(lines, path)
    points = readers.read_gpx_points(spark, path)
    return points.select(
        "name", F.col("ord").cast("bigint").alias("position"), "time", F.round("lat", 6).alias("lat"), "alt", F.col("gps_fix_type").alias("fix")
    )


@query(
    "s5_tracks_of_one_file",
    f"""WITH {CAP}, t AS (SELECT *, ord % 3 AS leg FROM cap),
      n AS (SELECT track_id, leg, dense_rank() OVER (PARTITION BY track_id ORDER BY leg) - 1 AS track_no FROM (SELECT DISTINCT track_id, leg FROM t))
      SELECT track_id, track_no, CASE WHEN leg = 1 THEN 'named' END AS name, count(*) AS n, min((epoch_us(ts) // 1000) / 1e3) AS t0, max((epoch_us(ts) // 1000) / 1e3) AS t1
      FROM t JOIN n USING (track_id, leg) JOIN events ON event_id = ord GROUP BY track_id, track_no, leg""",
)
def s5_tracks(spark, sf_dir):
    """One file per user with up to three tracks, of which one has a name."""
    cap = captures(spark, sf_dir).withColumn("leg", F.col("ord") % 3)
    stamp = F.concat(F.date_format(F.timestamp_micros((F.col("time") * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    point = F.concat(F.lit('<trkpt lat="1" lon="2"><time>'), stamp, F.lit("</time></trkpt>"))
    body = cap.select("track_id", F.struct("leg", F.lit(1).alias("p"), F.col("ord").alias("o")).alias("ord"), point.alias("value"))
    legs = cap.select("track_id", "leg").distinct()
    at = lambda p: F.struct("leg", F.lit(p).alias("p"), F.lit(0).cast("bigint").alias("o")).alias("ord")
    name = F.when(F.col("leg") == 1, "<name>named</name>").otherwise("")
    opened = legs.select("track_id", at(0), F.concat(F.lit("<trk>"), name, F.lit("<trkseg>")).alias("value"))
    closed = legs.select("track_id", at(2), F.lit("</trkseg></trk>").alias("value"))
    users = cap.select("track_id").distinct()
    edge = lambda leg, text: users.select(
        "track_id", F.struct(F.lit(leg).cast("bigint").alias("leg"), F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("o")).alias("ord"), F.lit(text).alias("value")
    )
    lines = edge(-1, "<gpx>").unionByName(opened).unionByName(body).unionByName(closed).unionByName(edge(9, "</gpx>"))
    points = readers.read_gpx_points(spark, per_user_files(lines, spark, "gpx-tracks"))
    return points.groupBy(user_of(), "track_no", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1")
    ).withColumn("track_no", F.col("track_no").cast("bigint"))


@query(
    "s6_gpx_writer",
    f"""WITH {CAP} SELECT track_id::VARCHAR AS track, count(*) AS n_points, count(alt) AS n_elevations, min(basename) AS first_name FROM cap GROUP BY track_id""",
)
def s6(spark, sf_dir):
    """The written document's lines, counted per track."""
    lines = writers.gpx_lines(gpx_points(spark, sf_dir), "track", ["time", "ord"], F.lit(1))
    points = lines.filter("_part = 1")
    return points.groupBy(F.col("_track").alias("track")).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.col("value").contains("<ele>").cast("bigint")).alias("n_elevations"),
        F.min(F.regexp_extract("value", "<name>(.*)</name>", 1)).alias("first_name"),
    )


@query(
    "s6_metadata_document",
    f"""WITH {CAP}, i AS (SELECT *, ord % 9 = 4 AS bad FROM cap WHERE track_id % 2 = 1), q AS (SELECT * FROM i WHERE NOT bad),
      v AS (SELECT track_id, count(*) AS n, track_id % 7 = 2 AS bad FROM cap WHERE track_id % 2 = 0 GROUP BY track_id),
      l AS (SELECT 1 AS section, filename AS track, 0 AS part, 0 AS time, '' AS name, 'ZigZagError' AS said FROM i WHERE bad
        UNION ALL SELECT 1, '/v/' || track_id, 0, 0, '', 'ZigZagError' FROM v WHERE bad
        UNION ALL SELECT 2, track_id::VARCHAR, 0, 0, '', arg_max_null(filesize, (time, basename))::VARCHAR FROM q GROUP BY track_id
        UNION ALL SELECT 2, track_id::VARCHAR, 1, time, basename, basename FROM q UNION ALL SELECT DISTINCT 2, track_id::VARCHAR, 2, 0, '', NULL FROM q
        UNION ALL SELECT 3, '/v/' || track_id, 0, 0, '', track_id::VARCHAR FROM v WHERE NOT bad UNION ALL SELECT 3, '/v/' || track_id, 2, 0, '', NULL FROM v WHERE NOT bad
        UNION ALL SELECT 3, '/v/' || track_id, 1, time, basename, NULL FROM cap JOIN v USING (track_id) WHERE NOT bad)
      SELECT row_number() OVER (ORDER BY section, track, part, time, name) - 1 AS line, section, track, part, said FROM l""",
)
def s6_document(spark, sf_dir):
    """Errors, sequences and videos of a run as the lines of one document, in order."""
    both = with_errors(spark, sf_dir)
    t = F.col("track_id")
    at = F.struct("time", "basename", F.struct("time", "lon", "lat", "alt", "angle", F.lit(None).cast("double").alias("epoch")).alias("p"))
    videos = both.filter(t % 2 == 0).groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["p"]).alias("points"))
    videos = videos.withColumns(
        {
            "filename": F.concat(F.lit("/v/"), t.cast("string")), "filetype": F.lit("gopro"), "filesize": t, "md5sum": F.lit("ab"), "make": F.lit("m"),
            "model": F.lit("n"), "camera_uuid": F.lit("c"), "error": F.when(t % 7 == 2, R.error(R.ZIGZAG, "jumps")),
        }
    )
    lines = writers.metadata_gpx_lines(both.filter(t % 2 == 1), videos)
    numbered = number_globally(lines, ["section", "track", "part", "place", "value"], "line")
    desc = F.regexp_extract("value", "<desc>(.*)</desc>", 1)
    said = F.when(F.col("part") == 1, F.nullif(F.regexp_extract("value", "<name>(.*)</name>", 1), F.lit(""))).when(
        F.col("part") == 0, F.coalesce(F.get_json_object(desc, "$.error.type"), F.get_json_object(desc, "$.filesize"))
    )
    return numbered.select("line", "section", "track", "part", said.alias("said"))


def nmea_lines(spark, sf_dir):
    """Plain NMEA logs, one per user: position lines, a dated sentence every fourth line."""
    df = events(spark, sf_dir)
    e = F.col("event_id")
    day = F.concat(F.substring("t_day", 9, 2), F.substring("t_day", 6, 2), F.substring("t_day", 3, 2))
    hms = F.concat("t_h", "t_m", "t_s", F.lit(".00"))
    place = F.concat(F.lit("37"), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(".50,S,012230.25,E,"))
    line = F.when(e % 4 == 1, F.concat(F.lit("$GPRMC,"), hms, F.lit(",A,"), place, F.lit("0,,"), day, F.lit(",,"))).otherwise(
        F.concat(F.lit("$GPGGA,"), hms, F.lit(","), place, F.lit("1,08,0.9,"), (e % 90).cast("string"), F.lit(",M,,M,,"))
    )
    return df.select(F.col("user_id").alias("track_id"), e.alias("ord"), line.alias("value"))


@query(
    "s7_nmea_reader",
    """WITH e AS (SELECT user_id AS track_id, event_id AS ord, epoch_us(ts) // 1000000 AS s, event_id % 4 = 1 AS rmc FROM events),
      d AS (SELECT *, last_value(CASE WHEN rmc THEN s // 86400 END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS a,
        first_value(CASE WHEN rmc THEN s // 86400 END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e)
      SELECT track_id, (coalesce(a, b) * 86400 + s % 86400)::DOUBLE AS time, round(-(37 + (ord % 60 + 0.5e0) / 60), 9) AS lat, round(122 + 30.25e0 / 60, 9) AS lon, (ord % 90)::DOUBLE AS alt FROM d WHERE NOT rmc""",
)
def s7(spark, sf_dir):
    path = per_user_files(nmea_lines(spark, sf_dir), spark, "nmea")
    lines = readers.read_lines(spark, path)
    track = M.nmea_track(lines, ["file"])
    return track.select(user_of(), "time", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "alt")


@query(
    "s9_tool_xml_index",
    """SELECT '/x/' || event_id AS path, 'IFD0:Make' AS tag, 'A&B ' || (event_id % 7) AS text FROM events UNION ALL
      SELECT '/x/' || event_id, 'GPS:GPSAltitude', (event_id % 90)::VARCHAR FROM events WHERE event_id % 2 = 0""",
)
def s9(spark, sf_dir):
    e = F.col("event_id").cast("string")
    n = F.col("event_id")
    altitude = F.when(n % 2 == 0, F.concat(F.lit("<GPS:GPSAltitude>"), (n % 90).cast("string"), F.lit("</GPS:GPSAltitude>"))).otherwise("")
    value = F.concat(
        F.lit("<rdf:Description rdf:about='/x/y/../"), e, F.lit("' xmlns:IFD0='http://example/a' xmlns:GPS='http://example/b'><IFD0:Make>A&amp;B "),
        (n % 7).cast("string"), F.lit("</IFD0:Make>"), altitude, F.lit("</rdf:Description>"),
    )
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), n.alias("ord"), value.alias("value"))
    users = df.select("track_id").distinct()
    head = users.select("track_id", F.lit(-1).alias("ord"), F.lit("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>").alias("value"))
    tail = users.select("track_id", F.lit(2**62).alias("ord"), F.lit("</rdf:RDF>").alias("value"))
    path = per_user_files(head.unionByName(df).unionByName(tail), spark, "xml")
    return readers.read_descriptions(spark, path).select("path", "tag", "text")


@query(
    "s12_history_store",
    """SELECT md5(c_custkey::VARCHAR) AS sequence_md5sum, c_name AS summary FROM customer WHERE c_custkey % 4 = 1""",
)
def s12(spark, sf_dir):
    c = F.col("c_custkey")
    digest = F.md5(c.cast("string").cast("binary"))
    customers = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "history")
    writers.append_history(customers.select(digest.alias("sequence_md5sum"), F.col("c_name").alias("summary")), path)
    wanted = customers.filter(c % 4 == 1).select(digest.alias("sequence_md5sum"))
    return writers.lookup_history(spark, path, wanted).select("sequence_md5sum", "summary")
