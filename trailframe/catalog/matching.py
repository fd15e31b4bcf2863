"""File matching, source cascade and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, table
from trailframe.functions import paths
from trailframe.functions import records as R
from trailframe.operators import matching as X
from trailframe.operators import ordered as O
from trailframe.operators.ordered import Ordered

text = lambda c: c.cast("string")

# A listing: frames of user videos, stills, and other files, from the events.
LISTING = """li AS (SELECT event_id AS ord, user_id, CASE event_id % 5
    WHEN 0 THEN '/m/v' || user_id || '.MP4/v' || user_id || '_v_' || lpad((event_id % 1000)::VARCHAR, 6, '0') || '.jpg'
    WHEN 1 THEN '/m/v' || user_id || '.MP4/w' || user_id || '_v_000001.jpg'
    WHEN 2 THEN '/m/still/' || event_id || '.JPeG' WHEN 3 THEN '/m/x/' || event_id || '.xml' ELSE '/m/clip/c' || event_id || '.mov' END AS path FROM events)"""


def listing(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    e, u = F.col("event_id"), text(F.col("user_id"))
    number = F.lpad(text(e % 1000), 6, "0")
    path = (
        F.when(e % 5 == 0, F.concat(F.lit("/m/v"), u, F.lit(".MP4/v"), u, F.lit("_v_"), number, F.lit(".jpg")))
        .when(e % 5 == 1, F.concat(F.lit("/m/v"), u, F.lit(".MP4/w"), u, F.lit("_v_000001.jpg")))
        .when(e % 5 == 2, F.concat(F.lit("/m/still/"), text(e), F.lit(".JPeG")))
        .when(e % 5 == 3, F.concat(F.lit("/m/x/"), text(e), F.lit(".xml")))
        .otherwise(F.concat(F.lit("/m/clip/c"), text(e), F.lit(".mov")))
    )
    return ev.select(e.alias("ord"), "user_id", path.alias("path"))


def videos(spark, sf_dir):
    """Two videos per customer in two folders, one name; the second listed counts."""
    c = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(c, F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    folder = F.when(F.col("i") == 0, "/a/v").otherwise("/b/v")
    return df.select(
        F.concat(folder, text(c), F.lit(".MP4")).alias("path"), (c * 2 + F.col("i")).alias("ord"), c.alias("user_id")
    )


@query("f1_media_classification",
    f"WITH {LISTING} SELECT ord, CASE event_id % 5 WHEN 3 THEN 'xml' WHEN 4 THEN 'video' ELSE 'image' END AS kind FROM (SELECT *, ord AS event_id FROM li)")
def f1(spark, sf_dir):
    return listing(spark, sf_dir).select("ord", paths.media_kind(F.col("path")).alias("kind"))


@query(
    "f2_filetype_filter_intersection",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'camm' WHEN 1 THEN '' WHEN 2 THEN 'camm,gopro' WHEN 3 THEN 'blackvue,camm,gopro,video'
      WHEN 4 THEN 'image' END AS common FROM orders""",
)
def f2(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    arr = lambda *t: F.array(*[F.lit(x) for x in t])
    a = (
        F.when(k == 0, arr("camm")).when(k == 1, arr("camm")).when(k == 2, arr("camm", "gopro"))
        .when(k == 3, arr("video")).when(k == 4, arr("image"))
    )
    b = (
        F.when(k == 0, arr("gopro", "video")).when(k == 1, arr("gopro")).when(k == 2, arr("video"))
        .when(k == 3, arr("video"))
    )
    common = paths.combine_filters(a, b)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(common, ",").alias("common"))


@query("f3_source_filter_split",
    f"WITH {LISTING} SELECT ord, CASE ord % 5 WHEN 3 THEN false WHEN 4 THEN ord % 2 = 0 OR ord % 3 = 0 ELSE ord % 3 <> 0 OR ord % 2 = 0 END AS taken FROM li")
def f3(spark, sf_dir):
    o = F.col("ord")
    allowed = F.when(o % 2 == 0, F.lit(None)).when(o % 3 == 0, F.array(F.lit("gopro"))).otherwise(F.array(F.lit("image")))
    return listing(spark, sf_dir).select("ord", paths.passes_filter(paths.media_kind(F.col("path")), allowed).alias("taken"))


@query("s16_path_deduplication", "SELECT min(event_id) AS ord FROM events GROUP BY user_id, value::BIGINT")
def s16(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    v = F.bround("value", 0).cast("bigint")
    step = F.when(F.col("event_id") % 2 == 0, "/./").otherwise("/z/../")
    path = F.concat(F.lit("/d/"), text(F.col("user_id")), step, text(v))
    files = ev.select(F.col("event_id").alias("ord"), path.alias("path"))
    return X.first_per_path(files, "ord").select("ord")


@query(
    "j9_frame_video_match",
    f"WITH {LISTING} SELECT ord, '/b/v' || user_id || '.MP4' AS video_path, 'v' AS stream, ord % 1000 AS frame_idx FROM li WHERE ord % 5 = 0",
)
def j9(spark, sf_dir):
    frames = X.match_frames(listing(spark, sf_dir).select("ord", "path"), videos(spark, sf_dir))
    numbered = frames.withColumn("n", X.frame_number(F.col("path")))
    return numbered.select("ord", "video_path", "n.stream", "n.frame_idx")


@query(
    "j10_frame_geotag",
    f"""WITH {CAP}, fr AS (SELECT track_id, ord, time, track_id % 7 = 3 AS failed FROM cap WHERE ord % 5 = 0),
      sh AS (SELECT track_id, min(time) AS c0 FROM fr WHERE NOT failed GROUP BY track_id),
      p AS (SELECT c.track_id, sh.c0 + (c.time - min(c.time) OVER (PARTITION BY c.track_id)) AS t, c.lat, c.lon FROM cap c LEFT JOIN sh USING (track_id) WHERE ord % 5 <> 0),
      b AS (SELECT track_id, min(t) AS t0, max(t) AS t1 FROM p GROUP BY track_id),
      pt AS (SELECT *, struct_pack(t := t, lat := lat, lon := lon) AS pt FROM p WHERE t IS NOT NULL),
      pl AS (SELECT *, lead(pt) OVER (PARTITION BY track_id ORDER BY t) AS nxt FROM pt),
      j AS (SELECT f.*, b.t0, b.t1, x.pt AS bp, y.pt AS ap, y.nxt AS anxt FROM fr f LEFT JOIN b USING (track_id)
        ASOF LEFT JOIN pl x ON f.track_id = x.track_id AND f.time > x.t ASOF LEFT JOIN pl y ON f.track_id = y.track_id AND f.time <= y.t),
      s AS (SELECT *, CASE WHEN bp IS NULL THEN ap ELSE bp END AS s, CASE WHEN bp IS NULL THEN anxt ELSE ap END AS e FROM j)
      SELECT ord, CASE WHEN failed THEN 'InvalidVideoError' WHEN t0 - time > 0.001e0 OR time - t1 > 0.001e0 THEN 'OutsideGPXTrackError' END AS error_type,
        CASE WHEN NOT failed AND NOT (t0 - time > 0.001e0 OR time - t1 > 0.001e0) THEN round(s.lat + (e.lat - s.lat) * CASE WHEN s.t = e.t THEN 0 ELSE (time - s.t) / (e.t - s.t) END, 6) END AS lat,
        'Model' || (track_id % 4) AS model FROM s""",
)
def j10(spark, sf_dir):
    """Frames are every fifth event of a user; the other events are the video's GPS."""
    o = F.col("ord")
    cap = captures(spark, sf_dir)
    u = text(F.col("track_id"))
    video = F.concat(F.lit("/m/v"), u, F.lit(".MP4"))
    images = cap.filter(o % 5 == 0).select(
        F.concat(video, F.lit("/v"), u, F.lit("_v_"), text(o), F.lit(".jpg")).alias("path"), "ord", "time"
    )
    failed = R.error(R.INVALID_VIDEO, "Invalid video")
    known = cap.groupBy("track_id").agg(F.first("model").alias("model")).select(
        video.alias("path"), F.col("track_id").alias("ord"), F.lit("Maker").alias("make"), "model",
        F.lit(None).cast("string").alias("camera_uuid"), F.when(F.col("track_id") % 7 == 3, failed).alias("error"),
    )
    gps = cap.filter(o % 5 != 0)
    start = gps.groupBy("track_id").agg(F.min("time").alias("t0"))
    points = gps.join(start, "track_id").select(
        video.alias("video_path"), "ord", (F.col("time") - F.col("t0")).alias("time"), "lat", "lon", "alt"
    )
    out = X.geotag_frames(images, known, points)
    return out.select("ord", F.col("error.type").alias("error_type"), F.round("lat", 6).alias("lat"), "model")


@query(
    "j11_sidecar_resolution",
    """SELECT c_custkey, '/b/sub/v' || c_custkey || '_MP4.gpx' AS sidecar, CASE WHEN c_custkey % 3 = 0 THEN 'VideoGPSNotFoundError' END AS error_type FROM customer""",
)
def j11(spark, sf_dir):
    vids = videos(spark, sf_dir).filter("path LIKE '/b/%'")
    have = vids.filter("user_id % 3 <> 0").select(
        F.concat(F.lit("/b/sub/v"), text(F.col("user_id")), F.lit("_MP4.gpx")).alias("path")
    )
    out = X.attach_sidecars(vids, have, pattern="other/../sub/%g%e.gpx".replace("%e", "_MP4"))
    return out.select(F.col("user_id").alias("c_custkey"), "sidecar", F.col("error.type").alias("error_type"))


def xml_index(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").filter("o_custkey % 4 <> 0").select(
        F.concat(F.lit("/b/v"), text(c), F.when(F.col("o_orderkey") % 3 == 0, ".MP4").otherwise(".bak")).alias("path"),
        F.concat(F.lit("/b/v"), text(c), F.lit(".xml")).alias("source"),
        F.col("o_orderkey").alias("ord"), text(F.col("o_orderkey")).alias("record"),
    )


@query(
    "j12_xml_match_by_path",
    """SELECT c_custkey, max(o_orderkey) AS record, CASE WHEN max(o_orderkey) IS NULL THEN 'ExifToolXMLNotFoundError' END AS error_type
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_custkey % 4 <> 0 AND o_orderkey % 3 = 0 GROUP BY c_custkey""",
)
def j12(spark, sf_dir):
    vids = videos(spark, sf_dir).filter("path LIKE '/b/%'")
    out = X.match_index(vids, xml_index(spark, sf_dir))
    return out.select(
        F.col("user_id").alias("c_custkey"), F.col("record").cast("bigint").alias("record"), F.col("error.type").alias("error_type")
    )


@query(
    "j12_xml_match_by_pattern",
    """SELECT c_custkey, coalesce(max(o_orderkey) FILTER (o_orderkey % 3 = 0), min(o_orderkey)) AS record,
      CASE WHEN min(o_orderkey) IS NULL THEN 'ExifToolXMLNotFoundError' END AS error_type
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_custkey % 4 <> 0 GROUP BY c_custkey""",
)
def j12_pattern(spark, sf_dir):
    vids = videos(spark, sf_dir).filter("path LIKE '/b/%'")
    out = X.match_index(vids, xml_index(spark, sf_dir), by_pattern="%g.xml")
    return out.select(
        F.col("user_id").alias("c_custkey"), F.col("record").cast("bigint").alias("record"), F.col("error.type").alias("error_type")
    )


@query(
    "j13_frames_and_stills_split",
    f"WITH {LISTING} SELECT ord, CASE ord % 5 WHEN 0 THEN 'frame' ELSE 'still' END AS origin FROM li WHERE ord % 5 < 3",
)
def j13(spark, sf_dir):
    # Two events may name one frame file; keep files unique by their event.
    o = F.col("ord")
    images = listing(spark, sf_dir).filter(paths.media_kind(F.col("path")) == "image")
    unique = images.withColumn("path", F.regexp_replace("path", r"\.(\w+)$", F.concat(F.lit("-"), text(o), F.lit(".$1"))))
    frames = X.match_frames(unique.select("ord", "path"), videos(spark, sf_dir)).withColumn("origin", F.lit("frame"))
    still = lambda df: df.withColumn("origin", F.lit("still"))
    return X.split_frames_and_stills(unique.select("ord", "path"), frames, still).select("ord", "origin")


CASCADE = f"""{CAP}, a AS (SELECT ord, CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GeoTaggingError' WHEN 2 THEN 'GPSNoiseError' ELSE 'none' END AS e, 0 AS n FROM cap WHERE ord % 5 <> 4),
  b AS (SELECT ord, CASE ord % 3 WHEN 0 THEN NULL WHEN 1 THEN 'VideoGPSNotFoundError' ELSE 'ExifToolXMLNotFoundError' END AS e, 1 AS n FROM cap WHERE ord % 7 <> 6),
  c AS (SELECT ord, CASE ord % 2 WHEN 0 THEN NULL ELSE 'GeoTaggingError' END AS e, 2 AS n FROM cap WHERE ord % 11 <> 10)"""


@query(
    "j14_source_cascade",
    f"""WITH {CASCADE}, u AS (SELECT ord, CASE WHEN e = 'none' THEN NULL ELSE e END AS e, n FROM (FROM a UNION ALL FROM b UNION ALL FROM c))
      SELECT ord, arg_min(struct_pack(e := e), n).e AS error_type, min(n) AS source_no FROM u
      WHERE n = 2 OR e IS NULL OR e = 'GPSNoiseError' GROUP BY ord""",
)
def j14(spark, sf_dir):
    o = F.col("ord")
    cap = captures(spark, sf_dir)
    err = lambda t: R.error(t, "no position")
    a = cap.filter(o % 5 != 4).select(
        "ord", F.when(o % 4 == 1, err(R.GEOTAGGING)).when(o % 4 == 2, err(R.GPS_NOISE)).alias("error"), "lat"
    )
    b = cap.filter(o % 7 != 6).select(
        "ord", F.when(o % 3 == 1, err(R.VIDEO_GPS_NOT_FOUND)).when(o % 3 == 2, err(R.TOOL_XML_NOT_FOUND)).alias("error"), "lat"
    )
    c = cap.filter(o % 11 != 10).select("ord", F.when(o % 2 == 1, err(R.GEOTAGGING)).alias("error"), "lat")
    out = X.cascade([a, b, c], key="ord")
    return out.select("ord", F.col("error.type").alias("error_type"), "source_no")


@query("f14_retryable_errors", "SELECT event_id AS ord, event_id % 4 IN (0, 1) AS retryable FROM events")
def f14(spark, sf_dir):
    o = F.col("ord")
    err = (
        F.when(o % 4 == 0, R.error(R.GEOTAGGING, "x")).when(o % 4 == 1, R.error(R.TOOL_NOT_FOUND, "x"))
        .when(o % 4 == 2, R.error(R.DUPLICATION, "x"))
    )
    return captures(spark, sf_dir).select("ord", R.is_retryable(err).alias("retryable"))


@query("j17_records_with_files", "SELECT event_id AS ord FROM events WHERE event_id % 3 <> 0")
def j17(spark, sf_dir):
    o = F.col("ord")
    cap = captures(spark, sf_dir).select("ord", "filename")
    dotted = cap.withColumn("filename", F.regexp_replace("filename", "^/cap/", "/cap/./"))
    files = cap.filter(o % 3 != 0).select(F.col("filename").alias("path"))
    return X.existing_records(dotted, files).select("ord")


@query("f4_good_and_error_rows", "SELECT event_id % 3 = 0 AS bad, count(*) AS n FROM events GROUP BY ALL")
def f4(spark, sf_dir):
    o = F.col("ord")
    cap = captures(spark, sf_dir).withColumn("error", F.when(o % 3 == 0, R.error(R.ZIGZAG, "x")))
    count = lambda df, bad: df.groupBy(F.lit(bad).alias("bad")).agg(F.count(F.lit(1)).alias("n"))
    return count(X.good_rows(cap), False).unionByName(count(X.error_rows(cap), True))


@query("x1_results_and_errors_union", "SELECT event_id AS ord, CASE WHEN event_id % 3 <> 0 THEN user_id END AS track_id, CASE WHEN event_id % 3 = 0 THEN 'ZigZagError' END AS error_type FROM events")
def x1(spark, sf_dir):
    o = F.col("ord")
    cap = captures(spark, sf_dir)
    good = cap.filter(o % 3 != 0).select("ord", "track_id")
    bad = cap.filter(o % 3 == 0).select("ord", R.error(R.ZIGZAG, "x").alias("error"))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.select("ord", "track_id", F.col("error.type").alias("error_type"))


@query("x2_paths_not_yet_handled", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def x2(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("x3_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events")
def x3(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(users)


@query("o3_upload_order_of_videos", "SELECT path AS filename, row_number() OVER (ORDER BY path) - 1 AS upload_idx FROM (SELECT '/b/v' || c_custkey || '.MP4' AS path FROM customer UNION ALL SELECT '/a/v' || c_custkey || '.MP4' FROM customer)")
def o3(spark, sf_dir):
    files = videos(spark, sf_dir).select(F.col("path").alias("filename"))
    return X.sort_for_upload(files)
