"""Tag-table queries: captures described by tag rows built from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import query, table
from trailframe.catalog.text import SEC, US, clock, events
from trailframe.functions import tags as G


def tag_rows(df, pairs):
    """(file, ord, tag, text) rows; a pair whose text is null is absent."""
    eid = F.col("event_id")
    items = [F.struct(F.lit(i).alias("ord"), F.lit(t).alias("tag"), c.cast("string").alias("text")) for i, (t, c) in enumerate(pairs)]
    rows = df.select(eid.alias("file"), F.explode(F.array(*items)).alias("e")).select("file", "e.*")
    return rows.filter("text IS NOT NULL")


def tool_tags(spark, sf_dir):
    eid = F.col("event_id")
    df = events(spark, sf_dir)
    colon_day = F.regexp_replace("t_day", "-", ":")
    pairs = [
        ("IFD0:Make", F.when(eid % 4 == 0, F.concat(F.lit(" Make"), (eid % 7).cast("string"), F.lit(" ")))),
        ("ExifIFD:LensMake", F.when(eid % 4 == 1, F.lit("Lens"))),
        ("IFD1:Model", F.when(eid % 3 != 0, F.concat(F.lit("M"), (eid % 5).cast("string")))),
        ("File:ImageWidth", F.when(eid % 2 == 0, 4000 + eid % 10)),
        ("ExifIFD:ExifImageWidth", F.lit("wide")),
        ("IFD0:ExifImageWidth", F.lit(3000)),
        ("IFD0:ExifImageHeight", F.when(eid % 5 != 0, 2000 + eid % 10)),
        ("ExifIFD:Orientation", eid % 11),
        ("GPS:GPSImgDirection", F.when(eid % 3 == 0, eid % 360)),
        ("GPS:GPSTrack", F.lit("12.5")),
        ("GPS:GPSAltitude", F.when(eid % 6 != 0, (eid % 100) + 0.5)),
        ("GPS:GPSAltitudeRef", eid % 3),
        ("GPS:GPSLongitude", F.when(eid % 3 != 1, (eid % 180) + 0.25)),
        ("GPS:GPSLongitudeRef", F.when(eid % 2 == 0, F.lit("West")).otherwise("E")),
        ("GPS:GPSLatitude", F.when(eid % 3 == 0, (eid % 90) + 0.125)),
        ("GPS:GPSLatitudeRef", F.when(eid % 2 == 0, F.lit("s")).otherwise("N")),
        ("Composite:GPSLongitude", F.when(eid % 5 != 0, (eid % 180) - 0.75)),
        ("Composite:GPSLatitude", F.when(eid % 5 != 0, (eid % 90) - 0.5)),
        ("GPS:GPSDateStamp", F.when(eid % 4 == 0, F.when(eid % 8 == 0, colon_day).otherwise("1970:01:01"))),
        ("GPS:GPSTimeStamp", F.when(eid % 4 == 0, F.concat(clock(False), F.lit("Z")))),
        ("ExifIFD:DateTimeOriginal", F.when(eid % 4 != 3, F.concat(colon_day, F.lit(" "), clock(False)))),
        ("ExifIFD:SubSecTimeOriginal", F.lpad((eid % 100).cast("string"), 3, " ")),
        ("ExifIFD:OffsetTimeOriginal", F.when(eid % 2 == 0, F.lit("+01:00"))),
        ("XMP-exif:ModifyDate", F.when(eid % 8 == 3, F.concat("t_day", F.lit("T"), clock(), F.lit("Z")))),
        ("ExifIFD:BodySerialNumber", F.when(eid % 3 == 0, F.concat(F.lit("A-"), eid.cast("string"))).when(eid % 3 == 1, "--")),
        ("ExifIFD:LensSerialNumber", F.when(eid % 2 == 0, F.lit("L 1"))),
    ]
    return G.collect_tags(tag_rows(df, pairs), ["file"])


def tool_properties(spark, sf_dir):
    df = tool_tags(spark, sf_dir)
    return df.withColumns(G.properties(F.col("tags"), G.TOOL_TAGS))


@query(
    "s10_tag_values_by_name",
    """WITH e AS (SELECT l_orderkey AS file, l_linenumber AS tag, l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem)
      SELECT file, tag::BIGINT AS tag, string_agg(q, ',' ORDER BY l_partkey, l_suppkey, q) AS texts FROM e GROUP BY file, tag""",
)
def s10(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    place = F.struct("l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))
    rows = li.select(
        F.col("l_orderkey").alias("file"), place.alias("ord"),
        F.col("l_linenumber").cast("string").alias("tag"), F.col("l_quantity").cast("bigint").cast("string").alias("text"),
    )
    tags = G.collect_tags(rows, ["file"]).select("file", F.explode("tags").alias("tag", "texts"))
    return tags.select("file", F.col("tag").cast("bigint").alias("tag"), F.array_join("texts", ",").alias("texts"))


@query(
    "c19_typed_first_field",
    """SELECT event_id AS file, CASE WHEN event_id % 2 = 0 THEN 4000 + event_id % 10 ELSE 3000 END AS width,
      CASE WHEN event_id % 3 = 0 THEN (event_id % 360)::DOUBLE ELSE 12.5 END AS direction FROM events""",
)
def c19(spark, sf_dir):
    t, v = F.col("tags"), G.TOOL_TAGS
    width = G.first_field(t, v.width, "bigint")
    return tool_tags(spark, sf_dir).select(
        "file", width.alias("width"), G.first_field(t, v.direction, "double").alias("direction")
    )


@query(
    "c20_capture_time_preference",
    f"""SELECT event_id AS file, CASE WHEN event_id % 8 = 0 THEN {SEC}::DOUBLE
        WHEN event_id % 4 <> 3 THEN {SEC} - CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 0 END + (event_id % 100) / 1e3
        WHEN event_id % 8 = 3 THEN {US} / 1e6 END AS time FROM events""",
)
def c20(spark, sf_dir):
    return tool_tags(spark, sf_dir).select("file", G.capture_time(F.col("tags"), G.TOOL_TAGS).alias("time"))


@query(
    "c21_lon_lat_with_refs",
    """SELECT event_id AS file, CASE WHEN event_id % 3 = 0 THEN ((event_id % 180) + 0.25e0) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END
        WHEN event_id % 5 <> 0 THEN (event_id % 180) - 0.75e0 END AS lon,
      CASE WHEN event_id % 3 = 0 THEN ((event_id % 90) + 0.125e0) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END
        WHEN event_id % 5 <> 0 THEN (event_id % 90) - 0.5e0 END AS lat FROM events""",
)
def c21(spark, sf_dir):
    place = G.lon_lat(F.col("tags"), G.TOOL_TAGS)
    return tool_tags(spark, sf_dir).select("file", place.alias("p")).select("file", "p.lon", "p.lat")


@query(
    "c22_signed_altitude",
    """SELECT event_id AS file, CASE WHEN event_id % 6 <> 0 THEN ((event_id % 100) + 0.5e0) * CASE WHEN event_id % 3 = 1 THEN -1 ELSE 1 END END AS alt FROM events""",
)
def c22(spark, sf_dir):
    return tool_tags(spark, sf_dir).select("file", G.altitude(F.col("tags"), G.TOOL_TAGS).alias("alt"))


@query(
    "c23_device_and_size",
    """SELECT event_id AS file, CASE event_id % 4 WHEN 0 THEN 'Make' || (event_id % 7) WHEN 1 THEN 'Lens' END AS make,
      CASE WHEN event_id % 3 <> 0 THEN 'M' || (event_id % 5) END AS model, CASE WHEN event_id % 5 <> 0 THEN 2000 + event_id % 10 END AS height,
      CASE WHEN event_id % 11 BETWEEN 1 AND 8 THEN event_id % 11 ELSE 1 END AS orientation FROM events""",
)
def c23(spark, sf_dir):
    return tool_properties(spark, sf_dir).select("file", "make", "model", "height", "orientation")


@query(
    "c25_camera_id",
    """SELECT event_id AS file, CASE WHEN event_id % 3 = 0 THEN 'A' || event_id || CASE WHEN event_id % 2 = 0 THEN '_L1' ELSE '' END
      WHEN event_id % 2 = 0 THEN 'L1' END AS camera_uuid FROM events""",
)
def c25(spark, sf_dir):
    return tool_tags(spark, sf_dir).select("file", G.camera_id(F.col("tags"), G.TOOL_TAGS).alias("camera_uuid"))


@query(
    "c11_capture_record_assembly",
    f"""SELECT event_id AS file, CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN 'GeoTaggingError'
      WHEN event_id % 8 = 7 THEN 'GeoTaggingError' END AS error_type,
      CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN 'no position in the tags'
      WHEN event_id % 8 = 7 THEN 'no capture time in the tags' END AS message FROM events""",
)
def c11(spark, sf_dir):
    df = G.assemble_captures(tool_tags(spark, sf_dir), G.properties(F.col("tags"), G.TOOL_TAGS))
    return df.select("file", F.col("error.type").alias("error_type"), "error.message")


@query(
    "c24_primary_secondary_merge",
    f"""SELECT event_id AS file,
      CASE WHEN event_id % 3 = 0 THEN round(-((event_id % 180) + 30 / 60e0 + (event_id % 60) / 3600e0), 9) ELSE round((event_id % 180) + 0.25e0, 9) END AS lon,
      CASE WHEN event_id % 3 = 0 THEN round((event_id % 90) + 15 / 60e0, 9) ELSE round((event_id % 90) + (event_id % 60 + 0.5e0) / 60, 9) END AS lat,
      CASE WHEN event_id % 4 = 0 THEN {SEC}::DOUBLE WHEN event_id % 4 = 1 THEN {US} / 1e6 END AS time,
      CASE WHEN event_id % 2 = 0 THEN 'Primary' ELSE 'Packet' END AS make,
      CASE WHEN event_id % 2 = 0 THEN -((event_id % 100) / 10e0) ELSE 7.5 END AS alt,
      CASE WHEN event_id % 5 = 0 THEN (event_id % 9) / 2e0 END AS angle FROM events""",
)
def c24(spark, sf_dir):
    eid = F.col("event_id")
    df = events(spark, sf_dir)
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    colon_day = F.regexp_replace("t_day", "-", ":")
    hms = text(F.col("t_h"), "/1, ", F.col("t_m"), "/1, ", F.col("t_s"), "/1")
    first = [
        ("GPS GPSLongitude", F.when(eid % 3 == 0, text(eid % 180, "/1, 30/1, ", eid % 60, "/1"))),
        ("GPS GPSLongitudeRef", F.lit("W")),
        ("GPS GPSLatitude", F.when(eid % 3 != 1, text(eid % 90, "/1, 15/1, 0/1"))),
        ("GPS GPSDate", F.when(eid % 4 == 0, colon_day)),
        ("GPS GPSTimeStamp", F.when(eid % 4 == 0, hms)),
        ("Image Make", F.when(eid % 2 == 0, F.lit("Primary "))),
        ("GPS GPSAltitude", F.when(eid % 2 == 0, text(eid % 100, "/10"))),
        ("GPS GPSAltitudeRef", F.lit("1")),
        ("GPS GPSImgDirection", F.when(eid % 5 == 0, text(eid % 9, "/2"))),
    ]
    second = [
        ("exif:GPSLongitude", text(eid % 180, ".25")),
        ("exif:GPSLongitudeRef", F.lit("E")),
        ("exif:GPSLatitude", text(eid % 90, ",", eid % 60, ".5N")),
        ("exif:GPSTimeStamp", F.when(eid % 4 < 2, F.concat("t_day", F.lit("T"), clock(), F.lit("Z")))),
        ("tiff:Make", F.lit("Packet")),
        ("exif:GPSAltitude", F.lit("7.5")),
        ("exif:GPSImgDirection", F.lit("99")),
    ]
    primary = G.collect_tags(tag_rows(df, first), ["file"])
    secondary = G.collect_tags(tag_rows(df, second), ["file"]).withColumnRenamed("tags", "packet")
    both = primary.join(secondary, "file", "full")
    out = both.select("file", *[c.alias(n) for n, c in G.merged_properties(F.col("tags"), F.col("packet")).items()])
    return out.select("file", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "time", "make", "alt", "angle")


@query(
    "c26_video_make_model",
    """SELECT event_id AS file, CASE event_id % 4 WHEN 0 THEN 'GoPro' WHEN 1 THEN 'Insta' WHEN 2 THEN 'Keys' END AS make,
      CASE event_id % 4 WHEN 0 THEN 'HERO' || (event_id % 12) WHEN 1 THEN 'X' || (event_id % 5) WHEN 2 THEN 'K' END AS model FROM events""",
)
def c26(spark, sf_dir):
    eid = F.col("event_id")
    i = eid % 4
    pairs = [
        ("GoPro:Model", F.when(i == 0, F.concat(F.lit("HERO"), (eid % 12).cast("string"), F.lit(" ")))),
        ("Insta360:Make", F.when(i == 1, F.lit("Insta"))),
        ("Insta360:Model", F.when(i == 1, F.concat(F.lit("X"), (eid % 5).cast("string")))),
        ("Keys:Make", F.when(i == 2, F.lit("Keys"))),
        ("Keys:Model", F.when(i == 2, F.lit("K"))),
        ("Other:Tag", F.lit("x")),
    ]
    df = G.collect_tags(tag_rows(events(spark, sf_dir), pairs), ["file"])
    return df.select("file", G.video_make_model(F.col("tags")).alias("d")).select("file", "d.make", "d.model")


@query(
    "c27_model_from_copyright",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'DR' || (event_id % 900) || ' Plus' WHEN 1 THEN 'DR' || (event_id % 900) || 'S' ELSE '' END AS model FROM events""",
)
def c27(spark, sf_dir):
    eid = F.col("event_id")
    n = (eid % 900).cast("string")
    text = (
        F.when(eid % 3 == 0, F.concat(F.lit(' {"model":"DR'), n, F.lit(' Plus","ver":0.918} ')))
        .when(eid % 3 == 1, F.concat(F.lit(" Maker Co., Ltd.;DR"), n, F.lit("S;1.008;English;")))
        .otherwise(F.lit("nothing here"))
    )
    return events(spark, sf_dir).select("event_id", G.model_from_copyright(text).alias("model"))
