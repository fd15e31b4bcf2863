"""The three end-to-end flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, table
from trailframe.catalog.sequences import CLEAN_SQL, LIMITS, flagship_input
from trailframe.catalog.tracks import BRACKET, _downsample_sql, log_points, photos, W
from trailframe.functions import records as R
from trailframe.plans import process, upload, video


@query(
    "q1_process_media_summary",
    f"""WITH RECURSIVE {CLEAN_SQL}
      SELECT CASE WHEN issue IS NULL THEN 'ok' ELSE issue END AS error_type, count(*) AS n FROM i2 GROUP BY ALL""",
)
def q1(spark, sf_dir):
    """Captures through cascade, cleaning and validation, counted per outcome."""
    df = flagship_input(spark, sf_dir)
    located = df.withColumn("error", R.no_error()).drop("folder", "basename", "kind")
    unplaced = R.error(R.GEOTAGGING, "no position here")
    first = located.withColumn("error", F.when(F.col("ord") % 3 == 0, unplaced))
    found = process.located_captures([first, located])
    out = process.process_images(found.drop("source_no"), LIMITS, make="Override", offset_angle=0.0)
    return out.groupBy(F.coalesce("error.type", F.lit("ok")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def _q2_sql() -> str:
    fold = _downsample_sql("g", "track_id", "frame_idx", 600.0)
    fold = fold.replace(" f AS", " ff AS").replace("FROM f JOIN", "FROM ff JOIN").replace("f.", "ff.").replace("fff.", "ff.")
    return f"""WITH RECURSIVE {BRACKET}, ix AS (SELECT ord, row_number() OVER {W} - 1 AS frame_idx FROM c),
      g AS (SELECT f.track_id, frame_idx, f.time, slat + (elat - slat) * w AS lat, slon + (elon - slon) * w AS lon,
          CASE WHEN s.epoch_time > 0 AND e.epoch_time > 0 THEN s.epoch_time + (e.epoch_time - s.epoch_time) * w END AS epoch
        FROM f JOIN ix USING (ord) JOIN bounds b ON b.track_id = f.track_id WHERE f.time >= b.t0 - 0.001e0 AND f.time <= b.t1 + 0.001e0),
      {fold}
      SELECT r.track_id, frame_idx, round(coalesce(CASE WHEN epoch > 0 THEN epoch END, 500e0 - 20 + r.time), 3) AS capture_time
      FROM r JOIN ff USING (track_id, rn) WHERE keep"""


@query("q2_video_frames_by_distance", _q2_sql())
def q2(spark, sf_dir):
    frames = photos(spark, sf_dir).select("track_id", F.col("ord").alias("frame_no"), F.col("time").alias("cts"))
    streams = captures(spark, sf_dir).select("track_id").distinct().select(
        "track_id", F.lit(0).alias("stream_no"), F.lit("video").alias("codec_type"), F.lit(1920).alias("width"),
        F.lit(1080).alias("height"), F.lit(500.0).alias("creation_time"), F.lit(20.0).alias("duration"),
    )
    out = video.frames_by_distance(frames, log_points(spark, sf_dir), streams, "track_id", 600.0)
    return out.select("track_id", "frame_idx", F.round("capture_time", 3).alias("capture_time"))


@query(
    "q3_upload_plan",
    f"""WITH {CAP}, r AS (SELECT *, CASE WHEN track_id % 9 = 0 THEN 'run' ELSE track_id::VARCHAR END AS sequence_id FROM cap WHERE ord % 6 <> 1 AND ord % 5 <> 2),
      s AS (SELECT sequence_id, md5(string_agg(md5sum, '' ORDER BY time, basename)) AS sequence_md5sum, count(*) AS sequence_image_count, sum(coalesce(filesize, 0)) AS entity_size,
        count(*) FILTER (ord % 4 = 0) AS n_cached, min(track_id) AS t FROM r GROUP BY sequence_id)
      SELECT sequence_id, sequence_md5sum, sequence_image_count, entity_size::BIGINT AS entity_size, n_cached FROM s WHERE t % 2 = 1 OR sequence_id = 'run'""",
)
def q3(spark, sf_dir):
    """Sequences to upload with how many of their handles are cached."""
    o, t = F.col("ord"), F.col("track_id")
    cap = captures(spark, sf_dir).withColumns(
        {"sequence_id": F.when(t % 9 != 0, t), "error": F.when(o % 6 == 1, R.error(R.ZIGZAG, "x"))}
    )
    files = cap.filter(o % 5 != 2).select(F.col("filename").alias("path"))
    # Earlier uploads: every even user's sequence as it is now.
    from trailframe.operators import accounting as B

    earlier = cap.filter((t % 2 == 0) & (t % 9 != 0) & (o % 6 != 1) & (o % 5 != 2))
    history = B.fingerprints(earlier, "track_id", ["time", "basename"]).select("sequence_md5sum")
    cache = cap.filter(o % 4 == 0).select(
        F.concat("md5sum", F.lit(".jpg")).alias("key"), F.lit("h").alias("value"), F.lit(9e9).alias("expires_at")
    )
    plan = upload.plan_upload(cap.drop("kind"), files, history, cache, now=1700.0)
    cached = plan.images.groupBy("sequence_id").agg(F.count("value").alias("n_cached"))
    return plan.sequences.drop("already").join(cached, "sequence_id")
