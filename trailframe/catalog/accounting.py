"""Record finishing, summaries and upload bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, table
from trailframe.functions import records as R
from trailframe.operators import accounting as B
from trailframe.runtime import scratch_path
from trailframe.sources.cache import CacheStore


STATS = """st AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'image' WHEN l_linenumber % 3 = 1 THEN 'camm' END AS file_type,
    CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 50 END AS sequence_image_count, (l_extendedprice * 100)::BIGINT AS entity_size,
    CASE WHEN l_suppkey % 2 = 0 THEN l_partkey END AS upload_first_offset, l_quantity AS upload_total_time FROM lineitem)"""


def stats(spark, sf_dir):
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.when(line % 3 == 0, "image").when(line % 3 == 1, "camm").alias("file_type"),
        F.when(line % 3 == 0, F.col("l_partkey") % 50).alias("sequence_image_count"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("entity_size"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).alias("upload_first_offset"),
        F.col("l_quantity").alias("upload_total_time"),
    )


@query(
    "a9_upload_summary",
    f"""WITH {STATS} SELECT sum(coalesce(sequence_image_count, 0))::BIGINT AS images, count(*) AS sequences, round(sum(entity_size) / 1048576e0, 4) AS size,
      round(sum(entity_size - coalesce(upload_first_offset, 0)) / 1048576e0, 4) AS uploaded_size,
      round(sum(entity_size - coalesce(upload_first_offset, 0)) / 1048576e0 / sum(upload_total_time), 4) AS speed, round(sum(upload_total_time), 4) AS time FROM st""",
)
def a9(spark, sf_dir):
    return B.upload_summary(stats(spark, sf_dir))


@query(
    "a10_upload_counts",
    f"""WITH {STATS} SELECT 'uploaded' AS what, coalesce(file_type, 'unknown') AS name, count(*) AS n FROM st GROUP BY ALL
      UNION ALL SELECT 'failed', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""",
)
def a10(spark, sf_dir):
    failed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("error_type"))
    return B.upload_counts(stats(spark, sf_dir), failed)


UPLOADS = f"""{CAP}, ue AS (SELECT track_id, ord, time AS tm, CASE WHEN row_number() OVER w = 1 AND track_id % 4 <> 0 THEN 'upload_start'
    WHEN row_number() OVER r = 1 THEN 'upload_end' WHEN ord % 3 = 0 THEN 'upload_fetch_offset' WHEN ord % 3 = 1 THEN 'upload_progress' ELSE 'upload_retrying' END AS event,
    ord % 1000 + 5 AS "offset" FROM cap WINDOW w AS (PARTITION BY track_id ORDER BY time, ord), r AS (PARTITION BY track_id ORDER BY time DESC, ord DESC))"""


@query(
    "a11_upload_timing",
    f"""WITH {UPLOADS}, l AS (SELECT *, last_value(CASE WHEN event IN ('upload_start', 'upload_fetch_offset', 'upload_retrying') THEN struct_pack(o := event <> 'upload_retrying', t := tm) END IGNORE NULLS)
        OVER (PARTITION BY track_id ORDER BY tm, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ue)
      SELECT track_id, round(coalesce(sum(CASE WHEN event IN ('upload_retrying', 'upload_end') AND p.o THEN tm - p.t END), 0), 3) AS upload_total_time,
        CASE WHEN bool_or(event = 'upload_start') THEN 0 ELSE min(CASE WHEN event = 'upload_fetch_offset' THEN "offset" END) END AS upload_first_offset FROM l GROUP BY track_id""",
)
def a11(spark, sf_dir):
    o = F.col("ord")
    from trailframe.operators import ordered as O

    cap = captures(spark, sf_dir).select("track_id", "ord", "time")
    rows = O.Ordered.of(cap, ["track_id"], ["time", "ord"]).scan(_i=O.index(), _n=O.group_total(F.lit(1))).rows()
    event = (
        F.when((F.col("_i") == 1) & (F.col("track_id") % 4 != 0), "upload_start")
        .when(F.col("_i") == F.col("_n"), "upload_end")
        .when(o % 3 == 0, "upload_fetch_offset").when(o % 3 == 1, "upload_progress").otherwise("upload_retrying")
    )
    events = rows.select("track_id", "ord", F.col("time").alias("at"), event.alias("event"), (o % 1000 + 5).alias("offset"))
    out = B.upload_timing(events, "track_id")
    return out.withColumn("upload_total_time", F.round("upload_total_time", 3))


@query(
    "a2_group_dedup_sort",
    f"""WITH {CAP}, d AS (SELECT coalesce((track_id % 40)::VARCHAR, 'none') AS seq, ord % 500 AS file, max(ord) AS ord FROM cap GROUP BY ALL)
      SELECT seq, file, ord, row_number() OVER (PARTITION BY seq ORDER BY time, file) AS position FROM d JOIN (SELECT ord, time FROM cap) USING (ord)""",
)
def a2(spark, sf_dir):
    o = F.col("ord")
    from trailframe.operators import ordered as O

    df = captures(spark, sf_dir).select(
        (F.col("track_id") % 40).cast("string").alias("seq"), (o % 500).alias("filename"), "ord", "time"
    )
    last = B.latest_per_file(df, ["seq"], "ord")
    ranked = O.Ordered.of(last, ["seq"], ["time", "filename"]).scan(position=O.index())
    return ranked.rows().select("seq", F.col("filename").alias("file"), "ord", "position")


@query("a12_sequence_fingerprint",
    f"WITH {CAP} SELECT track_id, md5(string_agg(md5sum, '' ORDER BY time, basename)) AS sequence_md5sum FROM cap GROUP BY track_id")
def a12(spark, sf_dir):
    return B.fingerprints(captures(spark, sf_dir), "track_id", ["time", "basename"])


@query("a13_payload_size", f"WITH {CAP} SELECT track_id, count(*) AS sequence_image_count, sum(coalesce(filesize, 0))::BIGINT AS entity_size FROM cap GROUP BY track_id")
def a13(spark, sf_dir):
    return B.payloads(captures(spark, sf_dir), "track_id")


@query(
    "a14_handle_manifest",
    f"""WITH {CAP} SELECT track_id, '{{"image_handles":["' || string_agg('h' || ord, '","' ORDER BY time, basename) || '"],"upload_type":"images","version":"1"}}' AS manifest
      FROM cap GROUP BY track_id""",
)
def a14(spark, sf_dir):
    o = F.col("ord")
    df = captures(spark, sf_dir).withColumn("handle", F.concat(F.lit("h"), o.cast("string")))
    return B.manifests(df, "track_id", ["time", "basename"]).select("track_id", "manifest")


@query("a14_manifest_rows",
    f"WITH {CAP} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY time, basename) - 1 AS position, 'h' || ord AS handle FROM cap")
def a14_rows(spark, sf_dir):
    o = F.col("ord")
    df = captures(spark, sf_dir).withColumn("handle", F.concat(F.lit("h"), o.cast("string")))
    return B.manifest_rows(df, "track_id", ["time", "basename"])


SUMMARY = f"""{CAP}, r AS (SELECT CASE ord % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'gopro' ELSE 'image' END AS filetype,
    CASE WHEN ord % 10 = 3 THEN 'DuplicationError' WHEN ord % 10 = 7 THEN 'ZigZagError' ELSE 'ok' END AS error_type, coalesce(filesize, 0) AS b FROM cap)"""


def summarised(spark, sf_dir):
    o = F.col("ord")
    err = F.when(o % 10 == 3, R.error(R.DUPLICATION, "x")).when(o % 10 == 7, R.error(R.ZIGZAG, "x"))
    kind = F.when(o % 4 == 0, "video").when(o % 4 == 1, "gopro").otherwise("image")
    return captures(spark, sf_dir).select(kind.alias("filetype"), "filesize", err.alias("error"))


@query(
    "a7_process_summary",
    f"WITH {SUMMARY} SELECT filetype, count(*) AS n, count(*) FILTER (error_type = 'ok') AS n_good, sum(b)::BIGINT AS bytes FROM r GROUP BY filetype",
)
def a7(spark, sf_dir):
    return B.process_summary(summarised(spark, sf_dir)).filter("level = 1").drop("level", "error_type")


@query("a8_error_summary", f"WITH {SUMMARY} SELECT filetype, error_type, count(*) AS n, sum(b)::BIGINT AS bytes FROM r WHERE error_type <> 'ok' GROUP BY ALL")
def a8(spark, sf_dir):
    out = B.process_summary(summarised(spark, sf_dir)).filter("level = 0 AND error_type <> 'ok'")
    return out.drop("level", "n_good")


@query("f11_error_skip_policy", f"WITH {SUMMARY} SELECT count(*) AS critical FROM r WHERE error_type = 'ZigZagError'")
def f11(spark, sf_dir):
    return B.critical_errors(summarised(spark, sf_dir)).agg(F.count(F.lit(1)).alias("critical"))


def flawed(spark, sf_dir):
    """Captures with a few broken records."""
    o = F.col("ord")
    cap = captures(spark, sf_dir)
    seq = F.when(o % 29 == 5, "!!").otherwise(F.concat(F.lit("s"), F.col("track_id").cast("string")))
    return cap.withColumns(
        {
            "lat": F.when(o % 17 == 3, 91.5).when(o % 17 == 4, F.lit(None)).otherwise(F.col("lat")),
            "lon": F.when(o % 19 == 6, -180.5).otherwise(F.col("lon")),
            "sequence_id": seq,
            "error": F.when(o % 23 == 1, R.error(R.ZIGZAG, "x")),
        }
    )


@query(
    "f9_record_validation",
    """SELECT event_id AS ord, CASE WHEN event_id % 23 = 1 THEN 'ZigZagError' WHEN event_id % 17 IN (3, 4) OR event_id % 19 = 6 OR event_id % 29 = 5 OR event_id % 7 = 2 THEN 'MetadataValidationError' END AS error_type,
      CASE WHEN event_id % 23 = 1 THEN 'x' WHEN event_id % 17 = 4 THEN '''MAPLatitude'' is a required property' WHEN event_id % 17 = 3 THEN 'MAPLatitude is greater than the maximum of 90'
        WHEN event_id % 19 = 6 THEN 'MAPLongitude is less than the minimum of -180' WHEN event_id % 29 = 5 THEN 'MAPSequenceUUID does not match its pattern'
        WHEN event_id % 7 = 2 THEN 'No such file /cap/' || user_id || '/' || lpad(event_id::VARCHAR, 9, '0') || '.jpg' END AS message FROM events""",
)
def f9(spark, sf_dir):
    o = F.col("ord")
    files = captures(spark, sf_dir).filter(o % 7 != 2).select(F.col("filename").alias("path"))
    out = B.require_files(B.validate(flawed(spark, sf_dir)), files)
    return out.select("ord", F.col("error.type").alias("error_type"), "error.message")


@query("f15_fill_sequence_id", "SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 'run-1' ELSE user_id::VARCHAR END AS sequence_id FROM events")
def f15(spark, sf_dir):
    o = F.col("ord")
    df = captures(spark, sf_dir).select("ord", F.when(o % 3 != 0, F.col("track_id")).alias("sequence_id"))
    return B.fill_sequence_id(df, "run-1")


@query("f17_device_override", "SELECT event_id AS ord, 'Override' AS make, 'Model' || (user_id % 4) AS model, lpad(event_id::VARCHAR, 9, '0') || '.jpg' AS basename FROM events")
def f17(spark, sf_dir):
    return B.override_device(captures(spark, sf_dir), make="Override").select("ord", "make", "model", "basename")


@query("f18_time_and_heading_offset",
    f"WITH {CAP} SELECT ord, round(time + 1.5e0, 6) AS time, (coalesce(angle, 0) - 90 + 360) % 360 AS angle FROM cap")
def f18(spark, sf_dir):
    out = B.apply_offsets(captures(spark, sf_dir), 1.5, -90.0)
    return out.select("ord", F.round("time", 6).alias("time"), "angle")


# History: every third customer was uploaded; a customer's order keys stand for its sequences.
@query(
    "j8_already_uploaded",
    "SELECT o_orderkey FROM orders WHERE md5(o_custkey::VARCHAR) NOT IN (SELECT md5(c_custkey::VARCHAR) FROM customer WHERE c_custkey % 3 = 0)",
)
def j8(spark, sf_dir):
    digest = lambda c: F.md5(F.col(c).cast("string").cast("binary")).alias("sequence_md5sum")
    sequences = table(spark, sf_dir, "orders").select("o_orderkey", digest("o_custkey"))
    history = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(digest("c_custkey"))
    return B.not_uploaded(sequences, history).select("o_orderkey")


CACHE = "ca AS (SELECT c_custkey::VARCHAR AS key, 'v' || c_custkey AS value, CASE WHEN c_custkey % 5 <> 0 THEN 1000e0 + c_custkey END AS expires_at FROM customer)"


def cache(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.cast("string").alias("key"), F.concat(F.lit("v"), c.cast("string")).alias("value"),
        F.when(c % 5 != 0, 1000.0 + c).alias("expires_at"),
    )


@query("j7_cache_lookup",
    f"WITH {CACHE} SELECT o_orderkey, value FROM orders LEFT JOIN ca ON key = o_custkey::VARCHAR AND NOT coalesce(expires_at <= 1700, false)")
def j7(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    return B.cache_get(wanted, cache(spark, sf_dir), 1700.0).select("o_orderkey", "value")


@query(
    "s13_cache_set_and_clear",
    f"""WITH {CACHE}, w AS (SELECT (o_custkey + 100)::VARCHAR AS key, 'n' || max(o_orderkey) AS value, 1700e0 + 172800 AS expires_at FROM orders GROUP BY o_custkey),
      m AS (SELECT * FROM w UNION ALL SELECT * FROM ca WHERE key NOT IN (SELECT key FROM w))
      SELECT key, value, expires_at FROM m WHERE NOT coalesce(expires_at <= 1700, false)""",
)
def s13(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 100).cast("string").alias("key"), F.concat(F.lit("n"), k.cast("string")).alias("value"), k.alias("ord")
    )
    store = CacheStore(spark, scratch_path(spark, "cache"))
    store.append(cache(spark, sf_dir).withColumn("seq", F.lit(0)), now=0.0, ttl=None)
    # Two writers' batches, then the store is tidied: what counts is each key's last write.
    for half in (0, 1):
        store.append(entries.filter(k % 2 == half).select("key", "value", F.col("ord").alias("seq")), now=1700.0)
    store.compact(1700.0, keep_days=0)
    return store.entries()


@query(
    "s14_history_append",
    f"""WITH {CAP} SELECT md5(track_id::VARCHAR) AS sequence_md5sum, row_number() OVER (PARTITION BY track_id ORDER BY time, basename) AS position, filename FROM cap WHERE track_id % 2 = 0""",
)
def s14(spark, sf_dir):
    cap = captures(spark, sf_dir).withColumn("sequence_id", F.col("track_id"))
    t = F.col("track_id")
    done = cap.groupBy("track_id").agg(F.sum("filesize").alias("entity_size")).select(
        t.alias("sequence_id"), F.md5(t.cast("string").cast("binary")).alias("sequence_md5sum"), (t % 2 == 0).alias("finished"),
        F.lit("image").alias("file_type"), "entity_size", F.lit(1.5).alias("upload_total_time"),
    )
    out = B.history_records(done, cap, {"version": "1"}, ["time", "basename"])
    return out.select("sequence_md5sum", "position", F.get_json_object("desc", "$.filename").alias("filename"))
