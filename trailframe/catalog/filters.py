"""GPS noise filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.catalog.base import CAP, captures, query, sql_dist, sql_x, sql_y, sql_z, table
from trailframe.operators import filters as N
from trailframe.operators import sequences as S
from trailframe.operators.native import native_tracks
from trailframe.operators.ordered import Ordered

W = "(PARTITION BY track_id ORDER BY time, ord)"
GPS = f"""{CAP}, gps AS (SELECT track_id, ord, time, lat, lon, CASE WHEN ord % 9 = 0 THEN NULL ELSE [0, 2, 3][1 + ord % 3] END AS fix,
    CASE WHEN ord % 8 <> 0 THEN (ord * 7 % 1200)::DOUBLE END AS precision,
    CASE WHEN track_id % 29 <> 5 THEN 0.01e0 + (ord % 10) * 0.001e0 END AS ground_speed FROM cap)"""


def gps_points(spark, sf_dir):
    o = F.col("ord")
    fix = F.when(o % 9 != 0, F.when(o % 3 == 0, 0).when(o % 3 == 1, 2).otherwise(3))
    return captures(spark, sf_dir).select(
        "track_id", "ord", "time", "lat", "lon",
        fix.alias("fix"),
        F.when(o % 8 != 0, (o * 7 % 1200).cast("double")).alias("precision"),
        F.when(F.col("track_id") % 29 != 5, 0.01 + (o % 10) * 0.001).alias("ground_speed"),
    )


@query("f6_gps_fix_filter", f"WITH {GPS} SELECT ord FROM gps WHERE fix IS NULL OR fix IN (2, 3)")
def f6(spark, sf_dir):
    return gps_points(spark, sf_dir).filter(N.trusted_fix(F.col("fix"))).select("ord")


@query("f7_precision_filter", f"WITH {GPS} SELECT ord FROM gps WHERE precision IS NULL OR precision <= 1000")
def f7(spark, sf_dir):
    return gps_points(spark, sf_dir).filter(N.precise_enough(F.col("precision"))).select("ord")


# Exact quartiles of the halves without the median, by list slicing.
HALVES = """SELECT {k}, hi3 + (hi3 - lo1) * 1.5e0 AS whisker FROM (
  SELECT {k}, list_median(v[1:n // 2]) AS lo1, list_median(v[n - n // 2 + 1:n]) AS hi3
  FROM (SELECT {k}, list({v} ORDER BY {v}) AS v, count(*) AS n FROM {src} WHERE {v} IS NOT NULL GROUP BY {k} HAVING count(*) >= 2))"""


def halves(k, v, src):
    return HALVES.format(k=k, v=v, src=src).replace("list_median(", "list_aggregate(").replace(
        "//", "//").replace("[1:n // 2])", "[1:n // 2], 'median')").replace("+ 1:n])", "+ 1:n], 'median')")


@query("a15_upper_whisker",
    f"""WITH {CAP} SELECT track_id, round(whisker, 6) AS whisker FROM ({halves('track_id', 'alt', 'cap')})""")
def a15(spark, sf_dir):
    out = N.upper_whiskers(captures(spark, sf_dir), ["track_id"], "alt", "ord")
    return out.filter("whisker IS NOT NULL").select("track_id", F.round("whisker", 6).alias("whisker"))


@query("a15_upper_whisker_of_prices",
    f"""SELECT l_suppkey, round(whisker, 6) AS whisker FROM ({halves('l_suppkey', 'l_extendedprice', 'lineitem')})""")
def a15_prices(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("tie", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    out = N.upper_whiskers(lines, ["l_suppkey"], "l_extendedprice", "tie")
    return out.filter("whisker IS NOT NULL").select("l_suppkey", F.round("whisker", 6).alias("whisker"))


@query(
    "a18_majority_cluster",
    f"""WITH {CAP}, n AS (SELECT track_id, ord % 4 AS cluster, count(*) AS n FROM cap GROUP BY ALL)
      SELECT track_id, arg_max(cluster, (n, -cluster)) AS cluster FROM n GROUP BY track_id""",
)
def a18(spark, sf_dir):
    rows = captures(spark, sf_dir).select("track_id", (F.col("ord") % 4).alias("cluster"), F.lit(1).alias("n"))
    return N.majority_cluster(rows, ["track_id"])


def _outlier_sql(source: str) -> str:
    """Runs, their reachable successors, and the greedy merge as a recursive fold."""
    step = sql_dist("plat", "plon", "lat", "lon")
    reach = "sqrt((a.x1-b.x0)*(a.x1-b.x0)+(a.y1-b.y0)*(a.y1-b.y0)+(a.z1-b.z0)*(a.z1-b.z0)) / nullif(abs(b.t0 - a.t1), 0)"
    return f"""st AS (SELECT *, {step} AS step FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM {source} WINDOW w AS {W})),
      dw AS ({halves('track_id', 'step', 'st')}), sw AS ({halves('track_id', 'ground_speed', source)}),
      lim AS (SELECT track_id, greatest(30, dw.whisker) AS md, sw.whisker AS ms FROM dw JOIN sw USING (track_id)),
      rn AS (SELECT st.*, ms, (sum(CASE WHEN step IS NULL OR step > md THEN 1 ELSE 0 END) OVER {W})::BIGINT AS run FROM st JOIN lim USING (track_id)),
      runs AS (SELECT track_id, run, any_value(ms) AS ms, count(*) AS n, min(time) AS t0, max(time) AS t1,
        arg_min(lat, (time, ord)) AS la0, arg_min(lon, (time, ord)) AS lo0, arg_max(lat, (time, ord)) AS la1, arg_max(lon, (time, ord)) AS lo1
        FROM rn GROUP BY track_id, run),
      rx AS (SELECT *, {sql_x('la0', 'lo0')} AS x0, {sql_y('la0', 'lo0')} AS y0, {sql_z('la0')} AS z0,
        {sql_x('la1', 'lo1')} AS x1, {sql_y('la1', 'lo1')} AS y1, {sql_z('la1')} AS z1 FROM runs),
      ra AS (SELECT a.track_id, a.run, list(b.run ORDER BY b.run) FILTER (b.run IS NOT NULL) AS rights
        FROM rx a LEFT JOIN rx b ON a.track_id = b.track_id AND b.run > a.run AND {reach} <= a.ms GROUP BY a.track_id, a.run),
      m AS (SELECT track_id, 0::BIGINT AS run, list_transform(range(max(run)::BIGINT), lambda x: 0::BIGINT) AS cl FROM runs GROUP BY track_id
        UNION ALL SELECT track_id, run, CASE WHEN pick IS NULL THEN c1 ELSE list_transform(c1, lambda x, i: CASE WHEN i = pick THEN c1[run] ELSE x END) END
        FROM (SELECT *, list_filter(coalesce(rights, []), lambda r: c1[r] = 0)[1] AS pick
          FROM (SELECT ra.track_id, ra.run::BIGINT AS run, ra.rights, list_transform(m.cl, lambda x, i: CASE WHEN i = ra.run AND x = 0 THEN i ELSE x END) AS c1
            FROM m JOIN ra ON ra.track_id = m.track_id AND ra.run = m.run + 1))),
      cl AS (SELECT track_id, unnest(cl) AS cluster, unnest(range(1, len(cl) + 1)) AS run FROM m QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY m.run DESC) = 1),
      sz AS (SELECT track_id, cluster, sum(n) AS n FROM cl JOIN runs USING (track_id, run) GROUP BY ALL),
      best AS (SELECT track_id, arg_max(cluster, (n, -cluster)) AS best FROM sz GROUP BY track_id),
      fl AS (SELECT rn.ord, cl.cluster <> best.best AS outlier FROM rn JOIN cl USING (track_id, run) JOIN best USING (track_id))"""


@query(
    "w18_density_merge_of_runs",
    f"""WITH RECURSIVE {GPS}, {_outlier_sql('gps')} SELECT track_id, run::BIGINT AS run, cluster FROM cl""",
)
def w18(spark, sf_dir):
    """Clusters of the runs that long steps cut each track into."""
    points = gps_points(spark, sf_dir)
    order = ["time", "ord"]
    stepped = S.with_step_distance(Ordered.of(points, ["track_id"], order), "_step")
    reach = N.upper_whiskers(stepped.rows().select("track_id", "_step", "ord"), ["track_id"], "_step", "ord")
    pace = N.upper_whiskers(points, ["track_id"], "ground_speed", "ord").withColumnRenamed("whisker", "max_speed")
    limits = reach.join(pace, "track_id").filter("whisker IS NOT NULL AND max_speed IS NOT NULL")
    joined = stepped.with_df(stepped.df.join(limits, "track_id"))
    split = S.number_runs(joined, F.col("_step") > F.greatest(F.lit(30.0), F.col("whisker")))
    runs = N.run_table(split.rows(), ["track_id", "max_speed"], order)
    return N.merge_runs(runs, "track_id").drop("n")


@query(
    "w19_outlier_removal",
    f"""WITH RECURSIVE {GPS}, {_outlier_sql('gps')} SELECT gps.ord, coalesce(outlier, false) AS outlier FROM gps LEFT JOIN fl USING (ord)""",
)
def w19(spark, sf_dir):
    out = N.mark_outliers(gps_points(spark, sf_dir), "track_id", ["time", "ord"])
    return out.select("ord", "outlier")


@query(
    "w20_noise_removal",
    f"""WITH RECURSIVE {GPS}, good AS (SELECT * FROM gps WHERE (fix IS NULL OR fix IN (2, 3)) AND (precision IS NULL OR precision <= 1000)),
      {_outlier_sql('good')} SELECT good.ord FROM good LEFT JOIN fl USING (ord) WHERE NOT coalesce(outlier, false)""",
)
def w20(spark, sf_dir):
    return N.remove_noisy_points(gps_points(spark, sf_dir), "track_id", ["time", "ord"]).select("ord")


@query(
    "c39_video_classification",
    f"""WITH RECURSIVE {GPS}, good AS (SELECT * FROM gps WHERE track_id % 2 = 0 AND track_id % 6 <> 0 AND (fix IS NULL OR fix IN (2, 3)) AND (precision IS NULL OR precision <= 1000)),
      {_outlier_sql('good')}, ok AS (SELECT good.track_id, count(*) AS n FROM good LEFT JOIN fl USING (ord) WHERE NOT coalesce(outlier, false) GROUP BY good.track_id),
      raw AS (SELECT track_id, count(*) AS n FROM gps GROUP BY track_id),
      v AS (SELECT c_custkey AS track_id, c_custkey % 2 = 0 AS is_gopro, c_custkey % 5 <> 0 AS has_track FROM customer)
      SELECT v.track_id, CASE WHEN NOT has_track THEN 'VideoGPSNotFoundError' WHEN raw.n IS NULL THEN 'GPXEmptyError'
        WHEN is_gopro AND ok.n IS NULL THEN 'GPSNoiseError' END AS error_type, CASE WHEN is_gopro THEN 'gopro' ELSE 'video' END AS filetype
      FROM v LEFT JOIN raw USING (track_id) LEFT JOIN ok USING (track_id)""",
)
def c39(spark, sf_dir):
    key = F.col("c_custkey")
    videos = table(spark, sf_dir, "customer").select(
        key.alias("track_id"), (key % 2 == 0).alias("is_gopro"), (key % 5 != 0).alias("has_track")
    )
    # Every sixth video has nothing but untrusted fixes.
    points = gps_points(spark, sf_dir).withColumn(
        "fix", F.when(F.col("track_id") % 6 == 0, 0).otherwise(F.col("fix"))
    )
    out = N.classify_videos(videos, points, "track_id", ["time", "ord"])
    return out.select("track_id", F.col("error.type").alias("error_type"), "filetype")


# Videos whose formats err, lack a track or aren't asked for, in all combinations.
NATIVE = f"""{GPS}, v AS (SELECT c_custkey AS track_id, [NULL, ['video'], ['camm'], ['blackvue', 'gopro'], ['image']][1 + c_custkey % 5] AS ft FROM customer),
      box AS (SELECT track_id, ft, unnest([0, 1, 2]) AS r FROM v),
      met AS (SELECT track_id, r, ft, CASE WHEN r = 0 AND track_id % 13 = 0 THEN 'moov' END AS broken FROM box
        WHERE CASE r WHEN 0 THEN track_id % 2 = 0 OR track_id % 13 = 0 WHEN 1 THEN track_id % 3 <> 0 ELSE track_id % 7 < 4 END),
      first AS (SELECT track_id, arg_min(r, r) AS r, arg_min(coalesce(broken, ''), r) AS broken FROM met
        WHERE ft IS NULL OR list_contains(ft, 'video') OR list_contains(ft, ['gopro', 'camm', 'blackvue'][r + 1]) GROUP BY track_id),
      own AS (SELECT gps.* EXCLUDE (fix), CASE WHEN track_id % 4 = 0 AND track_id % 3 = 0 THEN 0 ELSE fix END AS fix, r, ord % 2 = 0 AND r = 1 AS mini
        FROM gps JOIN first USING (track_id) WHERE broken = '' AND ord % 3 <> r AND NOT (r = 2 AND track_id % 8 = 1)),
      full_ AS (SELECT * FROM (SELECT *, bool_and(mini) OVER (PARTITION BY track_id) AS none FROM own) WHERE none OR NOT mini),
      good AS (SELECT * FROM full_ WHERE r = 0 AND (fix IS NULL OR fix IN (2, 3)) AND (precision IS NULL OR precision <= 1000)),
      {_outlier_sql('good')},
      kept AS (SELECT ord, track_id, r FROM full_ WHERE r <> 0 UNION ALL SELECT good.ord, good.track_id, 0 FROM good LEFT JOIN fl USING (ord) WHERE NOT coalesce(outlier, false))"""


def native(spark, sf_dir):
    key, o = F.col("c_custkey"), F.col("ord")
    kinds = ["gopro", "camm", "blackvue"]
    asked = F.array(F.lit(None), F.array(F.lit("video")), F.array(F.lit("camm")), F.array(F.lit("blackvue"), F.lit("gopro")), F.array(F.lit("image")))
    videos = table(spark, sf_dir, "customer").select(key.alias("track_id"), F.get(asked, (key % 5).cast("int")).alias("filetypes"))
    t = F.col("track_id")
    rows = videos.select("track_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("format"))
    f = F.col("format")
    met = rows.filter(F.when(f == "gopro", (t % 2 == 0) | (t % 13 == 0)).when(f == "camm", t % 3 != 0).otherwise(t % 7 < 4))
    containers = met.withColumn("broken", F.when((f == "gopro") & (t % 13 == 0), "moov"))
    points = gps_points(spark, sf_dir).select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(k).alias("format")) for i, k in enumerate(kinds)])).alias("x"))
    points = points.select("*", "x.*").drop("x").filter((o % 3 != F.col("r")) & ~((F.col("r") == 2) & (t % 8 == 1)))
    points = points.withColumn("fix", F.when((t % 4 == 0) & (t % 3 == 0), 0).otherwise(F.col("fix")))
    points = points.withColumn("minimal", (o % 2 == 0) & (F.col("r") == 1)).drop("r")
    return native_tracks(videos, containers, points, "track_id", ["time", "ord"])


@query(
    "a23_native_order",
    f"WITH RECURSIVE {NATIVE} SELECT track_id, ord, ['gopro', 'camm', 'blackvue'][r + 1] AS filetype FROM kept",
)
def a23_native(spark, sf_dir):
    """Points of the first format that has a track, where the file types admit it."""
    return native(spark, sf_dir)[1].select("track_id", "ord", "filetype")


@query(
    "c39_native_types",
    f"""WITH RECURSIVE {NATIVE}, raw AS (SELECT track_id, count(*) AS n FROM own GROUP BY track_id), ok AS (SELECT track_id, count(*) AS n FROM kept GROUP BY track_id)
      SELECT v.track_id, CASE WHEN ok.n > 0 THEN ['gopro', 'camm', 'blackvue'][r + 1] END AS filetype,
        CASE WHEN r IS NULL THEN 'VideoGPSNotFoundError' WHEN broken <> '' THEN 'InvalidVideoError' WHEN raw.n IS NULL THEN 'GPXEmptyError' WHEN ok.n IS NULL THEN 'GPSNoiseError' END AS error_type
      FROM v LEFT JOIN first USING (track_id) LEFT JOIN raw USING (track_id) LEFT JOIN ok USING (track_id)""",
)
def c39_native(spark, sf_dir):
    """File type or error of every video."""
    return native(spark, sf_dir)[0].select("track_id", "filetype", F.col("error.type").alias("error_type"))
