"""Tag maps: one shuffle per table of elements, texts in order, and right for odd ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.functions import tags as G
from trailframe.functions import timeparse as P


def test_elements_are_shuffled_once(spark):
    rows = spark.range(1000).select(
        (F.col("id") % 50).alias("file"), F.col("id").alias("ord"), (F.col("id") % 3).cast("string").alias("tag"), F.col("id").cast("string").alias("text")
    )
    tags = G.collect_tags(rows, ["file"])
    plan = tags._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_texts_of_a_tag_are_in_order_and_nulls_are_left_out(spark):
    rows = [(1, 3, "b", "y"), (1, 1, "b", "x"), (1, 2, "a", "z"), (1, 4, "c", None), (2, 1, "b", "w"), (None, 1, "a", "v"), (3, 1, "a", None), (1, 1, "b", "a")]
    got = G.collect_tags(spark.createDataFrame(rows, "file long, ord int, tag string, text string"), ["file"]).collect()
    assert {r["file"]: r["tags"] for r in got} == {1: {"a": ["z"], "b": ["a", "x", "y"]}, 2: {"b": ["w"]}, None: {"a": ["v"]}}


def test_iso_texts_with_parts_left_out(spark):
    texts = ["2024-01-02", "2024-01-02T03", "2024-01-02T03:04Z", "2024-01-02T03:04:05.5-01:30", "2024-01-02T24:00", "2024-13-02", "no", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(P.as_unix_time(P.parse_iso(F.col("t"))).alias("u"))
    day = 1704153600.0
    assert [r["u"] for r in df.collect()] == [day, day + 10800, day + 11040, day + 11045.5 + 5400, None, None, None, None, None]
