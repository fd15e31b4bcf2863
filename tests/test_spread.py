"""Long chains of scans: tasks follow the number of rows."""

from pyspark.sql import functions as F

from trailframe.catalog.sequences import LIMITS, flagship_input
from trailframe.catalog.tracks import log_points, photos
from trailframe.operators import ordered as O
from trailframe.operators import sequences as S
from trailframe.operators import tracks as K

SF = "/root/testdata/sf0.001"


def both(spark, monkeypatch, make, rows):
    few = make()
    monkeypatch.setattr(O, "SPREAD_ROWS", rows)
    return few, make()


def text(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_cleaning_is_dealt_by_rows(spark, monkeypatch):
    few, many = both(spark, monkeypatch, lambda: S.clean_captures(flagship_input(spark, SF), LIMITS), 50)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange") == 1
    assert many.rdd.getNumPartitions() == 20
    assert text(few) == text(many)


def test_interpolation_is_dealt_by_rows(spark, monkeypatch):
    make = lambda: K.interpolate(photos(spark, SF), log_points(spark, SF), ["track_id"])
    few, many = both(spark, monkeypatch, make, 50)
    assert many.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert text(few) == text(many)


def test_ungrouped_and_small_tables_stay(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    assert O.Ordered.of(df, ["k"], ["id"], spread=True).df is df
    monkeypatch.setattr(O, "SPREAD_ROWS", 5)
    assert O.Ordered.of(df, [], ["id"], spread=True).df is df
