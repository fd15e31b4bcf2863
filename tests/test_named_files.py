"""Files named by row: a folder a task, whatever the number of files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from trailframe.catalog import files
from trailframe.runtime import open_store
from trailframe.sources import writers


def below(path):
    where = open_store(path)[1]
    return {os.path.relpath(os.path.join(d, f), where): open(os.path.join(d, f)).read() for d, _, found in os.walk(where) for f in found}


def test_a_file_per_user_in_a_folder_per_task(spark):
    rows = [(u, o, f"line {u} {o}" if o % 3 else None) for u in [None, *range(-1, 300)] for o in (10, 9, 1)]
    df = spark.createDataFrame(rows, "track_id long, ord long, value string")
    found = below(files.per_user_files(df, spark, "named"))
    assert len({name.split("/")[0] for name in found}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(found) == 302 and all(not name.startswith(".") for name in found)
    by_name = {name.split("/")[1]: text for name, text in found.items()}
    assert by_name["track_id=7.txt"] == "line 7 1\n\nline 7 10\n"
    named = spark.createDataFrame([(f"/a/b/{n}",) for n in by_name], "file string").select(files.user_of())
    assert {r.track_id for r in named.collect()} == {None, *range(-1, 300)}


def test_files_across_batches(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("value"))
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        writers.write_named_files(df, path, F.col("k"), ["o"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(below(path).values()) == ["".join(f"{i}\n" for i in range(1000))]


def test_hidden_and_nested_names_are_refused(spark):
    df = spark.createDataFrame([("_a", 1, "x")], "k string, o long, value string")
    with pytest.raises(Exception, match="not the name of a visible file"):
        writers.write_named_files(df, tempfile.mkdtemp(prefix="spark-"), F.col("k"), ["o"])
