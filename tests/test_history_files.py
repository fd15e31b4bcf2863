"""History files: sorted, with Bloom filters, so that a look-up reads few row groups."""

from pyspark.sql import functions as F

from trailframe.sources import writers


def scanned(df):
    """Rows that the file scans of a finished plan put out."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        left += [node.children().apply(i) for i in range(node.children().length())]
    return total


def test_a_look_up_reads_few_rows(spark, tmp_path):
    path, n = str(tmp_path / "h"), 300_000
    rows = spark.range(n).select(F.md5(F.col("id").cast("string").cast("binary")).alias("sequence_md5sum"), F.repeat(F.col("id").cast("string"), 20).alias("summary"))
    writers.append_history(rows, path, group_bytes=16 << 10)
    hit = [r[0] for r in rows.filter("id % 30000 = 7").select("sequence_md5sum").collect()]
    missed = ["%032x" % (i * 7919) for i in range(10)]
    found = writers.find_history(spark, path, hit)
    assert sorted(r.sequence_md5sum for r in found.collect()) == sorted(hit)
    assert len(hit) <= scanned(found) < n / 30
    found = writers.find_history(spark, path, hit + missed)
    assert found.count() == len(hit)
    nothing = writers.find_history(spark, path, missed)
    assert nothing.collect() == [] and scanned(nothing) < n / 60
    assert writers.find_history(spark, path, []).count() == 0
