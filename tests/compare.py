"""Helpers that run a query on Spark and its SQL on DuckDB and compare."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    values = [[_plain(v) for v in df[c].astype(object)] for c in columns]
    return sorted(zip(*values), key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows under the same names."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    kinds = [
        f"{c}: {got[c].dtype} vs {want[c].dtype}"
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and got[c].dtype.kind in "b" 
    ]
    if kinds:
        return "; ".join(kinds)
    bad = [(a, b) for a, b in zip(rows_of(got), rows_of(want)) if a != b]
    if bad:
        return f"{len(bad)} rows differ, columns {sorted(got.columns)}, first {bad[0][0]} vs {bad[0][1]}"
    return None
