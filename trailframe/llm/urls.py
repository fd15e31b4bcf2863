"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse ("com.example.www."), so a rule's host
and all its subdomains are one interval of keys, and intervals of rules nest or
are apart. Pages and interval starts are sorted together and swept once: a
stack holds the rules that are open at the current key, innermost last.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm.base import query, table
from trailframe.llm.rows import UPPER, pick

# Labels end with this, below every character of a host: a host's subdomains then follow it directly.
END = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by the end mark; empty for an empty host."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, END), F.lit(END)))


def _upper(key: str) -> str:
    """The first key after all that start with ``key`` (whose last character is the end mark)."""
    return key[:-1] + chr(ord(END) + 1)


def _splits(keyed: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Bounds of key ranges of like size: at most ``parts`` of them, from a sample of the keys.

    Bounds are (key, salt), so a host with a third of all rows spans many ranges.
    Only the ranges' sizes depend on the sample, never the result.
    """
    n = keyed.count()
    share = min(1.0, 200.0 * parts / max(1, n))
    drawn = sorted((r[0], r[1]) for r in keyed.select("hk", "salt").sample(share, 11).limit(400 * parts).collect())
    step = len(drawn) / parts
    return sorted({drawn[int(i * step)] for i in range(1, parts)}) if drawn else []


def url_rules(
    df: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    parts: int | None = None,
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``df``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and every
    subdomain when the address's path starts with the rule's; the longest rule
    text (host and path) wins, and of equal texts the one that blocks. A rule
    with a null host is skipped, a null path is empty. Rows without a fitting
    rule get a null ``rule`` and ``default``. Null addresses have an empty host
    and path, which no rule fits; repeated rows and null ids are judged one by
    one; empty tables (of pages or of rules) give what they should; extra
    columns are ignored.

    Pages are dealt into key ranges; a rule goes to the ranges that its interval
    meets, so a rule on a whole top-level domain is copied once a range, and the
    copies are at most the rules plus the ranges times the depth of nesting.
    """
    spark = df.sparkSession
    host, path = host_and_path(F.col("url"))
    pages = pick(df, id=id_col, url=url_col)
    kind = pages.schema["id"].dataType
    # Ids travel as text: pandas would turn nullable integers into floats.
    pages = pages.select(F.col("id").cast("string").alias("id"), host.alias("host"), path.alias("path"))
    # The salt spreads a host over ranges; it follows the row's own values.
    pages = pages.withColumn("hk", host_key(F.col("host"))).withColumn("salt", F.xxhash64("id", "path"))
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = _splits(pages, parts)
    keys = [k for k, _ in splits]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["part"] = [bisect.bisect_right(splits, (k, s)) for k, s in zip(f["hk"], f["salt"])]
            yield f

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                f["part"] = [
                    list(range(bisect.bisect_left(keys, k), bisect.bisect_left(keys, _upper(k)) + 1)) for k in f["hk"]
                ]
                f = f.explode("part")
                f["part"] = f["part"].astype("int64")
            else:
                f["part"] = pd.Series(dtype="int64")
            yield f

    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "hk")]
    placed = pages.mapInPandas(
        place, T.StructType([T.StructField("id", T.StringType()), *fields, T.StructField("salt", T.LongType()), T.StructField("part", T.LongType())])
    ).select("part", "hk", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    usable = rules.filter("host IS NOT NULL AND host <> ''").select(
        F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    usable = usable.withColumn("hk", host_key(F.col("host"))).groupBy("host", "path", "hk").agg(F.max("verdict").alias("verdict"))
    opened = usable.mapInPandas(spread, T.StructType([*fields, T.StructField("verdict", T.StringType()), T.StructField("part", T.LongType())])).select(
        "part", "hk", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "host", "path", "verdict"
    )

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, list[tuple[str, str, str]]]] = []  # open intervals: key and its rules (host, path, verdict)
        at = None
        for f in frames:
            rule_out, verdict_out, keep = [], [], []
            for part, hk, kind, h, p, v in zip(f["part"], f["hk"], f["kind"], f["host"], f["path"], f["verdict"]):
                if part != at:
                    stack, at = [], part
                while stack and not hk.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != hk:
                        stack.append((hk, []))
                    stack[-1][1].append((h, p, v))
                    continue
                best = None
                for _, nested in reversed(stack):
                    for of, start, verdict in nested:
                        # The host is checked again: a label may hold the end mark itself.
                        fits = p.startswith(start) and (h == of or h.endswith("." + of))
                        if fits and (best is None or len(of) + len(start) > len(best[0])):
                            best = (of + start, verdict)
                rule_out.append(best[0] if best else None)
                verdict_out.append(best[1] if best else default)
            pages_only = f[f["kind"] == 1]
            yield pd.DataFrame({
                "id": pages_only["id"], "host": pages_only["host"], "path": pages_only["path"],
                "rule": pd.Series(rule_out, index=pages_only.index, dtype="object"),
                "verdict": pd.Series(verdict_out, index=pages_only.index, dtype="object"),
            })

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "host", "path", "rule", "verdict")])
    both = placed.unionByName(opened).repartition(parts, "part").sortWithinPartitions("part", "hk", "kind", "path")
    judged = both.mapInPandas(sweep, schema)
    return judged.select(F.col("id").cast(kind).alias(id_col), "host", "path", "rule", "verdict")


# The contract's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


@query("op6_url_rules", SQL)
def op6_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules(table(spark, sf_dir, "pages"), rules)
