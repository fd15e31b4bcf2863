"""Quality rules with a verdict on hosts.

Every document gets four counts and a base verdict from its own text. A host
(any grouping column) is then judged on the share of its documents that fail,
shrunk towards the corpus by a beta prior fitted to all hosts, and its verdict
goes back to its documents. All of it is DataFrame work without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import SPACE, WORD, pick
from trailframe.runtime import materialize

# What counts as a symbol.
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the row's text.

    Windows are sorted by (hash, start), so equal ones are neighbours. A word
    counts once however many repeated windows hold it: with the starts of the
    repeated windows in order, each adds at most 3 words and at most the way to
    the next start.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(
            F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"),
            i.alias("at"),
        ),
    )
    # A lambda over a one-element array binds a costly value once.
    same = lambda w, x, at: F.coalesce(F.get(w, at)["h"] == x["h"], F.lit(False))
    starts = F.element_at(
        F.transform(
            F.array(F.sort_array(windows)),
            lambda w: F.transform(
                F.filter(w, lambda x, i: same(w, x, i - 1) | same(w, x, i + 1)), lambda x: x["at"]
            ),
        ),
        1,
    )
    covered = F.aggregate(
        F.sort_array(starts),
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(n >= 4, covered).otherwise(F.lit(0).cast("bigint"))


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Replace column ``text`` by its counts (see ``quality_rules``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    rest = [c for c in df.columns if c != text]
    first = df.select(
        *rest,
        words.alias("words"),
        F.char_length(F.regexp_replace(t, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.element_at(
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1
        ).cast("bigint").alias("n_dup_lines"),
    )
    return first.select(
        *rest,
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def host_verdicts(counted: DataFrame, host: str, spreads: float = 2.0, worst: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict.

    The prior is a beta distribution fitted by moments to the hosts' failure
    rates, each host weighing its documents. A host of any size is rejected when
    its shrunk rate lies more than ``spreads`` standard deviations of the prior
    above the prior's mean, and more of its documents fail than ``worst``: few
    documents leave the rate near the mean, and a host most of whose documents
    are sound keeps them. Null is a host like any other.
    """
    hosts = counted.groupBy(host).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("mean"),
        F.sum(F.col("host_docs") * rate * rate).alias("squares"),
        F.sum("host_docs").alias("docs"),
        F.count("*").alias("hosts"),
    ).select(
        "mean",
        # Between-host variance: what the rates spread beyond chance alone.
        F.greatest(
            F.col("squares") / F.col("docs")
            - F.col("mean") * F.col("mean")
            - F.col("mean") * (1 - F.col("mean")) * F.col("hosts") / F.col("docs"),
            F.lit(1e-6),
        ).alias("spread"),
    ).select(
        "mean",
        F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1, F.lit(2.0)), F.lit(1e4)).alias("weight"),
    )
    # Two numbers for the whole corpus.
    fit = prior.first()
    mean, weight = (F.lit(float(x if x is not None else 0.0)) for x in (fit["mean"], fit["weight"]))
    shrunk = (F.col("host_failed") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.select(
        host, "host_docs", "host_failed", shrunk.alias("host_rate"),
        (shrunk > F.greatest(mean + spreads * F.sqrt(mean * (1 - mean) / (weight + 1)), F.lit(worst))).alias("host_rejected"),
    )


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    spreads: float = 2.0,
    worst: float = 0.5,
) -> DataFrame:
    """Counts, base verdict, host verdict and ``kept`` for every row.

    Returns ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate, kept``. Null text counts as empty and fails for
    want of words; a null host is a host of its own; repeated rows and null ids
    are judged one by one; an empty table gives an empty result; extra columns
    are ignored.

    The counts are written once and read twice, since hosts need all of them
    before any document gets its verdict.
    """
    rows = pick(df, id=id_col, host=host_col, text=text_col)
    counted = text_counts(rows, "text").withColumn(
        "base_failed",
        (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    counted = materialize(counted, "quality-counts")
    hosts = materialize(host_verdicts(counted, "host", spreads, worst), "quality-hosts").withColumnRenamed("host", "of")
    judged = counted.join(hosts, counted["host"].eqNullSafe(hosts["of"]), "left")
    return judged.select(
        F.col("id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT row, doc_id, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols
  FROM d),
windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n
  FROM (SELECT row, i, w[i:i + 2] AS g FROM (SELECT row, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i FROM c WHERE len(w) > 2))),
repeated AS (
  SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE n > 1) GROUP BY row),
b AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM c LEFT JOIN repeated r ON r.row = c.row),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS bad FROM f GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) AS squares, sum(n) AS docs, count(*) AS hosts FROM h),
s AS (SELECT mean, greatest(squares - mean * mean - mean * (1 - mean) * hosts / docs, 1e-6) AS spread FROM m),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1e4) AS weight FROM s),
v AS (SELECT source, (bad + mean * weight) / (n + weight) > greatest(mean + 2 * sqrt(mean * (1 - mean) / (weight + 1)), 0.5) AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source
"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")
