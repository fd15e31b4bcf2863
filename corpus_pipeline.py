"""From raw documents to sampled token ids, stage by stage.

Every stage reads all that its predecessor kept, as a stored table, and returns
the columns of ``documents``; the last returns ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm.base import table
from trailframe.llm.exact import exact_dedup
from trailframe.llm.mixing import mix_sources
from trailframe.llm.ngram_join import ngram_jaccard
from trailframe.llm.pieces import sample_segmentations
from trailframe.llm.rows import free_name, keyed
from trailframe.llm.tokens import vocabulary
from trailframe.llm.toxicity import learn, toxicity_score
from trailframe.runtime import materialize


def _without(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that ``judge`` (of rows and the name of their key, to key and kept) keeps."""
    key = free_name(docs, "row_key")
    rows = keyed(docs, key)
    dropped = materialize(judge(rows, key).filter("NOT kept").select(F.col("key").alias(key)), "dropped")
    return rows.join(dropped, key, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; null and empty texts stay."""
    score = toxicity_score(learn(docs, table(spark, sf_dir, "labels"), "doc_id", "text"))
    return docs.filter(score("text") < 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return _without(docs, lambda rows, key: exact_dedup(rows, key_col=key))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, 0.8) the row with the smallest doc_id."""
    return _without(docs, lambda rows, key: ngram_jaccard(rows, words=5, percent=80, key_col=key))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    key, copies = free_name(docs, "row_key"), free_name(docs, "row_copies")
    rows = keyed(docs, key)
    taken = mix_sources(rows, key_col=key).filter("copies > 0").select(F.col("key").alias(key), F.col("copies").alias(copies))
    taken = materialize(taken, "taken")
    joined = rows.join(taken.hint("merge"), key)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document."""
    return sample_segmentations(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("mix_sources", mixed),
    ("sample_pieces", pieces),
]

# Learned scores, seeded chance and segmentations have no SQL; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
