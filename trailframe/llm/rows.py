"""Helpers shared by the operators: picking columns and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.runtime import materialize

# Separators and words, as the contracts spell them (ASCII white space).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Just the wanted columns, ``new=old``, by position.

    Looking columns up by position keeps extra columns harmless whose names
    differ in case only, or that occur twice (the first one counts).
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in wanted.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(df: DataFrame, name: str) -> DataFrame:
    """Add a key that tells rows apart even when ids are null or repeat.

    Only for plans that number the rows once: how a file scan is split, and so
    the key, depends on the cores that live when it runs. See ``keyed``.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key as in ``with_key``, written once: every plan over it reads the same keys."""
    return materialize(with_key(df, name), "keyed")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())
