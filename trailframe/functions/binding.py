"""Naming an intermediate Column so that it appears once in the expression tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, with ``value`` evaluated a single time.

    A Column used twice is copied twice into the plan; parsers that build on
    each other would grow exponentially without this.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later steps read many times.

    Computed in a generator, they are evaluated once per row: the optimizer
    neither copies them into every later use nor into pushed-down filters.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))
