"""Order-dependent folds: what a row gets depends on the rows before it in its group.

``fold_bounded`` runs a step as Column expressions inside ``aggregate`` over a
sorted array, for groups of bounded size (a run of at most a thousand captures,
or groups that were just measured to be small). ``blocks.py`` has the way for
larger groups; ``last_kept_walk`` is what it does inside a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arrays folded inside one expression stay below this many rows.
MAX_ARRAY_ROWS = 2_000
# Outputs gathered at once inside a fold; appending copies them.
CHUNK = 48

ColumnStep = Callable[[Column, Column], tuple[Column, Column]]
Walk = Callable[[Any, dict[str, np.ndarray]], tuple[Any, dict[str, np.ndarray]]]


def fold_bounded(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    init: Column,
    state_type: str,
    out_type: str,
    step: ColumnStep,
) -> DataFrame:
    """Fold every group through ``step`` and add the output struct's fields.

    ``step(state, row)`` returns the next state and the row's output struct.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    rows = F.sort_array(F.collect_list(row)).alias("_rows")
    grouped = df.groupBy(*keys).agg(rows)

    def merge(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(
            state.cast(state_type).alias("state"),
            F.concat(acc["out"], F.array(out.cast(out_type))).alias("out"),
        )

    start = lambda state: F.struct(
        state.cast(state_type).alias("state"), F.array().cast(f"array<{out_type}>").alias("out")
    )

    def chunk(acc: Column, items: Column) -> Column:
        # A lambda over a one-element array binds the chunk's fold once.
        folded = F.array(F.aggregate(items, start(acc["state"]), merge))
        return F.transform(
            folded,
            lambda x: F.struct(x["state"].alias("state"), F.concat(acc["outs"], F.array(x["out"])).alias("outs")),
        )[0]

    zero = F.struct(
        init.cast(state_type).alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs")
    )
    chunks = F.transform(
        F.sequence(F.lit(1), F.size("_rows"), F.lit(CHUNK)), lambda i: F.slice("_rows", i, F.lit(CHUNK))
    )
    folded = grouped.select(
        *keys, "_rows", F.aggregate(chunks, zero, chunk, lambda acc: F.flatten(acc["outs"])).alias("_outs")
    )
    pairs = F.explode(F.arrays_zip("_rows", "_outs")).alias("_pair")
    return folded.select(*keys, pairs).select(*keys, "_pair._rows.*", "_pair._outs.*")


def last_kept_walk(judge: Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]], names: list[str], known: str) -> Walk:
    """Compare every row with the last kept one before it.

    ``judge(kept, rows)`` tells which of the rows are kept, given one kept row
    for all or one each, and what they output; with no kept row yet it is given
    None. Rows whose input ``known`` is NaN have nothing to compare, and are
    never kept. While rows are kept one after the other, each one's predecessor
    is its kept row, so whole stretches are judged at once.
    """

    def walk(state: dict | None, arrays: dict[str, np.ndarray]) -> tuple[dict | None, dict[str, np.ndarray]]:
        n = len(arrays[known])
        outs = {k: v for k, v in judge(None, arrays)[1].items()}
        real = np.flatnonzero(~np.isnan(arrays[known]))
        if not len(real):
            return state, outs
        rows = {k: v[real] for k, v in arrays.items()}
        m = len(real)
        found = {k: v[real].copy() for k, v in outs.items()}

        def put(a: int, b: int, values: dict[str, np.ndarray], offset: int) -> None:
            for k in names:
                found[k][a:b] = values[k][a - offset : b - offset]

        before = {k: v[:-1] for k, v in rows.items()}
        steps, beside = judge(before, {k: v[1:] for k, v in rows.items()}) if m > 1 else (np.zeros(0, bool), None)
        at = 0
        if state is None:
            state, at = {k: v[0] for k, v in rows.items()}, 1
        chained = at == 1
        while at < m:
            if chained:
                # Row at - 1 is kept: go on while steps are.
                stop = at - 1 + int(np.argmin(steps[at - 1 :])) if not steps[at - 1 :].all() else m - 1
                if stop > at - 1:
                    put(at, stop + 1, beside, 1)
                    at = stop + 1
                    state = {k: v[at - 1] for k, v in rows.items()}
                if at >= m:
                    break
            width, chained = 16, False
            while at < m:
                end = min(m, at + width)
                kept, values = judge(state, {k: v[at:end] for k, v in rows.items()})
                hit = int(np.argmax(kept)) if kept.any() else end - at
                stop = min(end, at + hit + 1)
                put(at, stop, values, at)
                at, width = stop, width * 2
                if kept.any():
                    state = {k: v[at - 1] for k, v in rows.items()}
                    chained = True
                    break
        for k in names:
            outs[k][real] = found[k]
        return state, outs

    return walk


def split_runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    init: Column,
    state_type: str,
    step: ColumnStep,
    name: str = "run",
) -> DataFrame:
    """Number the runs of bounded groups: a row whose step says split starts one.

    ``step(state, row)`` returns the next state and a boolean Column.
    """

    def numbered(acc: Column, row: Column) -> tuple[Column, Column]:
        state, split = step(acc["inner"], row)
        # The first row opens run 0 whether or not the step asks for a split.
        run = F.when(acc["run"] < 0, 0).otherwise(acc["run"] + F.when(split, 1).otherwise(0))
        return (
            F.struct(state.cast(state_type).alias("inner"), run.cast("int").alias("run")),
            F.struct(run.cast("int").alias(name)),
        )

    start = F.struct(init.cast(state_type).alias("inner"), F.lit(-1).alias("run"))
    return fold_bounded(
        df, keys, order, start, f"struct<inner:{state_type},run:int>", f"struct<{name}:int>", numbered
    )


def stream_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    handle: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Feed each partition's rows, sorted by key and order, through ``handle``.

    All rows of a key arrive in one partition but batch by batch, so a handler
    holds as much as its state needs and never a whole group.
    """
    arranged = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return arranged.mapInPandas(handle, schema)
