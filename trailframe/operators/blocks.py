"""Order-dependent folds over groups of any size, in blocks that all cores share.

Groups of up to ``limit`` rows fold inside one expression (``fold.py``). Rows of
larger ones get their place in the group and are dealt into blocks of ``BLOCK``
places, so that no task holds or walks a group:

* ``total_splits``: the row where a running total passes its limit, seen from
  any row, is a search in the group's prefix sums. These pointers are followed
  to each block's end inside the block; from there on a few nodes are left, and
  doubling their pointers tells in log(blocks) rounds which rows are reached.
* ``carried_states``: every block is first folded as if it began a group, and
  again, side by side, while the state carried into it changes.
* ``last_kept``: every block is first folded as if it began a group. With the
  true row carried in, it is folded again only up to the first row that both
  ways keep, for from there on they agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.operators import ordered as O
from trailframe.operators.fold import last_kept_walk
from trailframe.operators.ordered import Ordered, join_keys
from trailframe.runtime import freeze, materialize

BLOCK = 1 << 16
# Rows that are folded again before the two ways are compared.
STRIDE = 1_024


def by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with up to ``limit`` rows, and those of larger ones with a group number ``_g`` (None if there are none)."""
    sizes = df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > limit).select(*keys, F.monotonically_increasing_id().alias("_g")), "large-groups")
    if large.isEmpty():
        return df, None
    marked = join_keys(df, large, keys)
    return marked.filter("_g IS NULL").drop("_g"), marked.filter("_g IS NOT NULL")


def placed(large: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their 1-based place ``_i`` in the group and its ``_block``, stored."""
    numbered = Ordered.of(large, ["_g"], order).scan(_i=O.index()).rows()
    return freeze(numbered.withColumn("_block", F.expr(f"(_i - 1) div {BLOCK}")))


def total_splits(rows: DataFrame, amount: str, limit: int, carry: bool = True) -> DataFrame:
    """``_g, _i`` of the rows where the running total of ``amount`` passes ``limit``.

    The total restarts at such a row, with its amount (``carry``) or with
    nothing; a group's first row is never one. ``amount`` is a ``bigint``, not
    null and not negative.
    """
    slim = rows.select("_g", "_i", "_block", F.col(amount).alias("_v"))
    sums = freeze(Ordered.of(slim, ["_g"], ["_i"]).scan(_s=O.running_sum(F.col("_v"))).rows())
    # What the sum must exceed for the next split, seen from a row where the total restarts.
    first = (F.col("_i") == 1) & (F.col("_v") <= limit)
    bound = F.col("_s") - F.when(F.lit(carry) | first, F.col("_v")).otherwise(0) + limit
    asks = sums.select("_g", bound.alias("_w"), F.lit(1).alias("_ask"), "_i", F.lit(None).cast("bigint").alias("_at"), "_v")
    both = sums.select("_g", F.col("_s").alias("_w"), F.lit(0).alias("_ask"), "_i", F.col("_i").alias("_at"), "_v").unionByName(asks)
    found = Ordered.of(both, ["_g"], ["_w", "_ask", "_i"]).scan(_to=O.next_known(F.col("_at"), current=False)).rows()
    # A row over the limit by itself is followed by a split, whatever comes next.
    lone = F.lit(carry) & (F.col("_v") > limit)
    nxt = found.filter("_ask = 1").select(
        "_g", "_i", F.expr(f"(_i - 1) div {BLOCK}").alias("_block"), F.when(lone, F.col("_i") + 1).otherwise(F.coalesce("_to", F.lit(0))).alias("_to")
    )
    nxt = materialize(nxt, "next-splits")
    jumps = materialize(nxt.groupBy("_g", "_block").applyInPandas(_leave, "_g bigint, _i bigint, _to bigint"), "jumps")
    entries = _reached(jumps)
    entries = entries.withColumn("_block", F.expr(f"(_i - 1) div {BLOCK}"))
    marked = nxt.groupBy("_g", "_block").cogroup(entries.groupBy("_g", "_block")).applyInPandas(_follow, "_g bigint, _i bigint")
    return marked


def _leave(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of splits from each row leaves the block (0: it ends there)."""
    rows = rows.sort_values("_i")
    place, to = rows["_i"].to_numpy(), rows["_to"].to_numpy()
    n, here = len(place), np.arange(len(place))
    inside = (to > 0) & (to - place[0] < n)
    step = np.where(inside, to - place[0], here)
    for _ in range(n.bit_length()):
        step = step[step]
    return pd.DataFrame({"_g": rows["_g"].to_numpy(), "_i": place, "_to": to[step]})


def _follow(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The splits of a block from the row where the chain enters it."""
    out = []
    if len(rows) and len(entry):
        rows = rows.sort_values("_i")
        first, to = int(rows["_i"].iloc[0]), rows["_to"].tolist()
        at = int(entry["_i"].iloc[0])
        if at > 1:
            out.append(at)
        while 0 < (at := to[at - first]) < first + len(to):
            out.append(at)
    return pd.DataFrame({"_g": [int(rows["_g"].iloc[0])] * len(out) if out else [], "_i": out}, dtype="int64")


def _reached(jumps: DataFrame) -> DataFrame:
    """Rows at which chains from the groups' first rows enter their blocks (``_g, _i``), by doubling pointers."""
    targets = jumps.filter("_to > 0").select("_g", F.col("_to").alias("_i")).distinct()
    firsts = jumps.filter("_i = 1")
    pointers = materialize(jumps.join(targets, ["_g", "_i"]).unionByName(firsts), "pointers")
    reached = firsts.select("_g", "_i")
    blocks = (jumps.agg(F.max("_i")).first()[0] or 1) // BLOCK + 1
    for level in range((blocks - 1).bit_length()):
        hops = reached.join(pointers, ["_g", "_i"]).filter("_to > 0").select("_g", F.col("_to").alias("_i"))
        reached = materialize(reached.unionByName(hops).distinct(), f"reached-{level}")
        beyond = pointers.select("_g", F.col("_i").alias("_to"), F.col("_to").alias("_far"))
        pointers = pointers.join(beyond, ["_g", "_to"], "left").select("_g", "_i", F.coalesce("_far", F.lit(0)).alias("_to"))
        pointers = materialize(pointers, f"pointers-{level}")
    return reached


Judge = Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]]


def last_kept(rows: DataFrame, inputs: dict[str, Column], known: str, judge: Judge, outs: T.StructType, report: dict | None = None) -> DataFrame:
    """Add ``outs``: every row compared with the last kept one before it in its group.

    ``judge`` is as in ``fold.last_kept_walk``; ``inputs`` are doubles. Blocks
    whose carried-in row has changed are folded again, side by side, until none
    has: after round r the first r blocks of every group are final, and blocks
    that agree with their first fold end it early. ``report`` gets the number of
    rounds, and of rows that were folded again.
    """
    names = [f.name for f in outs]

    def judged(kept, arrays):
        keep, found = judge(kept, arrays)
        return keep, {**found, "_kept": ~np.isnan(arrays[known]) if kept is None else keep}

    walk = last_kept_walk(judged, [*names, "_kept"], known)
    columns = list(inputs)

    def arrays_of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: pdf[c].to_numpy(dtype=np.float64) for c in columns}

    def state_of(entry) -> dict[str, np.float64] | None:
        return None if entry is None or not len(entry) else dict(zip(columns, np.asarray(entry, dtype=np.float64)))

    def row(pdf, entry, exit_, kept, again) -> pd.DataFrame:
        exit_ = None if exit_ is None else [float(exit_[c]) for c in columns]
        line = (int(pdf["_g"].iloc[0]), int(pdf["_block"].iloc[0]), entry, exit_, kept.astype("<i4").tobytes(), again)
        return pd.DataFrame([line], columns=["_g", "_block", "entry", "exit", "kept", "again"])

    def speculate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        state, found = walk(None, arrays_of(pdf))
        return row(pdf, None, state, np.flatnonzero(found["_kept"]), 0)

    def refold(pdf: pd.DataFrame, was: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(was):
            return pd.DataFrame(columns=["_g", "_block", "entry", "exit", "kept", "again"])
        pdf, was = pdf.sort_values("_i"), was.iloc[0]
        old, entry = np.frombuffer(was["kept"], "<i4"), [float(x) for x in was["carried"]]
        arrays, state, kept, at, n = arrays_of(pdf), state_of(entry), [np.zeros(0, int)], 0, len(pdf)
        while at < n:
            state, found = walk(state, {c: v[at : at + STRIDE] for c, v in arrays.items()})
            some = np.flatnonzero(found["_kept"]) + at
            at = min(n, at + STRIDE)
            both = np.intersect1d(some, old)
            if len(both):
                kept += [some[some <= both[0]], old[old > both[0]]]
                state = state_of(was["exit"])
                break
            kept.append(some)
        kept = np.concatenate(kept)
        return row(pdf, entry, state if len(kept) else None, kept, int(was["again"]) + at)

    def finish(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["_g", "_i", *names])
        pdf = pdf.sort_values("_i")
        carried = entry["carried"].iloc[0] if len(entry) else None
        found = walk(state_of(carried), arrays_of(pdf))[1]
        return pd.DataFrame({"_g": pdf["_g"].to_numpy(), "_i": pdf["_i"].to_numpy(), **{n: found[n] for n in names}})

    slim = materialize(rows.select("_g", "_i", "_block", *[c.cast("double").alias(n) for n, c in inputs.items()]), "fold-inputs")
    ends = "_g bigint, _block bigint, entry array<double>, exit array<double>, kept binary, again bigint"
    folded = materialize(slim.groupBy("_g", "_block").applyInPandas(speculate, ends), "speculated")
    before = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rounds = 0
    while True:
        carried = folded.select("_g", "_block", "entry", F.last("exit", True).over(before).alias("carried"))
        changed = materialize(carried.filter(~F.col("entry").eqNullSafe(F.col("carried"))).select("_g", "_block", "carried"), "changed")
        if changed.isEmpty():
            break
        rounds += 1
        stale = folded.join(changed, ["_g", "_block"])
        part = slim.join(changed.select("_g", "_block"), ["_g", "_block"], "left_semi")
        redone = part.groupBy("_g", "_block").cogroup(stale.groupBy("_g", "_block")).applyInPandas(refold, ends)
        fresh = folded.join(changed.select("_g", "_block"), ["_g", "_block"], "left_anti").unionByName(redone)
        folded = materialize(fresh, f"folded-{rounds}")
    if report is not None:
        report["rounds"] = rounds
        report["rows"] = rows.count()
        report["again"] = folded.agg(F.sum("again")).first()[0]
    entries = folded.filter("entry IS NOT NULL").select("_g", "_block", F.col("entry").alias("carried"))
    schema = T.StructType([T.StructField("_g", T.LongType()), T.StructField("_i", T.LongType()), *outs.fields])
    found = slim.groupBy("_g", "_block").cogroup(entries.groupBy("_g", "_block")).applyInPandas(finish, schema)
    return rows.join(found, ["_g", "_i"]).drop("_g", "_i", "_block")


Fold = Callable[[pd.DataFrame, list[float]], tuple[pd.DataFrame, list[float]]]


def carried_states(slim: DataFrame, fold: Fold, report: dict | None = None) -> DataFrame:
    """``_g, _block, entry``: the state that each block's fold begins with.

    ``fold(rows, state)`` gets a block's rows in order and returns its outputs
    and the state after it; a group begins with the empty state. After round r
    the first r blocks of every group are final; where states forget what lies
    far back, two or three rounds do.
    """
    ends = "_g bigint, _block bigint, entry array<double>, exit array<double>"

    def row(pdf: pd.DataFrame, entry: list[float]) -> pd.DataFrame:
        state = fold(pdf.sort_values("_i"), entry)[1]
        return pd.DataFrame([(int(pdf["_g"].iloc[0]), int(pdf["_block"].iloc[0]), entry, state)], columns=["_g", "_block", "entry", "exit"])

    def again(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(entry):
            return pd.DataFrame(columns=["_g", "_block", "entry", "exit"])
        return row(pdf, [float(x) for x in entry["carried"].iloc[0]])

    folded = materialize(slim.groupBy("_g", "_block").applyInPandas(lambda pdf: row(pdf, []), ends), "speculated")
    before = Window.partitionBy("_g").orderBy("_block")
    rounds = 0
    while True:
        carried = folded.select("_g", "_block", "entry", F.coalesce(F.lag("exit").over(before), F.array().cast("array<double>")).alias("carried"))
        changed = materialize(carried.filter(~F.col("entry").eqNullSafe(F.col("carried"))).select("_g", "_block", "carried"), "changed")
        if changed.isEmpty():
            break
        rounds += 1
        part = slim.join(changed.select("_g", "_block"), ["_g", "_block"], "left_semi")
        redone = part.groupBy("_g", "_block").cogroup(changed.groupBy("_g", "_block")).applyInPandas(again, ends)
        folded = materialize(folded.join(changed.select("_g", "_block"), ["_g", "_block"], "left_anti").unionByName(redone), f"folded-{rounds}")
    if report is not None:
        report["rounds"] = rounds
    return folded.select("_g", "_block", "entry")


def with_states(slim: DataFrame, states: DataFrame, fold: Fold, schema: str) -> DataFrame:
    """The outputs of every block's fold from its own state."""

    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values("_i"), [float(x) for x in entry["entry"].iloc[0]])[0]

    return slim.groupBy("_g", "_block").cogroup(states.groupBy("_g", "_block")).applyInPandas(run, schema)
