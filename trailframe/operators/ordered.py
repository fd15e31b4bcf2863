"""Ordered groups: row-to-row logic that holds for groups of any size.

Most of the analytics here look at neighbours inside a group ("the previous
capture of this camera"). A plain ``Window.partitionBy(group)`` does that, but
puts a whole group into one task. ``Ordered`` measures the largest group first
(a key-only count, combined map-side) and only when a group is over the limit
splits the hot groups:

* the hot rows are range-partitioned on ``(keys, order)`` and checkpointed, and
  each range becomes a *tile*;
* a scan runs as a window inside ``(keys, tile)``;
* one summary row per tile is scanned per group, and the value carried into
  each tile is joined back.

Both routes give the same answer. Nothing is sampled, capped or dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.runtime import freeze

MAX_ROWS_PER_TASK = 5_000_000
# Rows a task of a long chain of scans should get: every scan's sort holds them once more.
SPREAD_ROWS = 100_000
TILE = "_tile"


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs, as a join condition."""
    return reduce(
        lambda acc, pair: acc & pair,
        [left[a].eqNullSafe(right[b]) for a, b in pairs],
        F.lit(True),
    )


def join_keys(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Join on null-safe keys, keeping the left side's key columns only."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    joined = left.join(renamed, same(left, renamed, [(k, f"_r_{k}") for k in keys]), how)
    return joined.drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None
    k: int = 1
    current: bool = True


def prev(value: Column, k: int = 1) -> Scan:
    """Value of the row ``k`` places earlier."""
    return Scan("prev", value, k)


def nxt(value: Column, k: int = 1) -> Scan:
    """Value of the row ``k`` places later."""
    return Scan("next", value, k)


def running_sum(value: Column) -> Scan:
    """Sum from the first row up to and including this one."""
    return Scan("sum", value)


def running_max(value: Column) -> Scan:
    """Largest value from the first row up to and including this one."""
    return Scan("runmax", value)


def index() -> Scan:
    """1-based position in the group."""
    return Scan("sum", F.lit(1).cast("bigint"))


def last_known(value: Column, current: bool = True) -> Scan:
    """Nearest non-null value at or before this row (strictly before if not current)."""
    return Scan("last", value, current=current)


def next_known(value: Column, current: bool = True) -> Scan:
    """Nearest non-null value at or after this row (strictly after if not current)."""
    return Scan("first", value, current=current)


def group_total(value: Column) -> Scan:
    return Scan("total", value)


def group_min(value: Column) -> Scan:
    return Scan("min", value)


def group_max(value: Column) -> Scan:
    return Scan("max", value)


_GROUP_WIDE = {"total": F.sum, "min": F.min, "max": F.max}


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    counted = df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counted.agg(F.max("n"), F.sum("n")).head()
    return largest or 0, total or 0


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys)[0]


def spread_by(df: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Deal the groups to as many tasks as ``total`` rows need, where the session's number is too small."""
    tasks = math.ceil(total / SPREAD_ROWS)
    if not keys or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *[F.col(k) for k in keys])


def _tile(df: DataFrame, by: list[str], rows: int, limit: int) -> DataFrame:
    tiles = max(2, math.ceil(1.5 * rows / limit))
    ranged = df.repartitionByRange(tiles, *by)
    return freeze(ranged.withColumn(TILE, F.spark_partition_id() + 1))


class Ordered:
    """A DataFrame whose rows are ordered inside each key group."""

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        tiled: bool = False,
        largest: int | None = None,
    ):
        self.df, self.keys, self.order = df, keys, order
        self.tiled, self.largest = tiled, largest

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        max_rows: int | None = None,
        sized_by: list[DataFrame] | None = None,
        known: int | None = None,
        spread: bool = False,
    ) -> Ordered:
        """Measure the groups and tile those above ``max_rows``.

        ``order`` should end in a unique column so that equal times can be split.
        ``sized_by`` names cheaper inputs whose group sizes add up to at least
        the groups of ``df``; they are counted instead of ``df`` itself. ``known``
        is such a bound measured before. ``spread`` makes the number of tasks
        follow the number of rows, so that a task's memory does not grow with
        the table.
        """
        limit = max_rows or MAX_ROWS_PER_TASK
        total = 0
        if known is None:
            sizes = [group_sizes(part, keys) for part in sized_by or [df]]
            known, total = sum(s[0] for s in sizes), sum(s[1] for s in sizes)
        largest = known
        if largest <= limit:
            return cls(spread_by(df, keys, total) if spread else df, keys, order, largest=largest)
        if not keys:
            return cls(_tile(df, order, largest, limit), keys, order, True, largest)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot_keys = freeze(sizes.filter(F.col("_n") > limit))
        hot_rows = hot_keys.agg(F.sum("_n")).head()[0]
        if hot_rows is None:
            return cls(df, keys, order, largest=largest)
        hot = join_keys(df, hot_keys.select(*keys, F.lit(1).alias("_hot")), keys, "inner")
        hot = _tile(hot.drop("_hot"), [*keys, *order], hot_rows, limit)
        cold = (
            join_keys(df, hot_keys.select(*keys, F.lit(1).alias("_hot")), keys, "left")
            .filter("_hot IS NULL")
            .drop("_hot")
            .withColumn(TILE, F.lit(0))
        )
        return cls(cold.unionByName(hot), keys, order, tiled=True, largest=largest)

    # -- plumbing ---------------------------------------------------------

    @property
    def parts(self) -> list[str]:
        return [*self.keys, TILE] if self.tiled else self.keys

    def with_df(self, df: DataFrame) -> Ordered:
        """Same grouping over rows derived row by row (or filtered) from these."""
        return Ordered(df, self.keys, self.order, self.tiled, self.largest)

    def add(self, **columns: Column) -> Ordered:
        return self.with_df(self.df.withColumns(columns))

    def filter(self, condition: Column) -> Ordered:
        return self.with_df(self.df.filter(condition))

    def drop(self, *names: str) -> Ordered:
        return self.with_df(self.df.drop(*names))

    def rows(self) -> DataFrame:
        return self.df.drop(TILE)

    # -- scans ------------------------------------------------------------

    def scan(self, **scans: Scan) -> Ordered:
        """Add one column per scan; scans of one call share the sort and the join."""
        if not self.tiled:
            return self._scan_whole(scans)
        df = self._scan_tiles(scans)
        carried = self._carry(df, scans)
        joined = join_keys(df, carried, self.parts)
        final = {n: self._combine(i, s) for i, (n, s) in enumerate(scans.items())}
        return self.with_df(joined.withColumns(final).drop(*self._temps(scans)))

    def _temps(self, scans: dict[str, Scan]) -> list[str]:
        names = [f"_{p}{i}" for i in range(len(scans)) for p in ("v", "l", "c")]
        return [*names, "_up", "_down"]

    def _windows(self):
        base = Window.partitionBy(*[F.col(k) for k in self.parts])
        up = base.orderBy(*[F.col(o).asc() for o in self.order])
        down = base.orderBy(*[F.col(o).desc() for o in self.order])
        return base, up, down

    def _window_columns(self, scans: dict[str, Scan]) -> tuple[dict, dict]:
        """Window columns per scan, split by the sort they need."""
        base, up, down = self._windows()
        start = Window.unboundedPreceding
        ups: dict[str, Column] = {}
        downs: dict[str, Column] = {}
        for name, s in scans.items():
            v, stop = s.value, 0 if s.current else -1
            if s.kind == "prev":
                ups[name] = F.lag(v, s.k).over(up)
            elif s.kind == "next":
                ups[name] = F.lead(v, s.k).over(up)
            elif s.kind == "sum":
                ups[name] = F.sum(v).over(up.rowsBetween(start, 0))
            elif s.kind == "runmax":
                ups[name] = F.max(v).over(up.rowsBetween(start, 0))
            elif s.kind == "last":
                ups[name] = F.last(v, True).over(up.rowsBetween(start, stop))
            elif s.kind == "first":
                # Read backwards: a frame that ends at the current row is linear.
                downs[name] = F.last(v, True).over(down.rowsBetween(start, stop))
            else:
                ups[name] = _GROUP_WIDE[s.kind](v).over(base)
        return ups, downs

    def _scan_whole(self, scans: dict[str, Scan]) -> Ordered:
        df = self.df
        for columns in self._window_columns(scans):
            if columns:
                df = df.withColumns(columns)
        return self.with_df(df)

    def _scan_tiles(self, scans: dict[str, Scan]) -> DataFrame:
        """Scan values ``_v``, results within the tile ``_l``, places from both ends."""
        df = self.df.withColumns({f"_v{i}": s.value for i, s in enumerate(scans.values())})
        inner = {
            f"_l{i}": Scan(s.kind, F.col(f"_v{i}"), s.k, s.current)
            for i, s in enumerate(scans.values())
            if s.kind not in _GROUP_WIDE
        }
        ups, downs = self._window_columns(inner)
        _, up, down = self._windows()
        ups["_up"] = F.row_number().over(up)
        downs["_down"] = F.row_number().over(down)
        return df.withColumns(ups).withColumns(downs)

    def _carry(self, df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        """One row per tile with the value every scan brings into that tile."""
        at = F.struct(*[F.col(o) for o in self.order])
        aggs = []
        for i, s in enumerate(scans.values()):
            v = F.col(f"_v{i}")
            known = F.when(v.isNotNull(), at)
            if s.kind == "prev":
                tail = F.when(F.col("_down") <= s.k, F.struct(-F.col("_down"), v.alias("v")))
                aggs.append(F.sort_array(F.collect_list(tail)).alias(f"_s{i}"))
            elif s.kind == "next":
                head = F.when(F.col("_up") <= s.k, F.struct(F.col("_up"), v.alias("v")))
                aggs.append(F.sort_array(F.collect_list(head)).alias(f"_s{i}"))
            elif s.kind == "last":
                aggs.append(F.max_by(v, known).alias(f"_s{i}"))
            elif s.kind == "first":
                aggs.append(F.min_by(v, known).alias(f"_s{i}"))
            else:
                agg = {"sum": F.sum, "runmax": F.max, **_GROUP_WIDE}[s.kind]
                aggs.append(agg(v).alias(f"_s{i}"))
        summary = df.groupBy(*self.parts).agg(*aggs)
        base = Window.partitionBy(*[F.col(k) for k in self.keys])
        up, down = base.orderBy(F.col(TILE)), base.orderBy(F.col(TILE).desc())
        before = up.rowsBetween(Window.unboundedPreceding, -1)
        after = down.rowsBetween(Window.unboundedPreceding, -1)
        carried = []
        for i, s in enumerate(scans.values()):
            c = F.col(f"_s{i}")
            if s.kind == "prev":
                value = F.flatten(F.collect_list(c).over(up.rowsBetween(-s.k, -1)))
            elif s.kind == "next":
                value = F.flatten(F.collect_list(c).over(up.rowsBetween(1, s.k)))
            elif s.kind == "last":
                value = F.last(c, True).over(before)
            elif s.kind == "first":
                value = F.last(c, True).over(after)
            elif s.kind == "sum":
                value = F.sum(c).over(before)
            elif s.kind == "runmax":
                value = F.max(c).over(before)
            else:
                value = _GROUP_WIDE[s.kind](c).over(base)
            carried.append(value.alias(f"_c{i}"))
        return summary.select(*self.parts, *carried)

    def _combine(self, i: int, s: Scan) -> Column:
        carry = F.col(f"_c{i}")
        if s.kind in _GROUP_WIDE:
            return carry
        local = F.col(f"_l{i}")
        if s.kind == "prev":
            back = F.least(F.col("_up") - s.k - 1, F.lit(-1))
            far = F.try_element_at(carry, back.cast("int"))["v"]
            return F.when(F.col("_up") > s.k, local).otherwise(far)
        if s.kind == "next":
            ahead = F.lit(s.k + 1) - F.col("_down")
            far = F.try_element_at(carry, F.greatest(ahead, F.lit(1)).cast("int"))["v"]
            return F.when(F.col("_down") > s.k, local).otherwise(far)
        if s.kind == "sum":
            return F.when(
                local.isNull() & carry.isNull(), F.lit(None)
            ).otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        if s.kind == "runmax":
            return F.greatest(local, carry)
        return F.coalesce(local, carry)


def number_globally(
    df: DataFrame, order: list[str], name: str, max_rows: int | None = None
) -> DataFrame:
    """Dense 0-based numbering of all rows without a single-task window at scale."""
    numbered = Ordered.of(df, [], order, max_rows).scan(**{name: index()})
    return numbered.rows().withColumn(name, F.col(name) - 1)
