"""Exact duplicates by deterministic naming.

A text is cut into blocks of fixed size. Equal blocks get equal integer names,
unequal blocks unequal ones, by sorting; then names of adjacent blocks are
named in pairs, level by level, until every text has one name left. A name
stands for the whole content, so equal names mean equal texts: no hash decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import UPPER, keyed, pick
from trailframe.llm.store import give_back
from trailframe.runtime import materialize

BLOCK = 4096
# Bytes of different blocks that a task combines before it hands them on.
HELD = 24 << 20

BLOCKS = "slot int, block binary, uses array<struct<key:bigint,at:int,n:int,sha:binary>>"
USES = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("sha", pa.binary())]))


def _cut(size: int, slots: int):
    """Task function: texts to blocks, equal ones of a task combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        weight = 0

        def flush() -> pa.RecordBatch:
            names = list(held)
            slot = [int.from_bytes(hashlib.blake2b(b, digest_size=4).digest(), "big") % slots for b in names]
            return pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int32()), pa.array(names, pa.binary()), pa.array([held[b] for b in names], USES)],
                ["slot", "block", "uses"],
            )

        lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for key, value in zip(batch.column("key").to_pylist(), texts):
                data = (value.as_py() or b"").translate(lower)
                n = max(1, -(-len(data) // size))
                sha = hashlib.sha256(data).digest()
                for at in range(n):
                    block = data[at * size : (at + 1) * size]
                    uses = held.get(block)
                    if uses is None:
                        uses = held[block] = []
                        weight += len(block) + 100
                    uses.append({"key": key, "at": at, "n": n, "sha": sha if at == 0 else None})
                    weight += 60
                if weight >= HELD:
                    yield flush()
                    held.clear()
                    weight = 0
        if held:
            yield flush()
        held.clear()
        give_back()

    return run


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: number the different blocks of sorted rows, one name a use."""
    part = TaskContext.get().partitionId()
    last, rank = None, 0
    for batch in batches:
        names = []
        for value in batch.column("block"):
            block = value.as_py()
            if block != last:
                last, rank = block, rank + 1
            names.append((part << 36) + rank)
        uses = batch.column("uses")
        flat = uses.flatten()
        per_row = pa.array(names, pa.int64()).take(pa.compute.list_parent_indices(uses))
        yield pa.RecordBatch.from_arrays(
            [flat.field("key"), flat.field("at"), flat.field("n"), flat.field("sha"), per_row],
            ["key", "at", "n", "sha", "name"],
        )


def identities(rows: DataFrame, block: int = BLOCK, slots: int | None = None) -> DataFrame:
    """``key, level, name, sha`` for ``key, text``: equal (level, name) means equal text.

    One shuffle carries the texts, each block once per task that holds it
    (``HELD`` bytes at a time), to the task that sorts and names it. The levels
    above carry a few bytes per block; every level is written to the shared
    folder, so that a lost executor costs one level at most.
    """
    spark = rows.sparkSession
    slots = slots or 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.mapInArrow(_cut(block, slots), BLOCKS)
    arranged = cut.repartition("slot").sortWithinPartitions("slot", "block")
    named = materialize(arranged.mapInArrow(_name, "key bigint, at int, n int, sha binary, name bigint"), "names-0")
    shas = named.filter("at = 0").select("key", "sha", "n")
    done = named.filter("n = 1").select("key", F.lit(0).alias("level"), "name")
    left = named.filter("n > 1").select("key", "at", "n", "name")
    longest = left.agg(F.max("n")).first()[0] or 1
    level = 0
    while longest > 1:
        level += 1
        half = left.groupBy("key", (F.col("at") / 2).cast("int").alias("at")).agg(
            F.max((F.col("n") + 1) / 2).cast("int").alias("n"),
            F.min(F.struct("at", "name"))["name"].alias("a"),
            F.when(F.count("*") == 2, F.max(F.struct("at", "name"))["name"]).otherwise(F.lit(-1)).alias("b"),
        )
        half = materialize(half, f"pairs-{level}")
        # Different pairs in sorted ranges; the running id names them in order.
        pairs = half.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b")
        names = materialize(pairs.withColumn("name", F.monotonically_increasing_id()), f"names-{level}")
        up = half.join(names, ["a", "b"]).select("key", "at", "n", "name")
        up = materialize(up, f"level-{level}")
        done = done.unionByName(up.filter("n = 1").select("key", F.lit(level).alias("level"), "name"))
        left = up.filter("n > 1")
        longest = (longest + 1) // 2
    return done.join(shas.select("key", "sha"), "key")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key_col: str | None = None
) -> DataFrame:
    """``key, id, keep_id, group_size, kept, text_sha256`` for every row.

    ``key`` is the stored row key ``key_col`` of ``rows.keyed``, for joining
    back; without one, rows are keyed and written here. Texts are
    equal when identical after lower-casing A-Z; null counts as empty, and all
    empty texts are one group. Of a group the row with the largest id stays;
    null ids are smallest, and of rows that share the largest id one stays. A
    text of any length is a row of blocks; an empty table gives an empty
    result.

    Groups are counted before they are joined, so a group of any size is spread
    over tasks; adaptive execution splits its side of the join.
    """
    rows = pick(df, key=key_col, id=id_col, text=text_col) if key_col else keyed(pick(df, id=id_col, text=text_col), "key")
    named = materialize(identities(rows.select("key", "text"), block), "identities")
    owned = named.join(rows.select("key", "id"), "key")
    # Written, so that the join's own exchange carries the rows and a hot group's can be split.
    groups = materialize(
        owned.groupBy("level", "name").agg(F.max(F.struct("id", "key")).alias("best"), F.count("*").alias("group_size")), "groups"
    )
    # Groups of one need no partner; only the rest meet in the join.
    return owned.join(groups, ["level", "name"]).select(
        "key",
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.key") == F.col("key")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
  sha256(body) AS text_sha256
FROM t
"""


@query("op1_exact_dedup", SQL)
def op1_exact_dedup(spark, sf_dir):
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
