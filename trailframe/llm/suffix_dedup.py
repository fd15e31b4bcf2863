"""Repeated passages by suffix arrays.

A byte goes when a string of ``width`` bytes that covers it starts anywhere
else too. To bring equal strings together without a suffix array over the whole
corpus, every such string elects the least-hashed of its short substrings
(``gram`` bytes) as its anchor; equal strings elect equal anchors at the same
place, so strings need comparing only where their anchors are equal:

1. Every text's anchors, each with the stretch of strings that elected it
   (where they start, and a hash of all their bytes), are dealt by the anchor's
   hash. An anchor that occurs once is done. Stretches that occur twice as they
   are repeat as a whole. Equal stretches of a chunk of texts are combined: one
   is dealt, the others are known to repeat and stay behind. An anchor with many
   different stretches in a chunk isn't dealt; such anchors are counted apart.
2. One of each of the other stretches of an anchor meets the others in a task.
   They are lined up at the anchor; columns on which all agree shrink to one
   symbol; a suffix array over these rows of symbols (``suffix_groups``) and its
   common prefixes tell how far each row repeats in another from each place on.
3. Repeated stretches go back to their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import keyed, pick
from trailframe.llm.shingles import mix, powers
from trailframe.llm.suffix_groups import common_prefixes, suffix_array
from trailframe.runtime import materialize

U = np.uint64
# Bytes of a text that are looked at together; texts that are longer go in pieces.
PIECE = 1 << 20
# Anchors that a task packs before it hands them on.
CHUNK = 400_000
DEAL = U(0x6A09E667F3BCC909)
# An anchor with more different stretches in a chunk than this isn't dealt by its hash.
COMMON = 64
# Stretches of one anchor that meet in one suffix array.
MEET = 8192

PACKED = "slot int, kind int, anchors binary"
ANCHOR = np.dtype([("gram", "<u8"), ("body", "<u8"), ("key", "<i8"), ("first", "<i8"), ("at", "<i4"), ("size", "<i4")])


def planes(records: np.ndarray) -> bytes:
    """Records byte plane by byte plane, which Spark's codec shrinks."""
    return np.ascontiguousarray(records).view(np.uint8).reshape(len(records), ANCHOR.itemsize).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(ANCHOR.itemsize, -1).T).view(ANCHOR).ravel()


class Anchors:
    """Anchors of byte strings: who is elected where, and by which strings."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.number = mix(np.arange(256).astype(U) + U(0x9E3779B97F4A7C15))
        self.up, self.down = powers(1 << 16)

    def of(self, data: bytes, key: int) -> np.ndarray:
        """``ANCHOR`` records of a text: hashes of anchor and stretch, where the stretch starts, where the anchor is in it, the stretch's size."""
        found = []
        for at in range(0, max(1, len(data) - self.width + 1), PIECE):
            piece = data[at : at + PIECE + self.width - 1]
            if len(piece) >= self.width:
                found.append(self.piece(piece, key, at))
        return np.concatenate(found) if found else np.zeros(0, ANCHOR)

    def piece(self, data: bytes, key: int, base: int) -> np.ndarray:
        n, g, span = len(data), self.gram, self.width - self.gram + 1
        if n >= len(self.up):
            self.up, self.down = powers(1 << int(n + 1).bit_length())
        total = np.zeros(n + 1, U)
        np.cumsum(self.number[np.frombuffer(data, np.uint8)] * self.up[:n], out=total[1:])
        grams = mix((total[g:] - total[:-g]) * self.down[: n - g + 1])
        # Least hash in each string; of equal ones the first. Places order ties, so equal strings elect alike.
        places = np.arange(len(grams), dtype=U)
        rank = (grams >> U(22) << U(22)) | places
        blocks = -(-len(rank) // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=U)
        padded[: len(rank)] = rank
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = n - self.width + 1
        least = np.minimum(behind[:strings], ahead[span - 1 : span - 1 + strings])
        where = (least & U((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        size = np.diff(first, append=strings) + self.width - 1
        anchor = where[first]
        body = mix((total[first + size] - total[first]) * self.down[first]) ^ mix(((anchor - first).astype(U) << U(32)) | size.astype(U))
        out = np.zeros(len(first), ANCHOR)
        out["gram"], out["body"], out["key"] = grams[anchor], body, key
        out["first"], out["at"], out["size"] = first + base, anchor - first, size
        return out


def changes(numbers: np.ndarray) -> np.ndarray:
    """Where sorted numbers differ from the one before; the first does."""
    return np.diff(numbers, prepend=~numbers[:1]) != 0


def _pack(width: int, gram: int, slots: int):
    """Task function: texts to packed anchors by slot, equal stretches of a chunk combined.

    Kind 1 is dealt by the anchor: one record a stretch, its size negative where
    the chunk holds the stretch again, and a record of size 0 for each anchor of
    kind 2. Kind 0 holds the other records of such stretches, kind 2 those of
    anchors with more than ``COMMON`` different stretches; both go to any slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(width, gram)
        part, seq = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            every = every[np.lexsort((every["body"], every["gram"]))]
            new_gram = changes(every["gram"])
            new_body = new_gram | changes(every["body"])
            first = np.flatnonzero(new_body)
            ones, others = every[first], every[~new_body]
            ones["size"][np.diff(first, append=len(every)) > 1] *= -1
            gram_no = np.cumsum(new_gram[first]) - 1
            crowded = np.bincount(gram_no) > COMMON
            apart = ones[crowded[gram_no]]
            if len(apart):
                marks = np.zeros(int(crowded.sum()), ANCHOR)
                marks["gram"] = ones["gram"][new_gram[first]][crowded]
                ones = np.concatenate([ones[~crowded[gram_no]], marks])
                ones = ones[np.argsort(ones["gram"], kind="stable")]
            # An anchor is elected for its small hash: another one deals them evenly.
            slot = (mix(ones["gram"] ^ DEAL) >> U(32)).astype(np.int64) * slots >> 32
            order = np.argsort(slot, kind="stable")
            ones, slot = ones[order], slot[order]
            cuts = np.searchsorted(slot, np.arange(slots + 1))
            rows = [(s, 1, planes(ones[cuts[s] : cuts[s + 1]])) for s in range(slots) if cuts[s + 1] > cuts[s]]
            rows += [((part * 31 + seq) % slots, kind, planes(records)) for kind, records in ((0, others), (2, apart)) if len(records)]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["slot", "kind", "anchors"])

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for key, text in zip(keys, batch.column("text")):
                found = finder.of((text.as_py() or "").encode(), key)
                if len(found):
                    held.append(found)
                    n += len(found)
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
                    seq += 1
        if held:
            yield flush()

    return run


SHARED = "key bigint, first bigint, at int, size int, gram bigint, body bigint, whole boolean, meets boolean, apart boolean, rows bigint"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over rows sorted by slot: anchors that occur more than once.

    ``whole``: the stretch occurs elsewhere as it is. ``meets``: this row stands
    for its stretch where the anchor has several different ones, ``rows`` of them.
    ``apart``: the anchor isn't judged here, as a chunk holds many stretches of it.
    """

    def rows(e: np.ndarray, whole, meets, apart, n) -> Iterator[pa.RecordBatch]:
        flags = [np.broadcast_to(x, len(e)) for x in (whole, meets, apart, n)]
        for at in range(0, len(e), 50_000):
            part = e[at : at + 50_000]
            columns = [part["key"], part["first"], part["at"], np.abs(part["size"])]
            columns += [np.ascontiguousarray(part[c]).view(np.int64) for c in ("gram", "body")]
            columns += [np.ascontiguousarray(x[at : at + 50_000]) for x in flags]
            yield pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in SHARED.split(", ")], columns)))

    def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(parts)
        marks = every["size"] == 0
        elsewhere = np.unique(every["gram"][marks])
        every = every[~marks] if len(elsewhere) else every
        every = every[np.lexsort((every["first"], every["key"], every["body"], every["gram"]))]
        new_gram = changes(every["gram"])
        new_body = new_gram | changes(every["body"])
        gram_no, body_no = np.cumsum(new_gram) - 1, np.cumsum(new_body) - 1
        whole = (np.bincount(body_no)[body_no] > 1) | np.logical_or.reduceat(every["size"] < 0, np.flatnonzero(new_body))[body_no] if len(every) else marks[:0]
        bodies = np.bincount(gram_no[new_body])[gram_no]
        apart = np.isin(every["gram"], elsewhere) & new_body
        meets = new_body & (bodies > 1) & ~apart
        i = np.flatnonzero(whole | meets | apart)
        yield from rows(every[i], whole[i], meets[i], apart[i], bodies[i].astype(np.int64))

    slot, parts = None, []
    for batch in batches:
        for s, kind, data in zip(*(batch.column(c).to_pylist() for c in ("slot", "kind", "anchors"))):
            found = from_planes(data)
            if kind == 0:
                yield from rows(found, True, False, False, np.int64(0))
                continue
            if kind == 2:
                yield from rows(found, found["size"] < 0, False, True, np.int64(0))
                continue
            if s != slot and parts:
                yield from out(parts)
                parts = []
            slot = s
            parts.append(found)
    if parts:
        yield from out(parts)


def _judge(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of anchors that no task holds whole: those that repeat as they are, and one of each stretch.

    Counts are combined per task and written, so that the joins can split a hot anchor.
    """
    bodies = apart.groupBy("gram", "body").agg(
        F.min(F.struct("key", "first", "at", "size")).alias("one"), ((F.count("*") > 1) | F.max("whole")).alias("twice")
    )
    bodies = materialize(bodies, "apart-stretches")
    grams = materialize(bodies.groupBy("gram").agg(F.count("*").alias("rows")), "apart-anchors")
    again = materialize(bodies.filter("twice").select("gram", "body"), "apart-repeated")
    return apart.join(again, ["gram", "body"]), bodies.join(grams, "gram").filter("rows > 1").select("gram", "one.*", "rows")


def repeats(rows: list[bytes], ats: list[int], width: int) -> list[list[tuple[int, int]]]:
    """Where each row, lined up at its anchor, repeats in another for ``width`` bytes or more.

    Only stretches that line up are looked for: strings that are equal elected
    the same anchor.
    """
    left = max(ats)
    span = left + max(len(r) - a for r, a in zip(rows, ats))
    grid = np.full((len(rows), span), 256, dtype=np.int16)
    for i, (r, a) in enumerate(zip(rows, ats)):
        grid[i, left - a : left - a + len(r)] = np.frombuffer(r, np.uint8)
    agree = (grid == grid[0]).all(axis=0) & (grid[0] < 256)
    # Columns that agree, side by side, are one symbol.
    fresh = ~agree | ~np.concatenate([[False], agree[:-1]])
    begin = np.flatnonzero(fresh)
    bounds = np.append(begin, span)
    code = begin * 257 + np.where(agree[begin], 0, grid[:, begin] + 1)
    here = grid[:, begin] < 256
    # A mark of its own behind every row: no common prefix runs past a row's end.
    text, owner, column = [], [], []
    for i in range(len(rows)):
        mine = np.flatnonzero(here[i])
        text.append(np.append(code[i, mine] + len(rows), i))
        owner.append(np.full(len(mine) + 1, i))
        column.append(np.append(mine, -1))
    flat = np.concatenate(text)
    owner, column = np.concatenate(owner), np.concatenate(column)
    _, names, counts = np.unique(flat, return_inverse=True, return_counts=True)
    # Symbols that occur once, and stretches too short between such ones, repeat nowhere: each run of them is
    # one symbol of its own, so that the array holds little but what does repeat.
    alone = counts[names] == 1
    edges = np.flatnonzero(np.diff(alone, prepend=True, append=True))
    for begin_, end_ in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if bounds[column[end_ - 1] + 1] - bounds[column[begin_]] < width:
            alone[begin_:end_] = True
    if alone.all():
        return [[] for _ in rows]
    keep = np.flatnonzero(~alone | ~np.concatenate([[False], alone[:-1]]))
    names = np.where(alone[keep], len(counts) + keep, names[keep]).tolist()
    owner, column = owner[keep], column[keep]
    order = suffix_array(names)
    shared = common_prefixes(names, order) + [0]
    found: list[list[tuple[int, int]]] = [[] for _ in rows]
    for r, i in enumerate(order):
        most = max(shared[r], shared[r + 1])
        if most:
            c = int(column[i])
            a, b = int(bounds[c]), int(bounds[c + most])
            if b - a >= width:
                own = int(owner[i])
                shift = left - ats[own]
                found[own].append((a - shift, b - shift))
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the bytes of stretches that have to meet."""
    for batch in batches:
        gram, key, first, at, rows, body = [], [], [], [], [], []
        for text, own in zip(batch.column("text"), batch.column("own").to_pylist()):
            data = (text.as_py() or "").encode()
            for x in own:
                gram.append(x["gram"])
                key.append(x["key"])
                first.append(x["first"])
                at.append(x["at"])
                rows.append(x["rows"])
                body.append(data[x["first"] : x["first"] + x["size"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip((gram, key, first, at, rows, body), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
            ["gram", "key", "first", "at", "rows", "body"],
        )


SPANS = "key bigint, start bigint, stop bigint"


def _meet(width: int):
    """Task function over rows sorted by anchor: repeated stretches, as places in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            spans = [
                (key, first + a, first + b)
                for (key, first, _, _), own in zip(held, repeats([h[3] for h in held], [h[2] for h in held], width))
                for a, b in own
            ]
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], ["key", "start", "stop"])

        for batch in batches:
            for gram, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "first", "at", "body"))):
                if gram != at:
                    if len(held) > 1:
                        yield out()
                    at, held = gram, []
                held.append(tuple(row))
        if len(held) > 1:
            yield out()

    return run


def _strings(width: int):
    """Task function: every string of crowded stretches, by its hash and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, names = [], [], []
            for key, first, body in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "body"))):
                for i in range(len(body) - width + 1):
                    keys.append(key)
                    starts.append(first + i)
                    names.append(hashlib.blake2b(body[i : i + width], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(names, pa.binary())], ["key", "start", "name"])

    return run


def repeated_spans(rows: DataFrame, width: int, gram: int, meet: int = MEET) -> DataFrame:
    """``key, start, stop`` of repeated stretches, overlapping ones among them, for ``key, text``."""
    spark = rows.sparkSession
    slots = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.mapInArrow(_pack(width, gram, slots), PACKED)
    shared = materialize(packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(_match, SHARED), "shared-anchors")
    whole, meets = shared.filter("whole AND NOT apart"), shared.filter("meets").select("gram", "key", "first", "at", "size", "rows")
    apart = shared.filter("apart")
    if not apart.isEmpty():
        repeated, ones = _judge(apart)
        whole = whole.select("key", "first", "size").unionByName(repeated.select("key", "first", "size"))
        meets = materialize(meets.unionByName(ones), "meets")
    whole = whole.select("key", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))
    # A text's own anchors are as many as its length allows; they come to it by key.
    meeting = meets.groupBy("key").agg(F.collect_list(F.struct("gram", "key", "first", "at", "size", "rows")).alias("own"))
    bodies = rows.join(meeting, "key").select("text", "own").mapInArrow(_cut, "gram bigint, key bigint, first bigint, at int, rows bigint, body binary")
    arranged = bodies.filter(F.col("rows") <= meet).repartition("gram").sortWithinPartitions("gram", "body")
    spans = whole.unionByName(materialize(arranged.mapInArrow(_meet(width), SPANS), "met"))
    if not meets.filter(F.col("rows") > meet).isEmpty():
        # Anchors with more different stretches than one array takes: their strings are counted one by one, spread over tasks.
        strings = materialize(bodies.filter(F.col("rows") > meet).mapInArrow(_strings(width), "key bigint, start bigint, name binary"), "strings")
        # Written, so that the join can split a string that many stretches share.
        twice = materialize(strings.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "repeated-strings")
        spans = spans.unionByName(strings.join(twice, "name").select("key", "start", (F.col("start") + width).alias("stop")))
    return spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: texts without their repeated bytes."""
    for batch in batches:
        out = []
        for key, text, own in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
            data = (text.as_py() or "").encode()
            runs: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in own or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((key, len(data), len(data) - len(kept), [{"start": a, "stop": b} for a, b in runs], kept))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), spans, pa.binary())
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["key", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 64) -> DataFrame:
    """``key, id, n_bytes, n_removed, removed, kept_bytes`` for every row.

    Texts are UTF-8 bytes, null counts as empty, and no string spans two rows.
    ``removed`` holds the maximal removed runs (start, stop), ``kept_bytes`` the
    rest, joined; cuts may fall inside a character. Repeated rows repeat each
    other and lose everything from ``width`` bytes on; shorter texts lose
    nothing; null ids are rows like others; an empty table gives an empty
    result. ``key`` is a row key of ``rows.keyed``. Strings are judged on the
    input.

    Whole stretches are compared by 128 bits of hash, others byte by byte.
    """
    rows = keyed(pick(df, id=id_col, text=text_col), "key")
    spans = repeated_spans(rows.select("key", "text"), width, gram).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    done = rows.join(spans, "key", "left")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"key bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept_bytes binary, id {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for found in _remove([part]):
                    yield pa.RecordBatch.from_arrays([*found.columns, part.column("id")], ["key", "n_bytes", "n_removed", "removed", "kept_bytes", "id"])

    return done.select("key", "id", "text", "spans").mapInArrow(run, schema)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
