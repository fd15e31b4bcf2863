"""Set-similarity join of word n-grams over prefix trees.

1. Every text becomes its set of n-grams. The sets of some thousand texts are
   packed together, n-grams sorted, and dealt by n-gram; each task learns in how
   many texts an n-gram occurs and sends back those that occur more than once.
2. A text whose n-grams mostly occur nowhere else can't have a partner. The
   others hold their shared n-grams in one global order, rarest first.
3. Texts that share their first n-grams by hash meet in one task, which keeps
   their ordered sets in a prefix tree: a probe walks it with the overlap so
   far, and leaves a subtree when lengths rule out what is missing, or when all
   below is linked to it already. Links become components.
4. Partners must share an n-gram of their prefixes. Where a prefix n-gram still
   joins different components, their sets meet once more, in blocks. So no link
   between components is missed, and a component of thousands of near copies
   costs links in proportion to its members, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.components import components
from trailframe.llm.rows import pick, with_key
from trailframe.llm.shingles import Shingler, mix
from trailframe.llm.store import give_back
from trailframe.runtime import materialize

U = np.uint64
# Bits of a document's number in its chunk, and of an n-gram beside it.
DOC_BITS, GRAM_BITS = 12, 48
CHUNK_GRAMS = 2 << 20
# An n-gram in more of a chunk's documents than this is sent as a count.
COMMON = 64
# Sets that one task holds in a tree.
BLOCK = 2048

PACKED = "slot int, kind int, chunk bigint, grams binary, more binary, docs array<struct<key:bigint,id:bigint,n:bigint,digest:binary>>"
DOCS = pa.list_(pa.struct([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))
SETS = "key bigint, id bigint, n bigint, digest binary, shared int, prefix int, grams binary"


def pack(sorted_numbers: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte plane by byte plane: high planes are mostly zeros, which Spark's codec shrinks."""
    gaps = np.diff(sorted_numbers, prepend=U(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def fewest(n, percent: int):
    """The least overlap with any partner of a set of ``n``."""
    return -(-n * percent // 100)


def _chunks(words: int, slots: int):
    """Task function: texts to packed n-grams by slot, and a header for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        part, seq = TaskContext.get().partitionId(), 0
        docs, numbers, seen, held = [], [], set(), 0

        def flush() -> pa.RecordBatch:
            chunk = (part << 24) + seq
            entries = np.sort(np.concatenate(numbers)) if numbers else np.zeros(0, U)
            grams = entries >> U(DOC_BITS)
            # Runs of one n-gram over many documents go as a count; the documents stay in the header.
            first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0) if len(grams) else np.zeros(0, np.int64)
            count = np.diff(first, append=len(grams))
            common = np.repeat(count > COMMON, count)
            kept, kept_grams = entries[~common], grams[~common]
            heavy = count > COMMON
            top, sizes = grams[first[heavy]], count[heavy].astype(U)
            bounds = np.array([(s << GRAM_BITS) // slots for s in range(slots + 1)], dtype=U)
            cuts, tops = np.searchsorted(kept_grams, bounds), np.searchsorted(top, bounds)
            rows = [(chunk % slots, 0, chunk, pack(entries[common]), b"", docs)]
            for s in range(slots):
                a, b, c, d = cuts[s], cuts[s + 1], tops[s], tops[s + 1]
                if b > a or d > c:
                    rows.append((s, 1, chunk, pack(kept[a:b]), top[c:d].tobytes() + sizes[c:d].tobytes(), None))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), DOCS)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["slot", "kind", "chunk", "grams", "more", "docs"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                sets = shingler.sets(piece.column("text"))
                for key, name, grams in zip(piece.column("key").to_pylist(), piece.column("id").to_pylist(), sets):
                    digest = None
                    if len(grams):
                        sums = (int(mix(grams + U(1)).sum(dtype=U)), int(mix(grams ^ U(0x5DEECE66D)).sum(dtype=U)))
                        digest = b"".join(x.to_bytes(8, "big") for x in sums)
                    number = len(docs)
                    docs.append({"key": key, "id": name, "n": len(grams), "digest": digest})
                    if digest is not None and digest not in seen:
                        seen.add(digest)
                        numbers.append(((grams >> U(64 - GRAM_BITS)) << U(DOC_BITS)) | U(number))
                        held += len(grams)
                    if held >= CHUNK_GRAMS or len(docs) == 1 << DOC_BITS:
                        yield flush()
                        docs, numbers, seen, held = [], [], set(), 0
                        seq += 1
        if docs:
            yield flush()
        docs, numbers = [], []
        give_back()

    return run


def _answer(slot_rows: list[tuple]) -> Iterator[tuple]:
    """Per chunk of one slot: its n-grams that occur in several documents, with the log of how many."""
    kept = [unpack(r[1]) for r in slot_rows]
    tops = [np.frombuffer(r[2], U).reshape(2, -1) for r in slot_rows]
    grams = np.concatenate([k >> U(DOC_BITS) for k in kept] + [t[0] for t in tops])
    weight = np.concatenate([np.ones(sum(map(len, kept)), U)] + [t[1] for t in tops])
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]) != 0) if len(ranked) else np.zeros(0, np.int64)
    totals = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, U)
    spread = np.empty(len(grams), U)
    spread[order] = np.repeat(totals, np.diff(first, append=len(ranked)))
    tier = np.log2(np.maximum(spread.astype(np.float64), 1)).astype(np.uint8)
    at = 0
    answers = []
    for k in kept:
        mask = spread[at : at + len(k)] > 1
        answers.append((k[mask], tier[at : at + len(k)][mask]))
        at += len(k)
    for (chunk, _, _), (entries, tiers), t in zip(slot_rows, answers, tops):
        own = tier[at : at + t.shape[1]]
        at += t.shape[1]
        if len(entries) or t.shape[1]:
            yield chunk, pack(entries) if len(entries) else b"", tiers.tobytes(), t[0].tobytes(), own.tobytes()


REPLY = "chunk bigint, kind int, grams binary, tiers binary, tops binary, top_tiers binary, docs array<struct<key:bigint,id:bigint,n:bigint,digest:binary>>"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over rows sorted by slot: headers pass, n-grams get their answers."""
    names = [c.split()[0] for c in REPLY.split(", ")]
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4, DOCS)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    slot, rows = None, []
    for batch in batches:
        heads = []
        for s, kind, chunk, grams, more, docs in zip(*(batch.column(c).to_pylist() for c in ("slot", "kind", "chunk", "grams", "more", "docs"))):
            if kind == 0:
                heads.append((chunk, 0, grams, b"", b"", b"", docs))
                continue
            if s != slot and rows:
                answers = [(c, 1, g, t, p, q, None) for c, g, t, p, q in _answer(rows)]
                rows = []
                if answers:
                    yield out(answers)
            slot = s
            rows.append((chunk, grams, more))
        if heads:
            yield out(heads)
    if rows:
        answers = [(c, 1, g, t, p, q, None) for c, g, t, p, q in _answer(rows)]
        if answers:
            yield out(answers)
    rows = answers = []
    give_back()


def _ordered_sets(percent: int):
    """Task function over rows sorted by chunk: documents with their shared n-grams in global order."""

    def of_chunk(docs: list[dict], common: np.ndarray, replies: list[tuple]) -> list[tuple]:
        rank_of = {}
        for _, _, tops, tiers in replies:
            rank_of.update(zip(np.frombuffer(tops, U).tolist(), np.frombuffer(tiers, np.uint8).tolist()))
        entries = [unpack(g) for g, _, _, _ in replies if g] + [common]
        tiers = [np.frombuffer(t, np.uint8) for g, t, _, _ in replies if g]
        tiers.append(np.array([rank_of[g] for g in (common >> U(DOC_BITS)).tolist()], dtype=np.uint8))
        entry, tier = np.concatenate(entries), np.concatenate(tiers).astype(U)
        number = (entry & U((1 << DOC_BITS) - 1)).astype(np.int64)
        rank = (tier << U(GRAM_BITS)) | (entry >> U(DOC_BITS))
        order = np.lexsort((rank, number))
        number, rank = number[order], rank[order]
        cuts = np.searchsorted(number, np.arange(len(docs) + 1))
        rows = []
        for i, d in enumerate(docs):
            grams = rank[cuts[i] : cuts[i + 1]]
            need = fewest(d["n"], percent)
            # In global order come the n-grams of one text first: the prefix is what is left of it beyond them.
            prefix = len(grams) - need + 1
            able = d["n"] > 0 and prefix > 0
            rows.append((d["key"], d["id"], d["n"], d["digest"], len(grams), prefix if able else 0, pack(grams) if able else None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        names = [c.split()[0] for c in SETS.split(", ")]
        at, docs, common, replies = None, None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            rows = of_chunk(docs, common, replies)
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows[i : i + 512]), kinds)], names)

        for batch in batches:
            for chunk, kind, grams, tiers, tops, top_tiers, d in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "grams", "tiers", "tops", "top_tiers", "docs"))):
                if chunk != at and at is not None:
                    yield from out()
                    replies = []
                at = chunk
                if kind == 0:
                    docs, common = d, unpack(grams) if grams else np.zeros(0, U)
                else:
                    replies.append((grams, tiers, tops, top_tiers))
        if at is not None:
            yield from out()
        docs, replies = None, []
        give_back()

    return run


class Node:
    """A stretch of n-grams that all sets below share."""

    __slots__ = ("run", "kids", "ends", "below", "least", "most", "one")

    def __init__(self, run: np.ndarray, kids: dict, ends: list, below: int, least: int, most: int, one: int | None):
        self.run, self.kids, self.ends, self.below, self.least, self.most, self.one = run, kids, ends, below, least, most, one


class Tree:
    """A prefix tree of ordered sets, with union-find over the sets put in."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = Node(np.zeros(0, U), {}, [], 0, 1 << 62, 0, None)
        self.sizes: list[int] = []
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def settled(self, node: Node, me: int) -> bool:
        """Is all below ``node`` in one component with ``me``?"""
        if node.one is None:
            ones = {self.find(k.one) if k.one is not None else None for k in node.kids.values()} | {self.find(e) for e in node.ends}
            if len(ones) != 1 or None in ones:
                return False
            node.one = ones.pop()
        return self.find(node.one) == self.find(me)

    def probe(self, grams: np.ndarray, size: int, me: int) -> None:
        """Link ``me`` to every component with a partner of it."""
        percent = self.percent
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            if self.settled(node, me):
                continue
            # Lengths: the sizes below, then what can still overlap.
            if node.most * 100 < percent * size or node.least * percent > size * 100:
                continue
            if len(node.run):
                found = np.searchsorted(grams, node.run)
                inside = found < len(grams)
                overlap += int((grams[found[inside]] == node.run[inside]).sum())
                at = int(np.searchsorted(grams, node.run[-1], "right"))
            need = -(-percent * (size + max(node.least, fewest(size, percent))) // (100 + percent))
            if overlap + min(len(grams) - at, node.below) < need:
                continue
            for other in node.ends:
                union = size + self.sizes[other] - overlap
                if 100 * overlap >= percent * union and self.join(me, other):
                    self.links.append((me, other))
            stack.extend((kid, at, overlap) for kid in node.kids.values())

    def add(self, grams: np.ndarray, size: int, component: int | None = None) -> int:
        """Probe, then insert. Sets of one known ``component`` (an earlier set's number) aren't compared."""
        me = len(self.sizes)
        self.sizes.append(size)
        self.parent.append(me)
        if component is not None:
            self.join(me, component)
        if len(self.root.kids) or self.root.ends:
            self.probe(grams, size, me)
        self.insert(grams, size, me)
        return me

    def insert(self, grams: np.ndarray, size: int, me: int) -> None:
        node, at = self.root, 0
        while True:
            # Below the end of this node's run.
            node.below = max(node.below, len(grams) - at)
            node.least, node.most = min(node.least, size), max(node.most, size)
            fresh = not node.kids and not node.ends
            node.one = me if fresh else (node.one if node.one is not None and self.find(node.one) == self.find(me) else None)
            if at == len(grams):
                node.ends.append(me)
                return
            first = int(grams[at])
            kid = node.kids.get(first)
            if kid is None:
                node.kids[first] = Node(grams[at:], {}, [me], 0, size, size, me)
                return
            rest = grams[at : at + len(kid.run)]
            same = kid.run[: len(rest)] == rest
            k = len(rest) if same.all() else int(np.argmin(same))
            if k < len(kid.run):
                # Split: the shared part becomes a node of its own.
                upper = Node(kid.run[:k], {int(kid.run[k]): kid}, [], kid.below + len(kid.run) - k, kid.least, kid.most, kid.one)
                kid.run = kid.run[k:]
                node.kids[first] = upper
                kid = upper
            node, at = kid, at + k


def _tree_links(percent: int):
    """Task function over rows sorted by group: links between sets of one group."""

    def of_group(rows: list[tuple]) -> list[tuple]:
        tree, known, names = Tree(percent), {}, []
        for comp, n, digest, grams in sorted(rows, key=lambda r: (r[1], r[2])):
            me = tree.add(unpack(grams), n, known.get(comp) if comp is not None else None)
            if comp is not None:
                known.setdefault(comp, me)
            names.append(digest)
        return [(names[a], names[b]) for a, b in tree.links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, seen = None, [], set()

        def out() -> pa.RecordBatch:
            links = of_group(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for grp, comp, n, digest, grams in zip(*(batch.column(c).to_pylist() for c in ("grp", "comp", "n", "digest", "grams"))):
                if grp != at:
                    if len(rows) > 1:
                        yield out()
                    at, rows, seen = grp, [], set()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((comp, n, digest, grams))
        if len(rows) > 1:
            yield out()
        rows = []
        give_back()

    return run


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: each set's two least n-grams by two hashes."""
    for batch in batches:
        homes = []
        for grams in batch.column("grams").to_pylist():
            plain = unpack(grams) & U((1 << GRAM_BITS) - 1)
            homes.append([int(mix(plain ^ U(salt)).min() >> U(1)) for salt in (0x1234567, 0x89ABCDEF)])
        yield batch.append_column("homes", pa.array(homes, pa.list_(pa.int64())))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: each set's prefix n-grams."""
    for batch in batches:
        grams = [unpack(g)[:p].astype(np.int64) for g, p in zip(batch.column("grams").to_pylist(), batch.column("prefix").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("n"), pa.array(grams, pa.list_(pa.int64()))], ["digest", "n", "prefix"]
        )


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """Links among sets that share ``grp``."""
    arranged = rows.select("grp", "comp", "n", "digest", "grams").repartition("grp").sortWithinPartitions("grp", "n", "digest")
    return arranged.mapInArrow(_tree_links(percent), "a binary, b binary")


def ngram_sets(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``SETS`` for ``key, id, text``, written to the shared folder; ``grams`` only where a partner is possible."""
    spark = rows.sparkSession
    slots = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.mapInArrow(_chunks(words, slots), PACKED)
    replies = packed.repartition("slot").sortWithinPartitions("slot", "kind").mapInArrow(_frequencies, REPLY)
    chunks = replies.repartition("chunk").sortWithinPartitions("chunk", "kind")
    return materialize(chunks.mapInArrow(_ordered_sets(percent), SETS), "gram-sets")


def ngram_links(sets: DataFrame, percent: int) -> DataFrame:
    """``node, root`` over digests of different sets: classes of sets that links connect."""
    able = sets.filter("grams IS NOT NULL").select("n", "digest", "prefix", "grams")
    # Homes: sets that are alike mostly share their least n-gram; crowded homes are dealt into blocks.
    at_home = able.mapInArrow(_homes, "n bigint, digest binary, prefix int, grams binary, homes array<bigint>")
    spread = at_home.select("n", "digest", "grams", F.posexplode("homes").alias("turn", "home"))
    crowds = materialize(
        spread.groupBy("turn", "home").agg(F.count("*").alias("n_home")).filter(F.col("n_home") > BLOCK), "crowded-homes"
    )
    dealt = spread.join(crowds, ["turn", "home"], "left").withColumn(
        "block", F.pmod(F.xxhash64("digest", "turn"), F.ceil(F.coalesce("n_home", F.lit(1)) / BLOCK))
    )
    near = _meet(dealt.select(F.struct("turn", "home", "block").cast("string").alias("grp"), F.lit(None).cast("binary").alias("comp"), "n", "digest", "grams"), percent)
    links = materialize(near, "near-links")
    found = materialize(components(links), "near-classes")
    # What prefixes still join different classes.
    prefixed = able.mapInArrow(_prefixes, "digest binary, n bigint, prefix array<bigint>").dropDuplicates(["digest"])
    classed = prefixed.join(found.withColumnRenamed("node", "digest"), "digest", "left")
    postings = materialize(
        classed.select("digest", "n", F.coalesce("root", "digest").alias("comp"), F.explode("prefix").alias("gram")), "postings"
    )
    groups = postings.groupBy("gram").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("who"),
        F.min("comp").alias("c1"), F.max("comp").alias("c2"),
    ).filter("c1 <> c2")
    # N-grams of the same members tell the same: one of them is enough.
    groups = materialize(groups.groupBy("who", "members").agg(F.min("gram").alias("gram")).select("gram", "members"), "open-groups")
    if groups.isEmpty():
        return found
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    # Members of a crowded n-gram meet block by block, each pair of blocks once.
    met = postings.join(groups, "gram").withColumn("blocks", blocks).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        F.struct("gram", F.least("mine", "other"), F.greatest("mine", "other")).cast("string").alias("grp"), "comp", "digest"
    )
    again = met.join(able.select("n", "digest", "grams").dropDuplicates(["digest"]), "digest")
    more = materialize(_meet(again, percent), "more-links")
    return components(links.unionByName(more))


def ngram_jaccard(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    key_col: str | None = None,
) -> DataFrame:
    """``key, id, n_shingles, component_id, kept`` for every row.

    ``key`` is the stored row key ``key_col`` of ``rows.keyed``, for joining
    back; without one, rows are numbered once, here. Two rows link
    when ``100 * intersection >= percent * union`` of their sets of ``words``
    lower-cased words; a component is named by its smallest id, and one row with
    that id is ``kept``. Null and empty
    texts, and texts without words, have an empty set, link with nothing and are
    components of their own; equal sets always link; null ids are passed over
    in a component's name (a component of null ids only has a null name);
    repeated rows link; an empty table gives an empty result. Ids must be
    integers.

    No partner or candidate is dropped: n-grams are compared by 48 bits within
    pairs that share a prefix, sets by 128 bits.
    """
    rows = pick(df, key=key_col, id=id_col, text=text_col) if key_col else with_key(pick(df, id=id_col, text=text_col), "key")
    sets = ngram_sets(rows.select("key", F.col("id").cast("bigint").alias("id"), "text"), words, percent)
    classes = ngram_links(sets, percent).withColumnRenamed("node", "digest")
    owned = materialize(
        sets.select("key", "id", "n", "digest").join(classes, "digest", "left")
        .select("key", "id", "n", F.coalesce("root", "digest").alias("root")),
        "gram-classes",
    )
    # Names are counted before they are joined: a class of any size stays spread.
    names = materialize(
        owned.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")), "class-names"
    )
    return owned.join(names, "root", "left").select(
        "key", "id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (F.col("root").isNull() | (F.col("best.key") == F.col("key"))).alias("kept"),
    )


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    found = ngram_jaccard(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
