"""Phrases whose words stand together more often than they would by chance.

Counting goes by partitions. A task cuts its texts into shards of bounded size
and mines each shard completely: every phrase with at least the shard's share
of the support, rounded up. What is frequent in the whole is frequent in some
shard, so the union of what the shards found holds every frequent phrase. The
union is taken by hash, in slots, and drops what can't reach the support even
if every shard that didn't name it had held it just below its local bound. At
last all candidates are counted in the texts exactly, by their words.

The candidates' hashes reach that last count as a filter of bits in the shared
folder: 16 bits a candidate, at most ``FILTER_BITS`` in all. A hash that agrees
by chance, or a full filter, costs work but no exactness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.alignment import planes, unplane
from trailframe.llm.base import query, table
from trailframe.llm.rows import UPPER, pick
from trailframe.llm.shingles import mix, powers
from trailframe.llm.store import give_back, open_store
from trailframe.llm.tokens import worker_cache
from trailframe.runtime import materialize, scratch_path

U = np.uint64
BLANKS, CUTS = b" \t", b".,;:!?\n\v\f\r"
# Bytes of text to a shard, to a step inside it or of the last count, and to a slot of the union.
# A byte takes some fifty bytes while its step is read.
SHARD, STEP, SLOT = 8 << 20, 1 << 20, 16 << 20
# Rows of counted phrases that a task adds up before it hands them on.
HELD = 300_000
FILTER_BITS = 1 << 30
# Parts that a language's candidates are ranked in before the parts' best are.
PARTS = 64

FOUND = "slot int, slack int, hashes binary, several binary, counts binary"


def slotted(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Slot (upper half) and 32 bits of the hash within it: rises with the hash."""
    return ((hashes >> U(20)) * U(slots)) >> U(12)


def steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Languages, bytes and ends of texts, about ``size`` bytes at a time and one text at least."""
    langs, texts, held = [], [], 0

    def take() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        body = pa.concat_arrays(texts)
        ends = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1)
        data = np.frombuffer(body.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
        return pa.concat_arrays(langs), data, ends - ends[0]

    for batch in batches:
        lang = batch.column("lang").cast(pa.string()).fill_null("und")
        text = batch.column("text").fill_null("").cast(pa.large_binary())
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(total, total[at] + size - held, "right")) - 1)
            langs.append(lang.slice(at, to - at))
            texts.append(pc.take(text, pa.array(np.arange(at, to))))
            held += int(total[to] - total[at])
            at = to
            if held >= size or at < len(sizes):
                yield take()
                langs, texts, held = [], [], 0
    if texts:
        yield take()


class Words:
    """The words of some texts: where they stand, in which piece, their language and hash."""

    def __init__(self):
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(BLANKS)] = 1
        self.kind[list(CUTS)] = 2
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[list(UPPER.encode())] += 32
        self.number = mix(np.arange(256).astype(U) + U(0x51ED270B7A3C2B15))
        self.up, self.down = powers(1 << 16)

    def read(self, langs: pa.Array, data: np.ndarray, ends: np.ndarray) -> Words:
        if len(data) > len(self.up):
            self.up, self.down = powers(1 << int(len(data)).bit_length())
        self.data = self.lower[data]
        kind = self.kind[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.begin = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        doc = np.searchsorted(ends, self.begin, "right") - 1
        # Grows at every cut and at every text.
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.begin] + doc
        total = np.zeros(len(data) + 1, U)
        np.cumsum(self.number[self.data] * self.up[: len(data)], out=total[1:])
        self.word = mix((total[self.end] - total[self.begin]) * self.down[self.begin] + (self.end - self.begin).astype(U))
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[doc]
        salt = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") for name in self.langs]
        self.salt = np.array(salt, U)[self.lang] if len(self.lang) else np.zeros(0, U)
        return self

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per number of words: the first words' places and the phrases' hashes, which tell languages apart."""
        part = self.salt
        for k in range(1, longest + 1):
            n = max(0, len(self.word) - k + 1)
            part = mix(part[:n] * U(0x100000001B3) + self.word[k - 1 :][:n])
            at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :][:n])
            yield k, at, mix(part[at] + U(k))


def _totals(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes and the sums of their counts."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    firsts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    return hashes[firsts], np.add.reduceat(counts[order].astype(np.int64), firsts) if len(firsts) else np.zeros(0, np.int64)


def _mine(support: int, longest: int, total: int, slots: int, shard: int):
    """Task function: the phrases that are frequent in each shard, by slot."""
    kind = np.dtype("<u1" if support < 256 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A filter that an earlier run left in this worker.
        worker_cache().pop("phrase filter", None)
        words, held, size = Words(), [], 0

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(slotted(np.concatenate([np.zeros(0, U), *held]), slots), return_counts=True)
            # The shard's share of the support: shares add up to the support, so no frequent phrase is below it everywhere.
            least = max(1, -(-support * size // total))
            frequent = counts >= least
            found, counts = found[frequent], np.minimum(counts[frequent], support).astype(kind)
            cuts = np.searchsorted(found, np.arange(slots + 1).astype(U) << U(32)).tolist()
            within, several = found.astype("<u4"), counts > 1
            rows = [
                (
                    slot,
                    least - 1,
                    planes(np.diff(within[a:b], prepend=within.dtype.type(0))),
                    np.packbits(several[a:b]).tobytes(),
                    counts[a:b][several[a:b]].tobytes(),
                )
                for slot, (a, b) in enumerate(zip(cuts, cuts[1:]))
            ]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["slot", "slack", "hashes", "several", "counts"])

        for langs, data, ends in steps(batches, min(STEP, shard)):
            held += [h for _, _, h in words.read(langs, data, ends).phrases(longest)]
            size += len(data)
            if size >= shard:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        held.clear()
        give_back()

    return run


def _unite(support: int):
    """Task function: of sorted slots, the hashes that may reach the support."""
    kind = np.dtype("<u1" if support < 256 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(slot: int, parts: list) -> pa.RecordBatch:
            slack, hashes, counts = sum(p[0] for p in parts), [], []
            for own, h, several, c in parts:
                hashes.append(np.cumsum(unplane(h, "<u4"), dtype=np.uint32))
                n = np.ones(len(hashes[-1]), np.int32)
                n[np.unpackbits(np.frombuffer(several, np.uint8), count=len(n)).astype(bool)] = np.frombuffer(c, kind)
                # A shard that names a phrase adds its count; each other one may hold up to its slack of it.
                counts.append(n - own)
            found, known = _totals(np.concatenate(hashes), np.concatenate(counts))
            kept = found[known + slack >= support]
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([kept.tobytes()], pa.binary())], ["slot", "hashes"])

        last, parts = None, []
        for batch in batches:
            for slot, slack, *own in zip(*(batch.column(n) for n in ("slot", "slack", "hashes", "several", "counts"))):
                if parts and slot.as_py() != last:
                    yield judge(last, parts)
                    parts = []
                last = slot.as_py()
                parts.append((slack.as_py(), *[x.as_py() for x in own]))
        if parts:
            yield judge(last, parts)
        parts.clear()
        give_back()

    return run


def _segments(bits: int):
    """Task function: a slot's candidates as ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h in batch.column("hashes"):
                marks = np.zeros(bits, np.uint8)
                marks[np.frombuffer(h.as_py(), "<u4") & np.uint32(bits - 1)] = 1
                out.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(out, pa.binary())], ["slot", "bits"])

    return run


class Filter:
    """Bits of all slots, read once a worker."""

    def __init__(self, path: str, slots: int, bits: int):
        store, where = open_store(path)
        self.slots, self.bits = slots, bits
        self.marks = np.zeros(slots * bits // 8, np.uint8)
        for batch in pq.ParquetDataset(where, filesystem=store).read(["slot", "bits"]).to_batches():
            for slot, part in zip(batch.column("slot").to_pylist(), batch.column("bits")):
                self.marks[slot * bits // 8 : (slot + 1) * bits // 8] = np.frombuffer(part.as_buffer(), np.uint8)

    @classmethod
    def of(cls, path: str, slots: int, bits: int) -> Filter:
        kept = worker_cache()
        if kept.get("phrase filter", ("", None))[0] != path:
            kept["phrase filter"] = (path, cls(path, slots, bits))
        return kept["phrase filter"][1]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        key = slotted(hashes, self.slots)
        at = (key >> U(32)) * U(self.bits) + (key & U(self.bits - 1))
        return (self.marks[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _count(longest: int, path: str, slots: int, bits: int):
    """Task function: how often each phrase that the filter admits occurs, by its words; size 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, words = Filter.of(path, slots, bits), Words()
        # Parts of the sums on their way to the JVM are views of one table.
        part = 20_000
        held: list[pa.RecordBatch] = []

        def flush() -> list[pa.RecordBatch]:
            summed = pa.Table.from_batches(held).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("f", "sum")])
            held.clear()
            summed = summed.rename_columns(["lang", "size", "phrase", "f"]).combine_chunks()
            return summed.to_batches(max_chunksize=part)

        for langs, data, ends in steps(batches, STEP):
            words.read(langs, data, ends)
            if not len(words.word):
                continue
            names = pa.array(words.langs, pa.string())
            # Different words, told apart by their bytes.
            sizes = words.end - words.begin
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = words.data[np.repeat(words.begin - starts[:-1], sizes) + np.arange(starts[-1])]
            body = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(flat)])
            coded = body.dictionary_encode()
            ids, different = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)

            def rows(size: int, lang: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang)), pa.array(np.full(len(n), size), pa.int32()), phrase, pa.array(n, pa.int64())],
                    ["lang", "size", "phrase", "f"],
                )

            everything = np.bincount(words.lang, minlength=len(words.langs))
            held.append(rows(0, np.arange(len(everything)), pa.array([""] * len(everything), pa.string()), everything))
            for k, at, hashes in words.phrases(longest):
                at = at[wanted.has(hashes)]
                # Number each phrase by number of its head and last word; numbers stay below the square of the words.
                code = words.lang[at].astype(np.int64)
                for i in range(k):
                    code = np.unique(code * different + ids[at + i], return_inverse=True)[1] if i else code * different + ids[at]
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                first = at[first]
                parts = [coded.dictionary.take(pa.array(ids[first + i])) for i in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                held.append(rows(k, words.lang[first], phrase.cast(pa.binary()).cast(pa.string()), n))
            if sum(b.num_rows for b in held) >= HELD:
                yield from flush()
        if held:
            yield from flush()
        give_back()

    return run


def frequent_phrases(docs: DataFrame, support: int, longest: int, shard: int = SHARD) -> DataFrame:
    """``lang, size, phrase, f`` of every phrase of 1 to ``longest`` words with ``f >= support``; size 0 is the language's words.

    ``docs`` has ``lang`` and ``text``.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLOT))
    mined = docs.mapInArrow(_mine(support, longest, total, slots, shard), FOUND)
    arranged = mined.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot")
    candidates = materialize(arranged.mapInArrow(_unite(support), "slot int, hashes binary"), "phrase-hashes")
    n = candidates.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    # Bits of a slot: a power of two, at least 16 a candidate while the filter is below its bound.
    bits = 64
    while bits * slots < 4 * n and 2 * bits * slots <= FILTER_BITS:
        bits *= 2
    path = scratch_path(spark, "phrase-filter")
    candidates.mapInArrow(_segments(bits), "slot int, bits binary").write.parquet(path)
    counted = docs.mapInArrow(_count(longest, path, slots, bits), "lang string, size int, phrase string, f bigint")
    sums = counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return materialize(sums.filter((F.col("size") == 0) | (F.col("f") >= support)), "phrases")


def collocations(
    df: DataFrame,
    support: int = 10,
    longest: int = 3,
    inside: int = 50,
    most: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    shard: int = SHARD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``most`` best phrases of every language.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and
    into words at blanks and tabs. ``a`` counts the phrase's occurrences, ``l``
    and ``r`` those of the two parts of its weakest cut, ``n`` the language's
    words. Candidates have two to ``longest`` words and ``a >= support``; one
    that lies inside a longer candidate with at least ``inside`` percent of its
    occurrences is left out.

    Null text has no words, null language is ``und``; repeated rows count again;
    further columns don't matter; an empty table, or a language without
    candidates, gives no rows. A text is held whole by its task, at about
    twenty bytes a byte.
    """
    counts = frequent_phrases(pick(df, lang=lang_col, text=text_col), support, longest, shard)
    phrases = counts.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    known = counts.filter("size >= 1").select("lang", F.col("phrase").alias("part"), "f")

    def stretch(first, n):
        return F.array_join(F.slice("words", first, n), " ")

    spelled = phrases.withColumn("words", F.split("phrase", " "))
    ends = F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(0).alias("side"), stretch(F.lit(1), k).alias("part")),
            F.struct(k.alias("k"), F.lit(1).alias("side"), stretch(k + 1, F.col("size") - k).alias("part")),
        ),
    )
    asked = spelled.select("lang", "phrase", "size", "a", F.explode(F.flatten(ends)).alias("p")).select("lang", "phrase", "size", "a", "p.k", "p.side", "p.part")
    cuts = (
        asked.join(known, ["lang", "part"])
        .groupBy("lang", "phrase", "size", "a", "k")
        .agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    )

    def wide(name):
        return F.col(name).cast("decimal(18,0)")

    # At most 10**6, as no part occurs less often than the phrase; the products need up to 128 bits.
    square = (wide("a") * wide("a")).cast("decimal(30,0)") * F.lit(1000000).cast("decimal(7,0)")
    score = F.call_function("div", square, wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    shorter = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: stretch(i, n)),
        )
    )
    within = spelled.filter("size > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    flat = left.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))
    return _ranked(flat, most).join(counts.filter("size = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """The best of every language: first of its parts, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = rows.withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= most).drop("part")


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM s GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS j FROM c),
scored AS (
  SELECT cut.lang, cut.k, cut.phrase, cut.a, j, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * cut.a * cut.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:j], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[j + 1:cut.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM kept k JOIN n ON n.lang = k.lang
QUALIFY rank <= 2000
"""


@query("op11_phrases", SQL)
def op11_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
