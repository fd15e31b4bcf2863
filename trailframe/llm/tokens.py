"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents end to end, 2 or 4 bytes each,
and where each document ends as an Elias-Fano sequence: the low bits of every
end as they are, the high bits in unary, about 2 + log2(ids per document) bits
a document. A sample of the unary part's ones makes "where does document i
end" a short scan. Document ids, ascending too, are held the same way.

File: ``TFEF`` magic, version, id width, then counts and the parts' lengths as
64-bit numbers (``HEADER``), then ends, document ids, token ids.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import pick, with_key
from trailframe.llm.store import open_store
from trailframe.runtime import materialize, scratch_path

# magic, version, id width; documents, without id, ids, first id, bytes of ends, bytes of document ids
HEADER = "<4sHH6q"
MAGIC, VERSION = b"TFEF", 1
# Every so many ones the place of one is kept.
SAMPLE = 256
# Values that are packed or unpacked at a time.
RUN = 1 << 16
# Documents of a file that are read at a time.
WINDOW = 4096
# Ids a file holds at most, but for a longer document.
FILE_IDS = 32 << 20


class EliasFano:
    """An ascending sequence of non-negative numbers: ``n`` values in about ``n * (2 + low)`` bits."""

    HEAD = "<QBQ"

    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.high, self.samples = n, low, lows, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones.astype(np.int64)] = 1
        return cls(n, low, cls._pack_lows(values, low), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    @staticmethod
    def _pack_lows(values: np.ndarray, low: int) -> np.ndarray:
        """The low bits end to end, some values at a time (a multiple of 8, so that bytes are whole)."""
        packed = [np.zeros(0, np.uint8)]
        for at in range(0, len(values) if low else 0, RUN):
            part = values[at : at + RUN]
            bits = np.empty(len(part) * low, np.uint8)
            for k in range(low):
                bits[k::low] = (part >> np.uint64(k)) & np.uint64(1)
            packed.append(np.packbits(bits, bitorder="little"))
        return np.concatenate(packed)

    def part(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop``, from the nearest kept place: only what lies between is decoded."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin) :][start - first * SAMPLE : stop - first * SAMPLE]
        out = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            byte = start * self.low // 8
            bits = np.unpackbits(self.lows[byte : -(-stop * self.low // 8)], bitorder="little")
            bits = bits[start * self.low - 8 * byte :][: (stop - start) * self.low]
            for k in range(self.low):
                out |= bits[k :: self.low].astype(np.uint64) << np.uint64(k)
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *[self.part(at, min(self.n, at + RUN)) for at in range(0, self.n, RUN)]])

    def select(self, i: int) -> int:
        """Value ``i``, by a scan from the nearest kept one."""
        left, at = i % SAMPLE, int(self.samples[i // SAMPLE])
        byte = at // 8
        part = np.unpackbits(self.high[byte : byte + 1], bitorder="little").astype(bool)
        part[: at % 8] = False
        while (here := int(part.sum())) <= left:
            left -= here
            byte += 1
            part = np.unpackbits(self.high[byte : byte + 1], bitorder="little").astype(bool)
        place = byte * 8 + int(np.flatnonzero(part)[left])
        bits = [(int(self.lows[b // 8]) >> (b % 8)) & 1 for b in range(i * self.low, (i + 1) * self.low)]
        return ((place - i) << self.low) | sum(bit << k for k, bit in enumerate(bits))

    def pack(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.low, len(self.high)) + self.samples.tobytes() + self.lows.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, low, length = struct.unpack_from(cls.HEAD, data)
        at = struct.calcsize(cls.HEAD)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        at += samples.nbytes
        lows = np.frombuffer(data, np.uint8, -(-n * low // 8), at)
        return cls(n, low, lows, np.frombuffer(data, np.uint8, length, at + lows.nbytes), samples)


def pack_head(ids: list[int | None], counts: list[int], width: int) -> bytes:
    """Everything of a file that stands before the token ids. Null ids come first."""
    known = [i for i in ids if i is not None]
    first = known[0] if known else 0
    # Differences in unsigned arithmetic: ids may span all of 64 bits.
    apart = np.array(known, dtype=np.int64).astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
    ends = EliasFano.of(np.cumsum(np.array(counts, dtype=np.uint64))).pack()
    names = EliasFano.of(apart).pack()
    return struct.pack(HEADER, MAGIC, VERSION, width, len(ids), len(ids) - len(known), sum(counts), first, len(ends), len(names)) + ends + names


class TokenFile:
    """A file opened for reading: boundaries by ``select``, ids by slices."""

    def __init__(self, path: str):
        store, where = open_store(path)
        self.file = store.open_input_file(where)
        magic, version, self.width, self.n, self.unnamed, self.total, self.first, ends, names = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is no token file")
        self.ends = EliasFano.unpack(self.file.read_at(ends, struct.calcsize(HEADER)))
        self.apart = EliasFano.unpack(self.file.read_at(names, struct.calcsize(HEADER) + ends))
        self.data = struct.calcsize(HEADER) + ends + names

    def doc_ids(self, start: int = 0, stop: int | None = None) -> list[int | None]:
        """Ids of documents ``start`` to ``stop``."""
        stop = self.n if stop is None else stop
        apart = self.apart.part(max(0, start - self.unnamed), max(0, stop - self.unnamed))
        return [None] * (min(stop, self.unnamed) - min(start, self.unnamed)) + (apart + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).astype(np.int64).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width, self.data + start * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def close(self) -> None:
        self.file.close()


def worker_cache() -> dict:
    """A dictionary that lives as long as a Python worker, over all its tasks."""
    home = sys.modules.setdefault("trailframe_worker", types.ModuleType("trailframe_worker"))
    return home.__dict__.setdefault("kept", {})


class Encoder:
    """Ids of texts by a tokenizer file, each different word encoded once a worker.

    A byte-level BPE never joins across a blank that stands before or after a
    word, so a text is cut at such blanks and words are looked up. Texts with
    other runs of white space round a blank are encoded whole.
    """

    # Words that a worker keeps; common ones turn up early. Others are encoded again in every batch.
    MOST = 700_000
    ODD = re.compile(r"\s (?=\s|\Z)")
    BARE = re.compile(r"\S+")
    OTHER = re.compile(r"[^\S ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary_ = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary_.values(), default=0) < 0x10000 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        # A byte-level vocabulary writes one character a byte.
        self.sizes = np.zeros(max(vocabulary_.values(), default=0) + 1, np.int64)
        for token, i in vocabulary_.items():
            self.sizes[i] = len(token)
        # Ids of words behind a blank, and of words that open a text.
        self.words, self.opening = worker_cache().setdefault(path, ({}, {}))

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 2000):
            found = self.tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)
            out += [np.array(e.ids, dtype=self.type).tobytes() for e in found]
        return out

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words behind a blank: words of one run are encoded side by side and told apart by their bytes."""
        found: dict[str, bytes] = {}
        for i in range(0, len(words), 4000):
            own, text = words[i : i + 4000], " " + " ".join(words[i : i + 4000])
            if "" in own or self.ODD.search(text) or self.OTHER.search(text):
                own = [w for w in own if self.BARE.fullmatch(w)]
                text = " " + " ".join(own)
            if not own:
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.type)
            ends = np.cumsum(self.sizes[ids])
            # Words hold no blanks: every one ends where the next blank stands.
            blanks = np.flatnonzero(np.frombuffer(raw := text.encode(), np.uint8) == 0x20)
            stops = np.append(blanks[1:], len(raw))
            last = np.searchsorted(ends, stops)
            # Words whose bytes don't end with a token's (a special token swallowed more) go on below.
            if len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all():
                data, cuts = ids.tobytes(), ((last + 1) * self.width).tolist()
                found.update(zip(own, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._ids([" " + w for w in rest])))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        words = self.words
        cut = [None if self.ODD.search(t) else t.split(" ") for t in texts]
        fresh: set[str] = set()
        for parts in cut:
            if parts is not None and len(parts) > 1:
                fresh.update(parts[1:])
        new = self._words([w for w in fresh if w not in words])
        spare = [] if len(words) + len(new) <= self.MOST else list(new)
        words.update(new)
        first = list({p[0] for p in cut if p is not None} - self.opening.keys())
        if len(self.opening) > self.MOST // 4:
            self.opening.clear()
            first = list({p[0] for p in cut if p is not None})
        self.opening.update(zip(first, self._ids(first)))
        out = [
            self.opening[parts[0]] + b"".join([words[p] for p in parts[1:]]) if parts is not None else self._ids([t])[0]
            for t, parts in zip(texts, cut)
        ]
        for w in spare:
            del words[w]
        return out


MANIFEST = "part int, seq int, file string, n_docs bigint, n_ids bigint"


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, end it with ``end_id``, and write files in ascending id order.

    Returns the manifest: one row a file, in order ``part, seq``. Null text
    counts as empty and holds the end id alone; null ids come first; rows that
    share an id stand in the order of their row keys; an empty table writes no
    file; ids must be integers. A file's name is used once, so that a lost
    task's half-written file is never in the manifest.

    One shuffle by ranges of (id, row key): no id, however many rows share it,
    has to fit one task. A task holds one file's ids.
    """
    rows = with_key(pick(df, id=id_col, text=text_col), "key")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    arranged = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "key").sortWithinPartitions(F.col("id").asc_nulls_first(), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = open_store(path)
        store.create_dir(where, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        encoder = Encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.type).tobytes()
        ids, counts, blobs, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{path}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            out_store, out = open_store(name)
            with out_store.open_output_stream(out, compression=None) as f:
                f.write(pack_head(ids, counts, encoder.width))
                for blob in blobs:
                    f.write(blob)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([sum(counts)], pa.int64())}
            )

        for batch in batches:
            names = batch.column("id").to_pylist()
            for at in range(0, len(names), 256):
                texts = [t or "" for t in batch.column("text").slice(at, 256).to_pylist()]
                for name, blob in zip(names[at : at + 256], encoder.encode(texts)):
                    ids.append(name)
                    blobs.append(blob + end)
                    counts.append(len(blob) // encoder.width + 1)
                    held += counts[-1]
                    if held >= file_ids:
                        yield flush()
                        ids, counts, blobs, held = [], [], [], 0
                        seq += 1
        if ids:
            yield flush()

    return materialize(arranged.mapInArrow(run, MANIFEST), "token-files")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a manifest's files.

    ``start`` counts the ids of all documents before it. Files' offsets come
    from a running sum over the manifest, one row a file.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spread = placed.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                f = TokenFile(path)
                at = 0
                while at < f.n:
                    # A window of documents: its begin by select, the ends inside it decoded, at least one
                    # document and else as many as 1 M ids hold.
                    first = f.ends.select(at - 1) if at else 0
                    ends = f.ends.part(at, min(f.n, at + WINDOW)).astype(np.int64)
                    ends = ends[: max(1, int(np.searchsorted(ends, first + (1 << 20), "right")))]
                    starts = np.concatenate([[first], ends[:-1]])
                    data = f.ids(first, int(ends[-1])).astype("<u4").view(np.uint8)
                    sums = [zlib.crc32(data[4 * (a - first) : 4 * (b - first)]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(f.doc_ids(at, at + len(ends)), pa.int64()),
                            "start": pa.array(starts + base, pa.int64()),
                            "n_tokens": pa.array(ends - starts, pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )
                    at += len(ends)
                f.close()

    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_ids")
def op5_token_ids(spark, sf_dir):
    files = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), vocabulary("byte_bpe_50k.json"))
    return read_tokens(files)
