"""Tokens of two vocabularies set against each other, byte for byte.

Both tokenizers cut the same bytes. Where both end a token is a cut; between
two cuts lies a group; an A and a B token whose bytes overlap are linked.

Any range of a document's bytes is a fragment: an open head before its first
cut, closed groups, an open tail behind its last one (without a cut all of it
is head). Two neighbours compose to a fragment, the left one's tail and the
right one's head closing one group, and composing is associative. So documents
of more than ``RANGE`` bytes are cut into ranges that different tasks encode
and align; only the open ends, a few tokens a range, go up a tree.

A range is encoded with the text round it up to the next blank between two
printable ASCII characters: no token of either vocabulary reaches over such a
blank (``Pair`` checks that of B's), so its tokens are those of the whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import pick, with_key
from trailframe.llm.shingles import mix
from trailframe.llm.store import give_back
from trailframe.llm.tokens import vocabulary, worker_cache
from trailframe.runtime import materialize

U = np.uint64
# Bytes of a range, ranges to a node of the tree, links to a block, bytes of text to a slot.
RANGE, FAN, BLOCK, SLOT = 32 << 10, 8, 1_500_000, 32 << 20
# Bytes of texts that are encoded and aligned at a time; words a worker keeps, and the longest one's characters.
STEP, MOST_WORDS, LONG_WORD = 1 << 20, 400_000, 40

OPEN = "head_a binary, head_b binary, tail_a binary, tail_b binary"
RUN = "bad boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary"
STATS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = "block bigint, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, ends binary, entries binary, times binary, pairs binary, holders binary, cuts binary"


def planes(x: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, so that their zeros lie together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplane(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Pair:
    """Both tokenizers: ids of a text behind a blank, and the bytes of every id.

    A worker keeps the ids of words that stand between two blanks with no other
    white space next to them; equal words have equal ids wherever they stand.
    Words kept have numbers, by which the ids of many texts are gathered at once.
    A word's signs behind its letters, and what follows a line's end in it, are
    looked up apart: no token of either vocabulary reaches over these places.
    """

    # Blanks with other white space beside them.
    ODD = re.compile(r" \s"), re.compile(r"[^\S ] ")
    CUT = re.compile(r"(?<=\S) (?=\S)")
    BARE = re.compile(r"\S(.*\S)?", re.S)
    LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and (c.isascii() or c >= "\u00c0"))
    SIGNS = ".,;:!?#*$%&|<>"

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # A byte-level vocabulary spells bytes 33-126, 161-172 and 174-255 as themselves and the others from U+0100 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        words = self.a.get_vocab()
        self.bytes_a = [b""] * (max(words.values(), default=-1) + 1)
        for word, i in words.items():
            self.bytes_a[i] = bytes(spelled[c] for c in word) if all(c in spelled for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second vocabulary goes on behind a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        letters, signs = (re.escape("".join(sorted(x))) for x in (self.LETTERS, self.SIGNS))
        over = re.compile(f"[{letters}][{signs}]")
        spoken = [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        self.apart = not any("\n" in p or over.search(p) for p in spoken)
        self.clear()

    def clear(self) -> None:
        # Numbers of words behind a blank, of words behind a line's end (with it) and of signs. Number 0: bytes that aren't given back.
        self.words: dict[str, int] = {}
        self.lines: dict[str, int] = {}
        self.signs: dict[str, int] = {}
        # Of each vocabulary the ids of all numbers, and where a number's begin.
        self.ids = [np.zeros(0, "<u4"), np.zeros(0, "<u4")]
        self.begin = [np.zeros(2, np.int64), np.zeros(2, np.int64)]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        """The one of this worker."""
        kept = worker_cache()
        if (a_path, b_path) not in kept:
            kept[a_path, b_path] = cls(a_path, b_path)
        return kept[a_path, b_path]

    def whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        found_b = self.b.encode(texts, num_threads=1)
        return [(np.array(a.ids, "<u4"), np.array(b, "<u4")) for a, b in zip(found_a, found_b)]

    def keep(self, ids: list[np.ndarray], ends: list[np.ndarray]) -> range:
        """The next numbers, for ids whose stretches end at ``ends``."""
        first = len(self.begin[0]) - 1
        for side in (0, 1):
            self.begin[side] = np.concatenate([self.begin[side], ends[side] + len(self.ids[side])])
            self.ids[side] = np.concatenate([self.ids[side], ids[side]])
        return range(first, first + len(ends[0]))

    def drop(self, numbers: int) -> None:
        """Forget all numbers from ``numbers`` on."""
        for side in (0, 1):
            self.begin[side] = self.begin[side][: numbers + 1]
            self.ids[side] = self.ids[side][: self.begin[side][-1]]

    def gather(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vocabulary the ids of these numbers, end to end, and where each number's end."""
        out = []
        for ids, begin in zip(self.ids, self.begin):
            low = begin[numbers]
            n = begin[numbers + 1] - low
            ends = np.cumsum(n)
            out.append((ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - ends + n, n)], ends))
        return out

    def spells(self, a: np.ndarray, b: np.ndarray, data: bytes) -> bool:
        return all(b"".join(map(of.__getitem__, ids.tolist())) == data for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def beside(self, words: list[str], mark: str, known: dict[str, int], bare: bool = False) -> None:
        """Number words behind ``mark`` (a blank or a line's end), encoded side by side; ``bare`` ones without it.

        Words of a run that doesn't give its bytes back, or in which a token reaches over a word's end, are passed over.
        """
        opening = "" if mark == " " else "a"
        for at in range(0, len(words), 4000):
            own = words[at : at + 4000]
            text = mark.join([opening, *own]) if opening else mark.join(own)
            a, b = self.whole([text])[0]
            raw = [(mark + w).encode() for w in own]
            if opening:
                raw.insert(0, b" " + opening.encode())
            stops = np.cumsum([len(r) for r in raw])
            found = [(a, np.cumsum(self.size_a[a])), (b, np.cumsum(self.size_b[b]))]
            if not all(len(e) and e[-1] == stops[-1] for _, e in found):
                continue
            last = [np.searchsorted(e, stops) for _, e in found]
            if any((e[x] != stops).any() for (_, e), x in zip(found, last)) or not self.spells(a, b, b"".join(raw)):
                continue
            ids, ends = [a, b], [x + 1 for x in last]
            if opening:
                ids, ends = [i[e[0] :] for i, e in zip(ids, ends)], [e[1:] - e[0] for e in ends]
            if bare:
                # The mark is the first token of each.
                first = [np.concatenate([[0], e[:-1]]) for e in ends]
                if any((size[i[f]] != len(mark)).any() for size, i, f in zip((self.size_a, self.size_b), ids, first)):
                    continue
                ids, ends = [np.delete(i, f) for i, f in zip(ids, first)], [e - np.arange(1, len(e) + 1) for e in ends]
            known.update(zip(own, self.keep(ids, ends)))

    def parts(self, word: str) -> list[str] | None:
        """Stem and signs of every line of a word; None where a line isn't letters and then signs."""
        found = []
        for line in word.split("\n"):
            stem = line.rstrip(self.SIGNS)
            if not stem.isalpha() or stem[-1] not in self.LETTERS:
                return None
            found += (stem, line[len(stem) :])
        return found

    def learn(self, words: list[str]) -> dict[str, int]:
        """Numbers of new words. Composed and long ones, and those encoded alone, are numbered behind ``kept``."""
        composed: list[tuple[str, list[str]]] = []
        plain: dict[str, None] = {}
        lines: set[str] = set()
        signs: set[str] = set()
        ends, stems = [], []
        for w in words:
            if w.isalpha():
                plain[w] = None
                continue
            stem = w.rstrip(self.SIGNS) if self.apart else ""
            if stem.isalpha() and stem[-1] in self.LETTERS:
                # Most are one stem and its signs.
                ends.append(w)
                stems.append(stem)
                continue
            parts = self.parts(w) if self.apart and "\n" in w else None
            if parts is not None:
                composed.append((w, parts))
                plain[parts[0]] = None
                signs.update(parts[1::2])
                lines.update(parts[2::2])
            elif self.BARE.fullmatch(w):
                plain[w] = None
        plain.update(dict.fromkeys(stems))
        tails = [w[len(stem) :] for w, stem in zip(ends, stems)]
        signs.update(tails)
        signs.discard("")
        for new, mark, known in ((plain, " ", self.words), (lines, "\n", self.lines), (signs, "\n", self.signs)):
            self.beside([w for w in new if w not in known and len(w) <= LONG_WORD], mark, known, known is self.signs)
        passing: dict[str, int] = {}
        whole, numbers, count = [], [], []
        for w, stem, tail in zip(ends, map(self.words.get, stems), map(self.signs.get, tails)):
            if stem is not None and tail is not None:
                whole.append(w)
                numbers += (stem, tail)
        count += [2] * len(whole)
        for w, parts in composed:
            own = [self.words.get(parts[0])]
            own += map(self.lines.get, parts[2::2])
            own = [n for pair in zip(own, [self.signs.get(x) if x else -1 for x in parts[1::2]]) for n in pair if n != -1]
            if None not in own:
                whole.append(w)
                numbers += own
                count.append(len(own))
        self.kept = len(self.begin[0]) - 1
        if whole:
            last = np.cumsum(count) - 1
            (a, ends_a), (b, ends_b) = self.gather(np.array(numbers))
            passing.update(zip(whole, self.keep([a, b], [ends_a[last], ends_b[last]])))
        # Alone: long ones, ones with white space at an end, and runs that don't give their bytes back.
        rest = [w for w in words if w not in passing and w not in self.words]
        coded = [c if self.spells(*c, b" " + w.encode()) else None for w, c in zip(rest, self.whole(rest))] if rest else []
        good = [(w, c) for w, c in zip(rest, coded) if c is not None]
        passing.update([(w, 0) for w, c in zip(rest, coded) if c is None])
        if good:
            sides = list(zip(*(c for _, c in good)))
            passing.update(zip([w for w, _ in good], self.keep([np.concatenate(x) for x in sides], [np.cumsum([len(i) for i in x]) for x in sides])))
        return {w: passing[w] if w in passing else self.words[w] for w in words}

    def cut(self, text: str) -> list[str]:
        """Words between blanks that have no other white space beside them."""
        if text[:1] != " " and text[-1:] != " " and not any(odd.search(text) for odd in self.ODD):
            return text.split(" ")
        return self.CUT.split(text)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Per text the ids of blank + text, None where a vocabulary doesn't give these bytes back."""
        if not texts:
            return []
        cut = [self.cut(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        numbers = list(map(self.words.get, flat))
        places = [i for i, n in enumerate(numbers) if n is None]
        fresh = list(dict.fromkeys([flat[i] for i in places]))
        if len(self.begin[0]) + len(fresh) > MOST_WORDS:
            self.clear()
            places, fresh = range(len(flat)), list(dict.fromkeys(flat))
        if fresh:
            learnt = self.learn(fresh)
            for i in places:
                numbers[i] = learnt[flat[i]]
        all_numbers = np.array(numbers, np.int64)
        last = np.cumsum([len(parts) for parts in cut])
        bad = np.logical_or.reduceat(all_numbers == 0, np.concatenate([[0], last[:-1]]))
        sides = []
        for ids, ends in self.gather(all_numbers):
            stops = [0, *ends[last - 1].tolist()]
            sides.append([ids[x:y].tobytes() for x, y in zip(stops, stops[1:])])
        if fresh:
            self.drop(self.kept)
        return [None if x else (a, b) for x, a, b in zip(bad.tolist(), *sides)]


@functools.cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 100,000: their digits, with room for a mark behind them, and how many."""
    digits = np.zeros((100_000, 6), np.uint8)
    width = np.ones(100_000, np.uint8)
    for n in range(1, 5):
        width[10**n :] += 1
    at = np.arange(100_000)
    for n in range(1, 6):
        some = at[width == n]
        for digit in range(n):
            digits[some, n - 1 - digit] = 48 + some // 10**digit % 10
    return digits, width


def _spelled(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in decimal, each with its mark behind it, and where each ends."""
    digits, widths = _decimals()
    if not len(ids) or int(ids.max()) < len(widths):
        out, width = digits[ids], widths[ids]
        out[np.arange(len(ids)), width] = marks
        return out[np.arange(6, dtype=np.uint8) <= width[:, None]], np.cumsum(width.astype(np.int64) + 1)
    width, power = np.ones(len(ids), np.int64), 10
    while power <= int(ids.max()):
        width += ids >= power
        power *= 10
    ends = np.cumsum(width + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    rest = ids.astype(np.int64)
    for digit in range(int(width.max(initial=0))):
        some = width > digit
        out[ends[some] - 2 - digit] = 48 + rest[some] % 10
        rest //= 10
    return out, ends


class Aligned:
    """Runs of tokens, each from a cut to a cut: groups, links and their spelling, for many runs at once."""

    def __init__(self, pair: Pair, runs: list[tuple[bytes, bytes]]):
        a, b = (np.frombuffer(b"".join([r[side] for r in runs]), "<u4") for side in (0, 1))
        self.runs = len(runs)
        self.last_a, self.last_b = (np.cumsum([len(r[side]) // 4 for r in runs], dtype=np.int64) for side in (0, 1))
        self.n_a, self.n_b = np.diff(self.last_a, prepend=0), np.diff(self.last_b, prepend=0)
        end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        # Cuts: A tokens that end where a B token ends.
        to = np.searchsorted(end_b, end_a)
        cut = end_b[to] == end_a if len(a) else np.zeros(0, bool)
        cut_a, cut_b = np.flatnonzero(cut), to[cut]
        self.n_groups = np.diff(np.searchsorted(cut_a, self.last_a), prepend=0)
        # Links: from the B token that holds the A token's first byte to the one that holds its last.
        begin = np.searchsorted(end_b, end_a - pair.size_a[a], "right")
        n = to - begin + 1
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        left = np.repeat(np.arange(len(a)), n)
        right = np.arange(total) - np.repeat(ends - n - begin, n)
        self.pairs = a[left].astype(U) << U(32) | b[right].astype(U)
        self.run = np.repeat(np.repeat(np.arange(self.runs), self.n_a), n)
        self.n_links = np.bincount(self.run, minlength=self.runs)
        # Spelling: a group's A tokens, then its B tokens.
        cut_of_b = np.zeros(len(b), bool)
        cut_of_b[cut_b] = True
        group_a, group_b = np.cumsum(cut) - cut, np.cumsum(cut_of_b) - cut_of_b
        ids, marks = np.empty(len(a) + len(b), np.uint32), np.empty(len(a) + len(b), np.uint8)
        place_a = np.arange(len(a)) + np.concatenate([[0], cut_b + 1])[group_a] if len(a) else np.zeros(0, int)
        place_b = np.arange(len(b)) + cut_a[group_b] + 1 if len(b) else np.zeros(0, int)
        ids[place_a], ids[place_b] = a, b
        marks[:] = ord(",")
        marks[place_a[cut_a]], marks[place_b[cut_b]] = ord("|"), ord(";")
        text, ends = _spelled(ids, marks)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], self.last_a + self.last_b])]
        self.groups = [text[x : max(x, y - 1)].tobytes() for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())]


class Blocks:
    """Documents of a task in blocks: what they link, by a dictionary of the block's different pairs."""

    def __init__(self, kind: pa.DataType, slots: int, schema: pa.Schema):
        self.kind, self.slots, self.schema = kind, slots, schema
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.doc, self.pairs, self.times, self.links = [], [], [], 0

    def add(self, keys: list, ids: list, stats: list[tuple], groups: list[str], doc: np.ndarray, pairs: np.ndarray, times: np.ndarray | None) -> None:
        """Some documents, and the links (number of the document among them, pair, how often)."""
        self.doc.append(doc + len(self.docs))
        self.docs += zip(keys, ids, stats, groups)
        self.pairs.append(pairs)
        self.times.append(np.ones(len(pairs), np.int64) if times is None else times)
        self.links += len(pairs)

    def full(self) -> bool:
        return self.links >= BLOCK

    def flush(self) -> pa.RecordBatch:
        pairs, inverse = np.unique(np.concatenate(self.pairs), return_inverse=True)
        # The dictionary's order: slots by A's id, then pairs.
        slot = (mix(pairs >> U(32)) % U(self.slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        pairs, slot = pairs[order], slot[order]
        code = np.concatenate(self.doc) * max(1, len(pairs)) + rank[inverse]
        order = np.argsort(code)
        code, times = code[order], np.concatenate(self.times)[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, times = code[first], np.add.reduceat(times, first) if len(first) else times
        doc, entry = code // max(1, len(pairs)), code % max(1, len(pairs))
        ends = np.searchsorted(doc, np.arange(len(self.docs)), "right")
        # Rising entries as differences within a document.
        step = np.diff(entry, prepend=0)
        heads = ends[:-1][ends[:-1] < len(entry)]
        step[heads] = entry[heads]
        keys, ids, stats, groups = zip(*self.docs)
        values = {
            "block": pa.array([keys[0]], pa.int64()),
            "ids": pa.array([list(ids)], pa.list_(self.kind)),
            **{name: pa.array([[int(s[i]) for s in stats]], pa.list_(pa.int64())) for i, name in enumerate(STATS)},
            "groups": pa.array([list(groups)], pa.list_(pa.string())),
            "ends": [ends.astype("<i8").tobytes()],
            "entries": [planes(step.astype("<u4"))],
            "times": [planes(times.astype("<u4"))],
            "pairs": [planes(np.diff(pairs, prepend=U(0)))],
            "holders": [planes(np.bincount(entry, minlength=len(pairs)).astype("<u4"))],
            "cuts": [np.searchsorted(slot, np.arange(self.slots + 1)).astype("<u4").tobytes()],
        }
        self.clear()
        columns = [values[f.name] if f.name in values else pa.nulls(1, f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _finish(groups: bytes, digest: bool) -> str:
    return hashlib.sha256(groups).hexdigest() if digest else groups.decode()


def ranges(text: str, size: int) -> list[tuple[int, int, int, str]]:
    """Ranges of the bytes of blank + text: (number, begin, end, context), the latter two places within the context, which opens with a blank that is left out."""
    body = b" " + text.encode()
    data = np.frombuffer(body, np.uint8)
    plain = (data > 0x20) & (data < 0x7F)
    safe = np.concatenate([[0], np.flatnonzero((data[1:-1] == 0x20) & plain[:-2] & plain[2:]) + 1, [len(body)]])
    out = []
    for no, low in enumerate(range(0, len(body), size)):
        high = min(low + size, len(body))
        left = int(safe[np.searchsorted(safe, low, "right") - 1])
        right = int(safe[np.searchsorted(safe, high)])
        out.append((no, low - left, high - left, body[left + 1 : right].decode()))
    return out


def _schema(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _short(a_path, b_path, size: int, slots: int, digest: bool, schema: pa.Schema):
    """Task function: short documents aligned, in blocks; long ones as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, blocks = Pair.of(a_path, b_path), Blocks(schema.field("id").type, slots, schema)
        keys, ids, texts, held = [], [], [], 0

        def align() -> None:
            coded = pair.encode(texts)
            done = Aligned(pair, [(b"", b"") if c is None or not t else c for c, t in zip(coded, texts)])
            stats = list(zip(done.n_a, done.n_b, done.n_groups, done.n_links))
            groups = [_finish(g, digest) if s[0] else "" for g, s in zip(done.groups, stats)]
            blocks.add(keys, ids, stats, groups, done.run, done.pairs, None)

        for batch in batches:
            for key, name, text in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                weight = len(text) if text.isascii() else len(text.encode())
                if weight >= size:
                    parts = ranges(text, size)
                    some = {
                        "key": [key] * len(parts),
                        "id": [name] * len(parts),
                        "no": [p[0] for p in parts],
                        "n": [len(parts)] * len(parts),
                        "low": [p[1] for p in parts],
                        "high": [p[2] for p in parts],
                        "text": [p[3] for p in parts],
                    }
                    for at in range(0, len(parts), 64):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some[f.name][at : at + 64], f.type) if f.name in some else pa.nulls(len(parts[at : at + 64]), f.type) for f in schema], schema=schema
                        )
                    continue
                keys.append(key)
                ids.append(name)
                texts.append(text)
                held += weight + 100
                if held >= STEP:
                    align()
                    keys, ids, texts, held = [], [], [], 0
                    if blocks.full():
                        yield blocks.flush()
        if texts:
            align()
        if blocks.docs:
            yield blocks.flush()
        give_back()

    return run


def _run_batch(done: Aligned, bad: list[bool], **more: list) -> pa.RecordBatch:
    """Rows of runs: what they count, spell and link."""
    order = np.lexsort((done.pairs, done.run))
    run, pairs = done.run[order], done.pairs[order]
    first = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(pairs, prepend=pairs[:1] + U(1)) != 0))
    times = np.diff(np.concatenate([first, [len(run)]]))
    ends = np.searchsorted(run[first], np.arange(done.runs + 1))
    stats = [done.n_a, done.n_b, done.n_groups, done.n_links]
    columns = {
        **more,
        "bad": pa.array(bad, pa.bool_()),
        **{n: pa.array(s, pa.int64()) for n, s in zip(STATS, stats)},
        "groups": pa.array([g.decode() for g in done.groups], pa.string()),
        "pairs": pa.array([pairs[first[x:y]].tobytes() for x, y in zip(ends, ends[1:])], pa.binary()),
        "times": pa.array([times[x:y].astype("<i8").tobytes() for x, y in zip(ends, ends[1:])], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


class Fragment:
    """The open ends of a range: ids before its first cut and behind its last one; without a cut all are in the head."""

    def __init__(self, cut: bool, head: tuple[bytes, bytes], tail: tuple[bytes, bytes] = (b"", b"")):
        self.cut, self.head, self.tail = cut, head, tail

    def then(self, right: Fragment) -> tuple[Fragment, tuple[bytes, bytes] | None]:
        """The fragment of both, and the group that they close between them."""

        def both(x, y):
            return x[0] + y[0], x[1] + y[1]

        if not self.cut:
            return Fragment(right.cut, both(self.head, right.head), right.tail), None
        if not right.cut:
            return Fragment(True, self.head, both(self.tail, right.head)), None
        return Fragment(True, self.head, right.tail), both(self.tail, right.head)


def fragment(pair: Pair, coded: tuple[bytes, bytes], low: int, high: int) -> tuple[Fragment, tuple[bytes, bytes]]:
    """Of the tokens that end in bytes ``low`` to ``high`` of a context: the open ends, and the closed run between."""
    a, b = (np.frombuffer(x, "<u4") for x in coded)
    ends = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    inside = [(e > low) & (e <= high) for e in ends]
    cuts = np.intersect1d(ends[0][inside[0]], ends[1][inside[1]])
    if not len(cuts):
        return Fragment(False, (a[inside[0]].tobytes(), b[inside[1]].tobytes())), (b"", b"")

    def part(begin, end):
        return tuple(ids[(e > begin) & (e <= end)].tobytes() for ids, e in zip((a, b), ends))

    return Fragment(True, part(low, cuts[0]), part(cuts[-1], high)), part(cuts[0], cuts[-1])


def _fragments(a_path, b_path):
    """Task function: ranges to their runs and open ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                coded = pair.encode(part.column("text").to_pylist())
                found = [
                    (Fragment(False, (b"", b"")), (b"", b"")) if c is None else fragment(pair, c, low, high)
                    for c, low, high in zip(coded, part.column("low").to_pylist(), part.column("high").to_pylist())
                ]
                done = Aligned(pair, [r for _, r in found])
                ends = [f for f, _ in found]
                sides = {f"{end}_{s}": pa.array([getattr(f, end)[i] for f in ends], pa.binary()) for end in ("head", "tail") for i, s in enumerate("ab")}
                yield _run_batch(
                    done, [c is None for c in coded], **{n: part.column(n) for n in ("key", "id", "no", "n")}, cut=pa.array([f.cut for f in ends], pa.bool_()), **sides
                )
        give_back()

    return run


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: of rows sorted by (key, no), each node's fragments composed. Closed groups have ``closed`` set and stand before range ``first``."""

    def row(key, no, first, closed, f: Fragment) -> tuple:
        return key, no, first, closed, f.cut, *f.head, *f.tail

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.binary()] * 4]
        names = ["key", "no", "first", "closed", "cut", "head_a", "head_b", "tail_a", "tail_b"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    here, first, left = None, 0, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own = Fragment(r["cut"], (r["head_a"], r["head_b"]), (r["tail_a"], r["tail_b"]))
            node = r["key"], r["no"] // FAN
            if node != here:
                if left is not None:
                    out.append(row(*here, first, False, left))
                here, first, left = node, r["first"], own
                continue
            left, closed = left.then(own)
            if closed is not None:
                out.append(row(*node, r["first"], True, Fragment(True, closed)))
        if out:
            yield batch_of(out)
    if left is not None:
        yield batch_of([row(*here, first, False, left)])


def _close(a_path, b_path):
    """Task function: closed groups to runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a_path, b_path)
        for batch in batches:
            done = Aligned(pair, list(zip(batch.column("head_a").to_pylist(), batch.column("head_b").to_pylist())))
            yield _run_batch(done, [False] * batch.num_rows, key=batch.column("key"), at=batch.column("at"))

    return run


def _assemble(slots: int, digest: bool, schema: pa.Schema):
    """Task function: of runs sorted by (key, at), each document's numbers, spelling and different links, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(schema.field("ids").type.value_type, slots, schema)
        key, name, bad, stats, spelled, pairs, times, held = None, None, False, np.zeros(4, np.int64), None, [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, inverse = np.unique(np.concatenate([np.zeros(0, U), *pairs]), return_inverse=True)
            out = np.zeros(len(found), np.int64)
            np.add.at(out, inverse, np.concatenate([np.zeros(0, np.int64), *times]))
            return found, out

        def close() -> None:
            found, n = (np.zeros(0, U), np.zeros(0, np.int64)) if bad else merged()
            groups = "" if bad or not stats[0] else spelled.hexdigest() if digest else ";".join(spelled)
            blocks.add([key], [name], [np.zeros(4, np.int64) if bad else stats], [groups], np.zeros(len(found), np.int64), found, n)

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        close()
                        if blocks.full():
                            yield blocks.flush()
                    key, name, bad, stats, pairs, times, held = r["key"], None, False, np.zeros(4, np.int64), [], [], 0
                    spelled = hashlib.sha256() if digest else []
                name = r["id"] if r["named"] else name
                bad |= r["bad"]
                if r["groups"]:
                    if digest:
                        spelled.update((";" if stats[0] else "").encode() + r["groups"].encode())
                    else:
                        spelled.append(r["groups"])
                stats = stats + np.array([r[n] for n in STATS])
                pairs.append(np.frombuffer(r["pairs"], U))
                times.append(np.frombuffer(r["times"], "<i8"))
                held += len(pairs[-1])
                if held > BLOCK:
                    # A long document's links are combined as they come: only different ones are held.
                    some = merged()
                    pairs, times, held = [some[0]], [some[1]], 0
        if key is not None:
            close()
            yield blocks.flush()
        give_back()

    return run


def _long(parts: DataFrame, a_path, b_path, slots: int, digest: bool, ddl: str) -> DataFrame:
    """Blocks of the documents that come in ranges."""
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = parts.schema["id"].dataType.simpleString()
    pieces = parts.repartition(n, "key", "no")
    found = materialize(pieces.mapInArrow(_fragments(a_path, b_path), f"key bigint, id {kind}, no int, n int, cut boolean, {OPEN}, {RUN}"), "fragments")
    most = found.agg(F.max("n")).first()[0]
    if most is None:
        return None
    # A document with a range that doesn't give its bytes back has no groups at all.
    ends = found.select("key", "no", F.col("no").alias("first"), "cut", "head_a", "head_b", "tail_a", "tail_b")
    ends = ends.join(found.filter("bad").select("key").distinct(), "key", "left_anti")
    closed = []
    while most > 1:
        nodes = ends.repartition(n, "key", F.floor(F.col("no") / FAN)).sortWithinPartitions("key", "no")
        level = materialize(nodes.mapInArrow(_tree, f"key bigint, no int, first int, closed boolean, cut boolean, {OPEN}"), "tree")
        closed.append(level.filter("closed"))
        ends = level.filter("NOT closed").drop("closed")
        most = -(-most // FAN)
    # The begin of a text is a cut, and so is its end: what is still open is the head.
    groups = ends.filter("cut").select("key", F.lit(0).alias("at"), "head_a", "head_b")
    for level in closed:
        groups = groups.unionByName(level.select("key", (F.col("first") * 2).alias("at"), "head_a", "head_b"))
    between = groups.mapInArrow(_close(a_path, b_path), f"key bigint, at int, {RUN}")
    columns = ["key", "at", "id", "named", "bad", *STATS, "groups", "pairs", "times"]
    runs = found.withColumn("at", F.col("no") * 2 + 1).withColumn("named", F.lit(True)).select(*columns)
    runs = runs.unionByName(between.withColumn("id", F.lit(None).cast(kind)).withColumn("named", F.lit(False)).select(*columns))
    arranged = runs.repartition(n, "key").sortWithinPartitions("key", "at")
    return materialize(arranged.mapInArrow(_assemble(slots, digest, _schema(ddl, spark)), ddl), "long-blocks")


def _ask(slots: int):
    """Task function: a block's dictionary by slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = np.cumsum(unplane(batch.column("pairs")[i].as_py(), "<u8"), dtype=U)
                holders = unplane(batch.column("holders")[i].as_py(), "<u4")
                cuts = np.frombuffer(batch.column("cuts")[i].as_py(), "<u4")
                used = np.flatnonzero(np.diff(cuts.astype(np.int64)))
                some = [(cuts[s], cuts[s + 1]) for s in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([batch.column("block")[i].as_py()] * len(used), pa.int64()),
                        pa.array([planes(np.diff(pairs[x:y], prepend=U(0))) for x, y in some], pa.binary()),
                        pa.array([planes(holders[x:y]) for x, y in some], pa.binary()),
                    ],
                    ["slot", "block", "pairs", "holders"],
                )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: of asks sorted by slot, each pair's documents in all, and whether its A id has no pair with more."""

    def answer(slot: int, asks: list) -> Iterator[pa.RecordBatch]:
        parts = [np.cumsum(unplane(p, "<u8"), dtype=U) for _, p, _ in asks]
        found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, inverse, np.concatenate([unplane(h, "<u4") for _, _, h in asks]).astype(np.int64))
        # Pairs are sorted by A's id: its highest count over its stretch.
        left = found >> U(32)
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.concatenate([first, [len(n)]])))
        at = 0
        for (block, _, _), p in zip(asks, parts):
            some = inverse[at : at + len(p)]
            at += len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([slot], pa.int32()), pa.array([planes(n[some])], pa.binary()), pa.array([np.packbits(best[some]).tobytes()], pa.binary())],
                ["block", "slot", "counts", "best"],
            )

    last, asks = None, []
    for batch in batches:
        for slot, block, p, h in zip(*(batch.column(c) for c in ("slot", "block", "pairs", "holders"))):
            if asks and slot.as_py() != last:
                yield from answer(last, asks)
                asks = []
            last = slot.as_py()
            asks.append((block.as_py(), p.as_py(), h.as_py()))
    if asks:
        yield from answer(last, asks)
    asks.clear()
    give_back()


def _score(kind: pa.DataType):
    """Task function: of rows sorted by (block, slot), a block and then the answers in its dictionary's order, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts, best = None, [], []

        def judge() -> pa.RecordBatch:
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            top = np.concatenate([np.zeros(0, bool), *best])
            ends = np.concatenate([[0], np.frombuffer(block["ends"], "<i8")])
            step, times = unplane(block["entries"], "<u4").astype(np.int64), unplane(block["times"], "<u4").astype(np.int64)
            total = np.concatenate([[0], np.cumsum(step)])
            entry = total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * top[entry], times * n[entry])]
            found = [s[ends[1:]] - s[ends[:-1]] for s in sums]
            return pa.RecordBatch.from_arrays(
                [pa.array(block["ids"], kind), *[pa.array(block[s], pa.int64()) for s in STATS], *[pa.array(f, pa.int64()) for f in found], pa.array(block["groups"], pa.string())],
                ["id", *STATS, "n_best", "count_sum", "groups"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                slot = batch.column("slot")[i].as_py()
                if slot < 0:
                    if block is not None:
                        yield judge()
                    block = {n: batch.column(n)[i].as_py() for n in ("ids", *STATS, "groups", "ends", "entries", "times")}
                    counts, best = [], []
                else:
                    counts.append(unplane(batch.column("counts")[i].as_py(), "<i8"))
                    best.append(np.unpackbits(np.frombuffer(batch.column("best")[i].as_py(), np.uint8), count=len(counts[-1])).astype(bool))
        if block is not None:
            yield judge()
        block = None
        give_back()

    return run


def align_tokenizers(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, size: int = RANGE
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a
    sentencepiece model; both encode a blank and the text, special tokens' names
    being plain text. ``groups`` spells the groups as ``a1,a2|b1;a3|b2,b3``, or is
    their SHA-256 with ``digest``. ``count_sum`` adds, over a row's links, how
    many rows hold that pair of ids linked, ``n_best`` counts the links of which
    no other pair with that A id is held by more.

    Null and empty texts, and those whose bytes a vocabulary doesn't give back
    (one that spells U+2581, say), have zeros and an empty ``groups``. Null and
    repeated ids are rows like any other and count as such; further columns
    don't matter; an empty table gives an empty result.

    Tasks hand on blocks of documents with a dictionary of their pairs. Pairs
    are counted in slots by A's id, and each block gets the counts of its own
    dictionary back: nothing is broadcast, no pair is sent once a document. A
    document's spelling is streamed through one task, its different links are
    held there.
    """
    spark = df.sparkSession
    rows = with_key(pick(df, id=id_col, text=text_col), "key")
    kind = rows.schema["id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(n, -(-total // SLOT))
    ddl = BLOCKS.format(id=kind)
    mixed = f"key bigint, id {kind}, no int, n int, low int, high int, text string, {ddl}"
    first = materialize(rows.mapInArrow(_short(a_path, b_path, size, slots, digest, _schema(mixed, spark)), mixed), "aligned")
    names = [c.split()[0] for c in ddl.split(", ")]
    blocks = first.filter("block IS NOT NULL").select(*names)
    long = _long(first.filter("no IS NOT NULL").select("key", "id", "no", "n", "low", "high", "text"), a_path, b_path, slots, digest, ddl)
    if long is not None:
        blocks = blocks.unionByName(long)
    asks = blocks.select("block", "pairs", "holders", "cuts").mapInArrow(_ask(slots), "slot int, block bigint, pairs binary, holders binary")
    arranged = asks.repartition(slots, "slot").sortWithinPartitions("slot")
    answers = arranged.mapInArrow(_answer, "block bigint, slot int, counts binary, best binary")
    own = ["ids", *STATS, "groups", "ends", "entries", "times"]
    types = {f.name: f.dataType for f in blocks.schema}
    asked = blocks.select("block", F.lit(-1).alias("slot"), *own, *[F.lit(None).cast("binary").alias(c) for c in ("counts", "best")])
    replied = answers.select("block", "slot", *[F.lit(None).cast(types[c]).alias(c) for c in own], "counts", "best")
    met = asked.unionByName(replied).repartition(slots, "block").sortWithinPartitions("block", "slot")
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return met.mapInArrow(_score(_schema(f"id {kind}", spark).field("id").type), schema)


@query("op12_align")
def op12_align(spark, sf_dir):
    found = align_tokenizers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})
