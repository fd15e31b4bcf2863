"""Word shingles of whole texts as 64-bit numbers, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from trailframe.llm.rows import UPPER

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finisher)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: is it white space; its number after lower-casing A-Z."""
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256)
    for c in UPPER.encode():
        lower[c] = c + 32
    return space, mix(lower.astype(U) + U(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x2545F4914F6CDD1D
    up, down = np.full(n, base, dtype=U), np.full(n, pow(base, -1, 1 << 64), dtype=U)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Shingler:
    """``sets`` gives the distinct shingles of each text, sorted; ``size`` words to a shingle."""

    def __init__(self, size: int):
        self.size = size
        self.space, self.number = byte_tables()
        self.up, self.down = powers(1 << 16)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Null counts as empty; a text with fewer words is one shingle; without words it has none."""
        raw = texts.fill_null("").cast(pa.large_binary())
        raw = pa.array(raw.to_pylist(), pa.large_binary()) if raw.offset else raw
        n = len(raw)
        if n == 0:
            return []
        ends = np.frombuffer(raw.buffers()[1], np.int64, n + 1)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        doc, word = self.words(data, ends)
        k = self.size
        out_doc, out = doc[: max(0, len(doc) - k + 1)], np.zeros(max(0, len(word) - k + 1), dtype=U)
        for i in range(k):
            out = mix(out * U(0x100000001B3) + word[i : i + len(out)])
        whole = out_doc == doc[k - 1 :][: len(out_doc)] if len(out) else np.zeros(0, bool)
        out_doc, out = out_doc[whole], out[whole]
        firsts = np.searchsorted(out_doc, np.arange(n + 1))
        starts = np.searchsorted(doc, np.arange(n + 1))
        found = []
        for i in range(n):
            if firsts[i + 1] > firsts[i]:
                found.append(np.unique(out[firsts[i] : firsts[i + 1]]))
            elif starts[i + 1] > starts[i]:
                few = np.full(1, starts[i + 1] - starts[i], dtype=U)
                for w in word[starts[i] : starts[i + 1]]:
                    few = mix(few * U(0x100000001B3) + w)
                found.append(few)
            else:
                found.append(np.zeros(0, dtype=U))
        return found

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of every word, in order."""
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        if len(data) > len(self.up):
            self.up, self.down = powers(1 << int(len(data)).bit_length())
        text = ~self.space[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[ends] = True
        before = np.empty(len(data), dtype=bool)
        before[0] = False
        before[1:] = text[:-1]
        begin = np.flatnonzero(text & (~before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        after[-1] = False
        after[:-1] = text[1:]
        end = np.flatnonzero(text & (~after | edge[1:])) + 1
        total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.number[data] * self.up[: len(data)], out=total[1:])
        word = mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(U))
        return np.searchsorted(ends, begin, "right") - 1, word
