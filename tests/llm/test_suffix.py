"""Suffix arrays and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import suffix_dedup as sd
from trailframe.llm.suffix_groups import common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 3))
def test_suffix_array(text, times):
    text = text * times
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    shared = common_prefixes(text, order)
    for r in range(1, len(order)):
        a, b = text[order[r - 1] :], text[order[r] :]
        assert shared[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def expected(rows, width):
    count = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for at in range(len(b) - width + 1):
            w = b[at : at + width]
            count[w] = count.get(w, 0) + 1
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        at = 0
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                for k in range(max(s, at), s + width):
                    gone[k] = True
                at = s + width
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df, width, gram):
    got = sd.remove_repeats(df, width=width, gram=gram).collect()
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in got), key=str)


def test_awkward(spark, tmp_path):
    df = awkward(spark, str(tmp_path / "t"))
    assert result(df, 200, 64) == expected([(r[0], r[1]) for r in ROWS], 200)


def test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in sd.op8_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == expected([(r["doc_id"], r["text"]) for r in df.collect()], 200)


def passages(seed, n):
    """Copies, edits, passages that overlap, and texts that repeat themselves."""
    rnd = random.Random(seed)
    noise = lambda k: "".join(rnd.choice("abcdé ") for _ in range(k))
    bases, rows = [noise(rnd.randrange(20, 160)) for _ in range(6)], []
    for i in range(n):
        t = noise(rnd.randrange(0, 40))
        for _ in range(rnd.randrange(0, 4)):
            b = rnd.choice(bases)
            a = rnd.randrange(len(b))
            part = list(b[a : a + rnd.randrange(10, 120)])
            if part and rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = rnd.choice("xyz")
            t += "".join(part) + noise(rnd.randrange(0, 6))
        if rnd.random() < 0.1:
            t += rnd.choice(["ab", "a", "abcab"]) * rnd.randrange(5, 60)
        rows.append((i, t, "", "", 0))
    return rows


@pytest.mark.parametrize("width,gram,meet,piece", [(24, 8, 8192, 1 << 20), (24, 8, 3, 64), (40, 16, 8192, 100)])
def test_passages(spark, tmp_path, monkeypatch, width, gram, meet, piece):
    """Small limits take the way for crowded anchors and cut texts into pieces."""
    monkeypatch.setattr(sd, "PIECE", piece)
    monkeypatch.setattr(sd, "CHUNK", 300)
    plain = sd.repeated_spans
    monkeypatch.setattr(sd, "repeated_spans", lambda rows, w, g: plain(rows, w, g, meet))
    rows = passages(width + meet, 150)
    df = stored(spark, rows, str(tmp_path / "t"))
    assert result(df, width, gram) == expected([(r[0], r[1]) for r in rows], width)


def test_empty(spark, tmp_path):
    assert sd.remove_repeats(stored(spark, [], str(tmp_path / "t"))).count() == 0


def dealt(texts):
    """Records of each anchor that one chunk of texts deals by the anchor's hash."""
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(len(texts)), pa.int64()), "text": texts})
    packed = [r for b in sd._pack(200, 64, 32)(iter([batch])) for r in b.to_pylist()]
    grams = np.concatenate([sd.from_planes(r["anchors"])["gram"] for r in packed if r["kind"] == 1])
    return np.unique(grams, return_counts=True)[1]


def test_hot_anchor_is_not_one_tasks():
    """A text in many rows, and a passage in many different texts, come to a slot a few times a chunk only."""
    rnd = random.Random(5)
    noise = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    text, passage = noise(2500), noise(300)
    assert dealt([text] * 3000).max() == 1
    assert dealt([noise(250) + passage + noise(250) for _ in range(3000)]).max() <= 64


@pytest.mark.parametrize("meet", [8192, 3])
def test_anchors_kept_apart(spark, tmp_path, monkeypatch, meet):
    """Anchors that are crowded in some chunks and not in others."""
    monkeypatch.setattr(sd, "CHUNK", 150)
    monkeypatch.setattr(sd, "COMMON", 2)
    plain = sd.repeated_spans
    monkeypatch.setattr(sd, "repeated_spans", lambda rows, w, g: plain(rows, w, g, meet))
    rows = passages(7, 200)
    rows += [(1000 + i, *rows[i % 20][1:]) for i in range(60)]
    df = stored(spark, rows, str(tmp_path / "t"))
    assert result(df, 24, 8) == expected([(r[0], r[1]) for r in rows], 24)


def test_slots_share_anchors_evenly():
    """Anchors are elected for small hashes; the slots they are dealt to don't follow those."""
    rnd = random.Random(12)
    texts = pa.array(["".join(rnd.choice("abcdefgh ijklmnop") for _ in range(4000)) for _ in range(60)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), texts], ["key", "text"])
    for slots in (32, 204):
        sizes = [0] * slots
        for out in sd._pack(200, 64, slots)(iter([batch])):
            for slot, kind, data in zip(*(out.column(c).to_pylist() for c in ("slot", "kind", "anchors"))):
                sizes[slot] += len(sd.from_planes(data)) if kind == 1 else 0
        assert max(sizes) < 3 * sum(sizes) / slots + 20
