"""N-gram join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import ngram_join as nj
from trailframe.llm.components import components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def expected(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        name[r] = min((x for x in (name.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), name[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def check(df, rows, k, percent):
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in nj.ngram_jaccard(df, words=k, percent=percent).collect()), key=str)
    assert got == expected(rows, k, percent)


def test_awkward(spark, tmp_path):
    check(awkward(spark, str(tmp_path / "t")), [(r[0], r[1]) for r in ROWS], 4, 85)


def test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()], 4, 85)


def families(seed, n):
    """Near copies around the limit, chains of them, and a passage that unrelated texts share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = [word() for _ in range(30)]
    rows, bases = [], [[word() for _ in range(rnd.randrange(5, 90))] for _ in range(12)]
    for i in range(n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            text[rnd.randrange(len(text))] = word()
        if rnd.random() < 0.3:
            text = [word() for _ in range(rnd.randrange(0, 40))] + passage
        rows.append((i * 7 % n, " ".join(text), "", "", 0))
        if rnd.random() < 0.2:
            bases[rnd.randrange(len(bases))] = text
    return rows


@pytest.mark.parametrize("block", [nj.BLOCK, 8])
def test_families(spark, tmp_path, block, monkeypatch):
    """Small blocks and chunks make homes and prefix groups split."""
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "CHUNK_GRAMS", 3000)
    monkeypatch.setattr(nj, "COMMON", 3)
    rows = families(block, 500)
    check(stored(spark, rows, str(tmp_path / "t")), [(r[0], r[1]) for r in rows], 3, 80)


def test_tree_finds_all_links():
    rnd = np.random.default_rng(4)
    base = np.sort(rnd.choice(10_000, 60, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        s[rnd.choice(60, rnd.integers(0, 12), replace=False)] = rnd.integers(20_000, 10**6, 1).astype(np.uint64)
        sets.append(np.unique(s[: rnd.integers(20, 61)]))
    tree = nj.Tree(80)
    for s in sets:
        tree.add(s, len(s))
    parent = list(range(len(sets)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            assert (find(i) == find(j)) == (tree.find(i) == tree.find(j))


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_empty(spark, tmp_path):
    assert nj.ngram_jaccard(stored(spark, [], str(tmp_path / "t"))).count() == 0
