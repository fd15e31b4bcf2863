"""Phrases: against plain counting, shards of any size, awkward rows."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import phrases
from trailframe.llm.rows import UPPER

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(UPPER, UPPER.lower())


def plain(docs, support=10, longest=3, inside=50, most=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    drop = set()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= inside * cands[lang, w[i : i + k]]:
                    drop.add((lang, w[i : i + k]))
    found = {}
    for (lang, w), a in cands.items():
        if (lang, w) not in drop:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in sorted(found.items()) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:most])]


def result(df):
    return sorted(tuple(r) for r in df.collect())


def docs_of(rows):
    return [(r[2], r[1]) for r in rows]


def test_awkward(spark, tmp_path):
    df = awkward(spark, str(tmp_path / "t"))
    for support in (1, 2, 3):
        assert result(phrases.collocations(df, support=support)) == sorted(plain(docs_of(ROWS), support))


@pytest.mark.parametrize("shard", [100, 5_000, phrases.SHARD])
def test_shards_of_any_size(spark, tmp_path, shard):
    """Few large shards have a local bound over one, many small ones have a bound of one."""
    rnd = random.Random(3)
    words = ["a", "A", "b", "é", "c,", "d.", "x\ty", "z\n", "q  r", "日本", "|"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))), rnd.choice(["en", "de", None]), "s", 0) for i in range(300)]
    df = stored(spark, rows, str(tmp_path / "t")).coalesce(2)
    for support, longest in ((10, 3), (40, 4)):
        got = result(phrases.collocations(df, support=support, longest=longest, shard=shard))
        assert got == sorted(plain(docs_of(rows), support, longest))
    assert len(got) > 20


def test_full_filter_and_ranks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = [(i, "one two three four. " * 3 + f"w{i % 5} w{i % 7} end", "en", "s", 0) for i in range(60)]
    df = stored(spark, rows, str(tmp_path / "t"))
    assert result(phrases.collocations(df, most=5)) == plain(docs_of(rows), most=5)


def test_table_and_sql(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    got = result(phrases.op11_phrases(spark, SF))
    assert got == sorted(plain([tuple(r) for r in rows]))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(duckdb.sql(phrases.SQL).fetchall()) == got


def test_empty(spark, tmp_path):
    assert phrases.collocations(stored(spark, [], str(tmp_path / "t"))).count() == 0
    assert phrases.collocations(stored(spark, [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " . \t", "en", "a", 0)], str(tmp_path / "u"))).count() == 0


def test_counting_holds_little_at_a_time(monkeypatch):
    """Eight megabytes of text in one task: what is held follows the step, not the text."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class All:
        def has(self, hashes):
            return np.ones(len(hashes), bool)

    monkeypatch.setattr(phrases.Filter, "of", classmethod(lambda cls, *a: All()))
    monkeypatch.setattr(phrases, "give_back", lambda: None)
    text = " ".join(f"w{i % 5000}" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 64, "text": [text] * 64})
    tracemalloc.start()
    out = [b for b in phrases._count(3, "", 1, 64)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20, peak >> 20
    words = sum(b.column("f")[i].as_py() for b in out for i in range(b.num_rows) if b.column("size")[i].as_py() == 0)
    assert words == 64 * 20_000 and max(b.num_rows for b in out) <= 20_000


def test_mining_holds_little_at_a_time(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(phrases, "give_back", lambda: None)
    text = " ".join(f"w{i % 5000}" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 64, "text": [text] * 64})
    tracemalloc.start()
    n = sum(b.num_rows for b in phrases._mine(10, 3, 64 * len(text), 8, phrases.SHARD)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 150 << 20, peak >> 20
