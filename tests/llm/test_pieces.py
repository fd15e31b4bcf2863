"""Sampled segmentations: round trips, distinctness, and the distribution against enumeration."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import LONG, ROWS, awkward, stored
from trailframe.llm import pieces

SF = "/root/testdata/sf0.001"
MODEL = pieces.vocabulary("piece_bpe_32k.model")


def paths(lat, unit):
    """All segmentations of a unit with their weights."""
    chars = np.array([ord(c) for c in unit])
    out = [[] for _ in unit]
    for i, j, p, w in zip(*(x.tolist() for x in lat.edges(chars, np.full(len(unit), len(unit))))):
        out[i].append((p, j, w))
    done, todo = [], [((), 0, 1.0)]
    while todo:
        own, at, w = todo.pop()
        if at == len(unit):
            done.append((own, w))
            continue
        todo += [((*own, p), j, w * x) for p, j, x in out[at]]
    total = sum(w for _, w in done)
    return {own: w / total for own, w in done}


def test_distribution_and_inclusion():
    sampler = pieces.Sampler(MODEL, 3, 5)
    text = "the ab"
    each = [paths(sampler.lattices, " " + w) for w in text.split(" ")]
    truth = {a + b: p * q for a, p in each[0].items() for b, q in each[1].items()}
    runs = 6000
    got = sampler.sample([text] * runs, np.arange(runs).astype(np.uint64))
    first, weighted = Counter(), Counter()
    for own in got:
        ids = [tuple(np.frombuffer(s[0], "<u2").tolist()) for s in own]
        assert len(set(ids)) == len(ids) == 3
        values = [s[3] for s in own]
        assert values == sorted(values, reverse=True)
        for i, s in zip(ids, own):
            assert math.isclose(math.exp(s[2]), truth[i], rel_tol=1e-6)
            weighted[i] += truth[i] / math.exp(s[4])
        first[ids[0]] += 1
    for i, p in truth.items():
        # The first sample is an ordinary draw; inclusion weights give an unbiased estimate of every probability.
        assert abs(first[i] / runs - p) < 5 * math.sqrt(p / runs) + 1e-3
        if p > 0.01:
            assert abs(weighted[i] / runs - p) < 0.15 * p + 0.01


def test_all_segmentations_when_few():
    sampler = pieces.Sampler(MODEL, 50, 5)
    text = "qx z"
    each = [paths(sampler.lattices, " " + w) for w in text.split(" ")]
    n = len(each[0]) * len(each[1])
    assert n < 50
    own = sampler.sample([text], np.array([3], dtype=np.uint64))[0]
    assert len(own) == n == len({s[0] for s in own})
    assert {s[4] for s in own} == {0.0} and math.isclose(sum(math.exp(s[2]) for s in own), 1.0)


def check(df, rows, k=3):
    got = pieces.sample_segmentations(df, MODEL, k=k)
    flat = got.select("doc_id", F.posexplode("samples").alias("i", "s")).select("doc_id", "i", "s.*", pieces.decode_ids(F.col("s.ids"), MODEL).alias("text")).collect()
    assert got.count() == len(rows)
    assert {(r["doc_id"], r["text"]) for r in flat} == {(i, t or "") for i, t in rows}
    assert all(r["log_inclusion"] <= 0 and r["log_prob"] <= 1e-9 for r in flat)
    assert len({(r["doc_id"], r["text"], r["ids"]) for r in flat}) == len({(r["doc_id"], r["text"], r["i"]) for r in flat})
    return sorted((str(r["doc_id"]), r["text"], r["i"], bytes(r["ids"]), r["log_inclusion"]) for r in flat)


def test_awkward(spark, tmp_path):
    check(awkward(spark, str(tmp_path / "t")), [(r[0], r[1]) for r in ROWS])


def test_table_in_any_order(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert check(df, rows) == check(df.repartition(7), rows)


def test_query_decodes_its_samples(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op4_sample_pieces(spark, SF).collect():
        want = hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        assert r["decoded_sha256"] == [want] * len(r["samples"]) and r["samples"]


def test_text_without_blanks(spark, tmp_path):
    rows = [(1, "ab▁c" * 6000, "", "", 0), (2, "▁", "", "", 0), (3, " ▁ ", "", "", 0), (4, "  ", "", "", 0)]
    check(stored(spark, rows, str(tmp_path / "t")), [(r[0], r[1]) for r in rows])


def test_empty(spark, tmp_path):
    assert pieces.sample_segmentations(stored(spark, [], str(tmp_path / "t")), MODEL).count() == 0


def test_all_samples_decode_in_one_worker(spark):
    """Every Python node of a plan is one more worker beside each task."""
    df = pieces.op4_sample_pieces(spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_lattices_are_found_by_word():
    sampler = pieces.Sampler(pieces.vocabulary("piece_bpe_32k.model"), 2, 1)
    texts, seeds = ["stone  on stone", "", "stone é"], np.arange(3).astype(np.uint64)
    found = sampler.sample(texts, seeds)
    assert set(sampler.lattices.roots) == {"stone", "", "on", "é"}
    assert found == sampler.sample(texts, seeds) and found[2] == sampler.sample(texts[2:], seeds[2:])[0]


def test_common_words_outlive_the_room(monkeypatch):
    """Full room once cost every word its lattice; now it's only those of one batch."""
    monkeypatch.setattr(pieces, "KEPT", 4_000)
    sampler, plain = pieces.Sampler(MODEL, 2, 1), pieces.Sampler(MODEL, 2, 1)
    added = []
    sampler.lattices.add = lambda words: (added.extend(words), pieces.Lattices.add(sampler.lattices, words))[1]
    for i in range(60):
        texts, seeds = [f"stone on stones {' '.join(f'w{i}x{j}' for j in range(60))} 🙂 é"], np.array([i], np.uint64)
        got = sampler.sample(texts, seeds)
        plain.lattices.clear()
        assert got == plain.sample(texts, seeds)
        assert sampler.lattices.held < 8_000
    assert Counter(added)["stone"] == 1 == Counter(added)["🙂"] and len(added) == 60 * 60 + 5


def test_units_of_rare_characters():
    """Long and rare words, whose sums no number holds without logarithms, have the same shares by both ways."""
    lat = pieces.Lattices(MODEL)
    words = ["stone", "🙂" * 40, "a" * 61, "é", "𝒳" * 59 + "a", "", "z" * 300, "on"]
    lat.add(words)
    for number, word in enumerate(words):
        alone = pieces.Lattices(MODEL)
        alone.start = alone.size = alone.hits = np.zeros(1, np.int64)
        alone._add([word], np.zeros(1, np.int64), True)
        first = lat.first[lat.start[number] : lat.start[number] + lat.size[number] + 1]
        assert np.array_equal(first - first[0], alone.first[: alone.nodes + 1]) and lat.size[number] == len(word) + 1
        own = slice(first[0], first[-1])
        assert np.array_equal(lat.piece[own], alone.piece[: alone.held])
        assert np.allclose(lat.share[own], alone.share[: alone.held], rtol=1e-9, atol=0)
        assert np.allclose(np.add.reduceat(lat.share[own], first[:-1] - first[0]), 1)


def test_more_samples_than_two():
    """Paths kept over several rounds have the probabilities that enumeration gives, and values descend."""
    sampler = pieces.Sampler(MODEL, 9, 3)
    texts = ["stone on stones", "a", "", "qx z é", "stones on"]
    for text, own in zip(texts, sampler.sample(texts, np.arange(5).astype(np.uint64))):
        truth = [1.0]
        for word in text.split(" ") if text else []:
            truth = [p * q for p in truth for q in paths(sampler.lattices, " " + word).values()]
        assert len({s[0] for s in own}) == len(own) == min(9, len(truth))
        assert [s[3] for s in own] == sorted((s[3] for s in own), reverse=True)
        assert all(np.isclose(math.exp(s[2]), truth, rtol=1e-6, atol=0).any() for s in own)


def test_samples_are_decoded_together(spark):
    """Null and empty samples between others, more than one step takes, are spelled each by itself."""
    sampler = pieces.Sampler(MODEL, 2, 1)
    texts = ["stone 🙂", "", " a  b ", LONG, "é"] * 3
    rows = [(i, [s[0] for s in own] + [None, b""]) for i, own in enumerate(sampler.sample(texts, np.arange(len(texts)).astype(np.uint64)))]
    df = spark.createDataFrame([*rows, (-1, None), (-2, [])], "i int, ids array<binary>").coalesce(1)
    got = {r["i"]: r["t"] for r in df.select("i", pieces.decoder(MODEL)("ids").alias("t")).collect()}
    assert got == {**{i: [texts[i]] * (len(ids) - 2) + [None, ""] for i, ids in rows}, -1: None, -2: []}
