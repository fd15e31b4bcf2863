"""Token files: exact round trips, select, awkward rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import tokens

SF = "/root/testdata/sf0.001"
PATH = tokens.vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3], [2**40, 2**40, 2**63], list(range(0, 9000, 7)), sorted(random.Random(1).randrange(10**9) for _ in range(3000))])
def test_elias_fano(values):
    made = tokens.EliasFano.unpack(tokens.EliasFano.of(np.array(values, dtype=np.uint64)).pack())
    assert made.all().tolist() == values
    for i in {0, 1, len(values) // 2, 255, 256, 257, len(values) - 1} & set(range(len(values))):
        assert made.select(i) == values[i]
    for start, stop in {(0, 0), (0, len(values)), (1, 2), (255, 257), (256, 700), (len(values) - 3, len(values))}:
        if 0 <= start <= stop <= len(values):
            assert made.part(start, stop).tolist() == values[start:stop]
    if len(values) > 2000:
        assert len(tokens.EliasFano.of(np.array(values, dtype=np.uint64)).pack()) < len(values) * 8 / 2


def test_elias_fano_of_many_sparse_values():
    """Packing needs memory in proportion to the values, a run of them at a time."""
    values = np.cumsum(np.random.default_rng(3).integers(0, 1 << 34, 300_000)).astype(np.uint64)
    tracemalloc.start()
    made = tokens.EliasFano.of(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(values)
    assert (made.all() == values).all()
    assert [made.select(i) for i in (0, 70_000, 299_999)] == values[[0, 70_000, 299_999]].tolist()


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_encode_as_texts_do():
    rnd = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "a", "it's", "Bé", "12", "...", "🙂", " ", "<|endoftext|>", "\x85", "　", "'s", "ß!"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14))) for _ in range(4000)]
    texts += [r[1] or "" for r in ROWS]
    got = [np.frombuffer(b, "<u2").tolist() for b in tokens.Encoder(PATH).encode(texts)]
    assert got == plain(texts)


def check(df, rows, path, file_ids):
    manifest = tokens.write_tokens(df, path, PATH, file_ids=file_ids)
    got = sorted((tuple(r) for r in tokens.read_tokens(manifest).collect()), key=lambda r: r[1])
    ids = plain([t or "" for _, t in rows])
    want = sorted(((i, zlib.crc32(np.array([*x, 0], dtype="<u4").tobytes()), len(x) + 1) for (i, _), x in zip(rows, ids)), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), r[3], r[2]) for r in got) == sorted((str(i), c, n) for i, c, n in want)
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    return manifest


def test_awkward(spark, tmp_path):
    df = awkward(spark, str(tmp_path / "t"))
    rows = [(r[0], r[1]) for r in ROWS]
    files = check(df, rows, str(tmp_path / "a"), 50).collect()
    assert len(files) > 5
    f = tokens.TokenFile(files[0]["file"])
    assert [f.document(i).tolist() for i in range(f.n)][-1][-1] == 0
    check(df, rows, f"file:{tmp_path}/b", tokens.FILE_IDS)


def test_table(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()], str(tmp_path / "a"), 10_000)


def test_empty(spark, tmp_path):
    assert tokens.read_tokens(tokens.write_tokens(stored(spark, [], str(tmp_path / "t")), str(tmp_path / "a"), PATH)).count() == 0
