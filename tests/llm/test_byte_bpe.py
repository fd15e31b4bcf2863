"""Byte-level BPE: the transducer against plain merging and against tiktoken, round trips, awkward rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import byte_bpe
from trailframe.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PATTERN = public_tokenizers.PATTERN


def plain(name):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(vocabulary(name)), special_tokens={})


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), "<i4").tolist()


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    return byte_bpe.ByteBpe(vocabulary(request.param), PATTERN), plain(request.param)


def test_random_texts(pair):
    coder, lib = pair
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "it's", "Bé", "12", "...", "🙂", "ing", "the", "<|endoftext|>", "\x85", "　", "'s", "ß!", "zz", "aa", "\x1c", "ab", "日本"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 16))) for _ in range(5000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x3000)])) for _ in range(30)) for _ in range(1500)]
    texts += [r[1] or "" for r in ROWS]
    for text in texts:
        assert ids_of(coder, text) == lib.encode_ordinary(text), repr(text)
        assert "".join(coder.decode(ids_of(coder, text))) == text


def test_every_character(pair):
    coder, lib = pair
    text = "".join(chr(c) + "x " for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    assert ids_of(coder, text) == lib.encode_ordinary(text)


def test_long_pieces(pair):
    coder, lib = pair
    rnd = random.Random(6)
    for alphabet in ("a", "ab", "the ing", "aeiouns", "_-", "\n "):
        for n in (1, 7, 130, 3000):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            assert ids_of(coder, text) == lib.encode_ordinary(text)
    assert "".join(coder.decode(ids_of(coder, "ab" * 200_000))) == "ab" * 200_000


def test_words_beyond_the_bound_of_states(pair):
    coder, lib = byte_bpe.ByteBpe(vocabulary(NAMES[0]), PATTERN, most_states=50), plain(NAMES[0])
    rnd = random.Random(10)
    for _ in range(3000):
        text = "x " + "".join(rnd.choice(["ing", "tion", "é", "a", "sh", "qu", "Z", "9", "--", "the", "'s"]) for _ in range(rnd.randrange(1, 7)))
        assert ids_of(coder, text) == lib.encode_ordinary(text)


def test_small_ranks_follow_merging():
    """Ranks where order matters, states dropped all the time."""
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    for data in (b"bc", b"ab", b"aa", b"abc", b"cb", b"aab", b"bca", b"cbc", b"aaaa"):
        ranks[data] = len(ranks)
    for most in (1, 3, 1000):
        machine = byte_bpe.Transducer(ranks, most)
        rnd = random.Random(7)
        for _ in range(3000):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.choice([2, 5, 13, 60])))
            assert machine.ids(data) == machine.walk(data) == byte_bpe.merge(ranks, data)


def test_neighbours_fit_as_merging_says():
    for name in NAMES:
        ranks = byte_bpe.read_ranks(vocabulary(name))
        machine = byte_bpe.Transducer(ranks)
        rnd = random.Random(9)
        common = [r for r in range(6000) if b"  " not in machine.bytes[r]]
        for _ in range(40_000):
            left, right = (rnd.choice(common) if rnd.random() < 0.7 else rnd.randrange(len(ranks)) for _ in "ab")
            if max(len(machine.bytes[left]), len(machine.bytes[right])) < 16:
                assert machine.fits(left, right) == (byte_bpe.merge(ranks, machine.bytes[left] + machine.bytes[right]) == [left, right])


def test_ids_come_out_on_the_way():
    """A long piece doesn't wait for its end: states stay small, most ids are out before it."""
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(vocabulary(NAMES[0])))
    state, out = 0, []
    for byte in b"internationalisation" * 50:
        state, more = machine.edge(state, byte)
        out += more
        assert len(machine.states[state][1]) < 60
    assert len(machine.end(state)) < 10 < len(out)


def test_utf8_machine():
    rnd = random.Random(8)
    data = "aé日🙂ࠀ퟿\U0010ffff".encode() * 20
    for _ in range(200):
        machine, at, out = byte_bpe.Utf8Machine(), 0, ""
        while at < len(data):
            n = rnd.randrange(1, 6)
            out += machine.feed(data[at : at + n])
            at += n
        assert out + machine.finish() == data.decode()
    for bad in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\xe2\x82", b"a\x80b", b"\xf0\x80\x80\x80"):
        machine = byte_bpe.Utf8Machine()
        assert "".join([*(machine.feed(bad[i : i + 1]) for i in range(len(bad))), machine.finish()]).replace("�", "") == bad.decode("utf-8", "ignore")


def digests(lib, doc_id, text):
    ids = lib.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_awkward(spark, tmp_path):
    df = awkward(spark, str(tmp_path / "documents.parquet"))
    lib = plain(NAMES[0])
    assert ordered(byte_bpe.op13_byte_bpe(spark, str(tmp_path)).collect()) == ordered(digests(lib, r[0], r[1]) for r in ROWS)
    assert byte_bpe.decode_ids(df.limit(0).selectExpr("doc_id id", "array(1) ids"), vocabulary(NAMES[0]), PATTERN).count() == 0


def test_table(spark):
    lib = plain(NAMES[0])
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert ordered(byte_bpe.op13_byte_bpe(spark, SF).collect()) == ordered(digests(lib, *r) for r in rows)


def test_empty(spark, tmp_path):
    assert byte_bpe.encode_texts(stored(spark, [], str(tmp_path / "t")), vocabulary(NAMES[0]), PATTERN).count() == 0
