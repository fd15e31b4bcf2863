"""Tokens of two vocabularies: against plain overlaps, ranges of any size, associativity, awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import alignment
from trailframe.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


@pytest.fixture(scope="module")
def libs(pair):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), pair.bytes_a, pair.bytes_b


def groups_of(libs, text):
    """Groups and links of one text, token by token."""
    lib_a, lib_b, bytes_a, bytes_b = libs
    body = (" " + (text or "")).encode()
    a, b = lib_a.encode(" " + (text or ""), add_special_tokens=False).ids, lib_b.encode(text or "")
    if not text or b"".join(bytes_a[i] for i in a) != body or b"".join(bytes_b[i] for i in b) != body:
        return [], [], [], []
    spans = []
    for ids, by in ((a, bytes_a), (b, bytes_b)):
        ends = np.cumsum([len(by[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    groups, at_a, at_b = [], 0, 0
    place = [{s[1]: i + 1 for i, s in enumerate(side)} for side in spans]
    for cut in sorted(place[0].keys() & place[1].keys()):
        to_a, to_b = place[0][cut], place[1][cut]
        groups.append((a[at_a:to_a], b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    links, j = [], 0
    for x0, x1, i in spans[0]:
        j = next(k for k in range(j, len(spans[1])) if spans[1][k][1] > x0)
        k = j
        while k < len(spans[1]) and spans[1][k][0] < x1:
            links.append((i, spans[1][k][2]))
            k += 1
    return a, b, groups, links


def plain(libs, docs):
    found = [(i, *groups_of(libs, t)) for i, t in docs]
    held = Counter(p for *_, links in found for p in set(links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for name, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((name, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text))
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


TRICKY = [" ", "  ", "   ", "\n", "\t", "a", "it's", "Bé", "12", "...", "🙂", "ing", "<|endoftext|>", "<s>", "\x85", "　", "'s", "ß!", "日本語", "\x1c", "naïve", "▁"]


def test_ids_are_those_of_the_whole_text(pair, libs):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(TRICKY[:-1]) for _ in range(rnd.randrange(1, 16))) for _ in range(3000)]
    texts += [" ".join(rnd.choice(TRICKY) for _ in range(rnd.randrange(1, 16))) for _ in range(2000)]
    texts += ["".join(chr(c) + " x" for c in range(s, s + 64) if not 0xD800 <= c < 0xE000) for s in range(1, 0x11000, 64)]
    for text, coded in zip(texts, pair.encode(texts)):
        a, b, _, _ = groups_of(libs, text)
        got = ([], []) if coded is None else tuple(np.frombuffer(x, "<u4").tolist() for x in coded)
        assert got == (a, b), repr(text)


def test_fragments_compose_in_any_order(pair, libs):
    """A range is the same however it is cut, and however its parts are bracketed."""
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("aeiounstrlé日-") for _ in range(rnd.randrange(1, 40))) for _ in range(60))
    a, b, groups, _ = groups_of(libs, text)
    want = [(np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes()) for x, y in groups]
    n = len((" " + text).encode())
    for size in (2, 10, 50, 700, n):
        leaves = []
        for no, low, high, context in alignment.ranges(text, size):
            f, closed = alignment.fragment(pair, pair.encode([context])[0], low, high)
            done = alignment.Aligned(pair, [closed])
            leaves.append((f, [] if done.n_groups[0] == 0 else done.groups[0].decode().split(";")))
        while len(leaves) > 1:
            i = rnd.randrange(len(leaves) - 1)
            (left, x), (right, y) = leaves[i : i + 2]
            f, closed = left.then(right)
            leaves[i : i + 2] = [(f, x + ([] if closed is None else [alignment.Aligned(pair, [closed]).groups[0].decode()]) + y)]
        f, found = leaves[0]
        assert f.cut and f.tail == (b"", b"")
        first = alignment.Aligned(pair, [f.head]).groups[0].decode()
        assert ";".join([first, *found]) == ";".join(alignment.Aligned(pair, [g]).groups[0].decode() for g in want)


@pytest.mark.parametrize("size", [7, 100, alignment.RANGE])
def test_awkward(spark, tmp_path, libs, size):
    """Every text over ``size`` bytes goes up the tree."""
    df = awkward(spark, str(tmp_path / "t"))
    rows = [(r[0], r[1]) for r in ROWS if size > 7 or r[0] not in (6, 7)]
    df = df if size > 7 else df.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    same(alignment.align_tokenizers(df, A, B, size=size).collect(), plain(libs, rows))


def test_small_blocks(spark, tmp_path, libs, monkeypatch):
    monkeypatch.setattr(alignment, "STEP", 300)
    rnd = random.Random(6)
    rows = [(i % 90, "".join(rnd.choice(TRICKY) + rnd.choice(["", " "]) for _ in range(rnd.randrange(0, 90))), "en", "s", 0) for i in range(120)]
    df = stored(spark, rows, str(tmp_path / "t"))
    same(alignment.align_tokenizers(df, A, B, size=150).collect(), plain(libs, [(r[0], r[1]) for r in rows]))


def test_table(spark, libs):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in plain(libs, rows)]
    got = alignment.op12_align(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(got.collect(), want)


def test_empty(spark, tmp_path):
    assert alignment.align_tokenizers(stored(spark, [], str(tmp_path / "t")), A, B).count() == 0
    got = alignment.align_tokenizers(stored(spark, [(1, None, None, None, 0), (2, "", "en", "a", 0)], str(tmp_path / "u")), A, B, digest=True)
    same(got.collect(), [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_a_word_is_encoded_once_whatever_signs_follow(libs):
    own = alignment.Pair(A, B)
    texts = ["stone stone, stone. stone!!\nstone %%% été:", "stone?\nété;\nStone", "a\tstone, 3.5, x1, it's, été,", "stone▁, x", "<s>. </s>,\nstone"]
    for text, coded in zip(texts, own.encode(texts)):
        a, b, _, _ = groups_of(libs, text)
        assert (coded is None) == (not a)
        assert coded is None or [np.frombuffer(x, "<u4").tolist() for x in coded] == [a, b]
    assert not {"stone,", "stone.", "stone?"} & own.words.keys() and {"stone", "été"} <= own.words.keys() | own.lines.keys()
    assert own.encode(texts) == own.encode(texts)
