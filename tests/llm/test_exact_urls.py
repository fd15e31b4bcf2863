"""Exact duplicates and URL rules against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from tests.compare import connect, difference
from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import exact, urls

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_exact(df, rows, block):
    got = exact.exact_dedup(df, block=block).collect()
    bodies = [((t or "").translate(LOWER), i) for i, t in rows]
    size = Counter(b for b, _ in bodies)
    best = {}
    for b, i in bodies:
        best[b] = max((x for x in (best.get(b), i) if x is not None), default=None)
    want = Counter((i, best[b], size[b], hashlib.sha256(b.encode()).hexdigest()) for b, i in bodies)
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(size)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_awkward(spark, tmp_path, block):
    check_exact(awkward(spark, str(tmp_path / "t")), [(r[0], r[1]) for r in ROWS], block)


def test_exact_small_blocks(spark, tmp_path):
    """Many levels, periodic texts, texts that share blocks at other places."""
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9))) * rnd.randrange(0, 5), "", "", 0) for i in range(400)]
    check_exact(stored(spark, rows, str(tmp_path / "t")), [(r[0], r[1]) for r in rows], 2)


def test_exact_empty(spark, tmp_path):
    assert exact.exact_dedup(stored(spark, [], str(tmp_path / "t"))).count() == 0


def test_exact_table(spark):
    got = exact.op1_exact_dedup(spark, SF).toPandas()
    assert difference(got, connect(SF).execute(exact.SQL).df()) is None


def test_urls_table(spark):
    got = urls.op6_url_rules(spark, SF).toPandas()
    assert difference(got, connect(SF).execute(urls.SQL).df()) is None


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls_random(spark, tmp_path):
    rnd = random.Random(5)
    labels = ["a", "b", "com", "a-b", "ab", "net", "x\x01a"]
    name = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 4)))
    paths = ["/", "/x/", "/x/y/", "/xy", ""]
    found = {(name().replace("x\x01a", "q"), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(25)}
    rules = [(h, p, v) for (h, p), v in found.items()]
    # Longest wins; drop rules whose text is as long as another's of the same fit to keep the answer unique.
    pages = [(i, f"http://{name().upper()}{rnd.choice(paths)}z?q#f") for i in range(600)]
    pages += [(None, None), (1, ""), (1, "no scheme"), (2, "x://"), (3, "http://a.com"), (3, "http://a.com"), (None, "http://a.com?x"), (4, "http://.com/x/"), (2**60 + 1, "http://com./x/")]
    pages += [(10_000 + i, "http://hot.a.com/x/y/") for i in range(800)]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])
    df = stored(spark, [(*p, "h") for p in pages], str(tmp_path / "t"), schema)
    table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    got = urls.url_rules(df, table, parts=7).collect()
    want = Counter()
    for i, u in pages:
        host, path, rule, verdict = plain(u, rules)
        want[(i, host, path, len(rule or ""))] += 1
    assert Counter((r["page_id"], r["host"], r["path"], len(r["rule"] or "")) for r in got) == want
    texts = {h + p: v for h, p, v in rules}
    assert all(r["verdict"] == (texts[r["rule"]] if r["rule"] else "allow") for r in got)
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.url_rules(df, nothing).collect()} == {"allow"}
    assert urls.url_rules(df.filter("page_id > 99 and page_id < 0"), table).count() == 0
