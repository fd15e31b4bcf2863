"""The cache on disk: many writers, compaction beside them, expiry."""

import threading

from trailframe.sources.cache import DAY_S, CacheStore


def rows(spark, pairs, seq=0):
    return spark.createDataFrame([(k, v, seq) for k, v in pairs], "key string, value string, seq long")


def held(store):
    return {r.key: r.value for r in store.entries().collect()}


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    path, errors = f"file:{tmp_path}/cache", []

    def write(writer):
        try:
            store = CacheStore(spark, path)
            for i in range(3):
                store.append(rows(spark, [(f"{writer}-{i}-{j}", "v") for j in range(20)] + [("all", f"{writer}")], seq=writer), now=1000.0 + i)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    store = CacheStore(spark, path)
    seen = 0
    while any(t.is_alive() for t in threads):
        n = store.entries().filter("key <> 'all'").count()
        assert n % 20 == 0 and n >= seen
        seen = n
        store.compact(1000.0 + DAY_S, keep_days=1)
    assert not errors
    got = held(store)
    assert len(got) == 4 * 3 * 20 + 1 and got["all"] == "3"


def test_expiry_last_write_and_compaction(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "c"))
    assert held(store) == {} and store.compact(0.0) == 0
    assert [r.value for r in store.get(rows(spark, [("a", "")]).select("key"), 5.0).collect()] == [None]
    store.append(rows(spark, [("a", "old"), ("b", "b0")]).unionByName(rows(spark, [("b", "b1")], seq=1)), now=10.0, ttl=1e9)
    store.append(rows(spark, [("a", "new"), ("c", "c0"), (None, "n")]), now=DAY_S + 10.0, ttl=100.0)
    wanted = rows(spark, [("a", ""), ("b", ""), ("c", ""), ("d", "")]).select("key")
    values = lambda now: {r.key: r.value for r in store.get(wanted, now).collect()}
    assert values(DAY_S + 109.0) == {"a": "new", "b": "b1", "c": "c0", "d": None}
    # An entry expires at its very second, and the older one of its key doesn't come back, compacted or not.
    late = {"a": None, "b": "b1", "c": None, "d": None}
    assert values(DAY_S + 110.0) == late
    assert store.compact(3.0 * DAY_S, keep_days=2) == 2 and values(DAY_S + 110.0) == late
    assert store.compact(3.0 * DAY_S, keep_days=2) == 1 and held(store) == {"b": "b1"}
    store.append(rows(spark, [("a", "again")]), now=3.0 * DAY_S)
    assert values(3.0 * DAY_S + 1) == {"a": "again", "b": "b1", "c": None, "d": None}
