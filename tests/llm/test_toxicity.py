"""Toxicity: folding, exceptions, held-out accuracy, awkward rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.cases import ROWS, awkward, stored
from trailframe.llm import toxicity as tox

SF = "/root/testdata/sf0.1"
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


def test_folding():
    table = tox.Folding()
    for text in ("Stupid", "$tupid", "5tüp1d", "stuріd", "s​tupid"):
        assert tox.fold(text, table) == " stupid "
    assert tox.fold("the$$$ a&&& (x)!", table) == " the a x "
    assert tox.fold("", table).strip() == ""


def test_exceptions_and_length():
    lexicon = tox.Lexicon({" trash ": 5.0, " trashy": 2.0, " tra": 1.0}, ("trash can",))
    found = lambda t: tox.measure(tox.fold(t, tox.Folding()), lexicon.automaton())
    assert found("a trash can")[0] == 0 and found("trash can trash")[0] > 0
    assert found("trash")[0] > found("tram")[0] > found("ultra")[0] == 0
    assert found("trash")[1] > found("trash " + "word " * 100)[1] > 0


def made(n):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"word{i % 37}", f"thing{i % 11}", "dolt" if bad and i % 8 == 0 else ("fool5" if bad else "nice"), f"end{i % 5}"]
        rows.append((i, " ".join(words), "en", "a", 1))
    return rows, [(i, int(i % 4 == 0)) for i in range(n)]


def test_learned_words_carry_over(spark, tmp_path):
    rows, labels = made(1200)
    # Labels that lie, on held-out rows only: they must not be learned from.
    import zlib

    labels = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels] + [(None, 1), (5, None), (10**9, 1)]
    more = [(5000, "a D0LT spoke", None, None, 1), (5001, "nothing here", None, None, 1), (5002, None, None, None, None), (None, "", None, None, None), (5000, "a D0LT spoke", None, None, 1)]
    df = stored(spark, rows + more, str(tmp_path / "t"))
    got = [tuple(r) for r in tox.toxicity(df, spark.createDataFrame(labels, LABELS)).collect()]
    assert len(got) == len(rows) + len(more)
    by = {r[0]: r for r in got}
    assert by[5000][3] == 1 and by[5001][3] == by[5002][3] == by[None][3] == 0 and by[None][1]
    assert all(by[i][3] == int(i % 4 == 0) for i in range(1200))
    assert all(by[i][1] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1200))
    assert all(0 <= r[2] <= 1 for r in got)


def test_awkward_and_empty(spark, tmp_path):
    df = awkward(spark, str(tmp_path / "t"))
    none = spark.createDataFrame([], LABELS)
    got = tox.toxicity(df, none).collect()
    assert len(got) == len(ROWS) and {r["predicted"] for r in got} == {0}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], LABELS)
    assert tox.toxicity(df, one).count() == len(ROWS)
    assert tox.toxicity(stored(spark, [], str(tmp_path / "e")), none).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = tox.op7_toxicity(spark, SF).join(labels, "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / n[(0, 0)] < 0.02
