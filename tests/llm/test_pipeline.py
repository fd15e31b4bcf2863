"""The pipeline's stages against plain Python, each on its own input."""

from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline as pipe
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, awkward, stored
from tests.llm.test_native import counts, targets
from tests.llm.test_ngram_join import expected as near_classes
from trailframe.llm import pieces, toxicity
from trailframe.runtime import materialize

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [tuple(r) for r in df.collect()]


def check(spark, docs):
    columns, at = docs.columns, docs
    before = rows(at)
    lexicon = toxicity.learn(at, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text")
    at = materialize(pipe.toxicity(spark, at, SF), "t")
    table, automaton = toxicity.Folding(), lexicon.automaton()
    c, a, b = lexicon.coefficients

    def clean(text):
        x, y = toxicity.measure(toxicity.fold(text, table), automaton) if text and automaton else (0.0, 0.0)
        return c + a * x + b * y < 0

    assert at.columns == columns and Counter(rows(at)) == Counter(r for r in before if clean(r[1]))
    before = rows(at)
    at = materialize(pipe.exact(spark, at, SF), "t")
    best = {}
    for r in before:
        body = (r[1] or "").translate(LOWER)
        best[body] = max((x for x in (best.get(body), r[0]) if x is not None), default=None)
    after = rows(at)
    assert at.columns == columns and not Counter(after) - Counter(before)
    assert Counter(((r[1] or "").translate(LOWER), r[0]) for r in after) == Counter(best.items())
    before = after
    at = materialize(pipe.near(spark, at, SF), "t")
    after = rows(at)
    names = Counter(str(x[2]) for x in set((d, n, c) for d, n, c in near_classes([(r[0], r[1]) for r in before], 5, 80)))
    assert at.columns == columns and not Counter(after) - Counter(before)
    assert {str(r[0]) for r in after} == set(names)
    before = after
    at = materialize(pipe.mixed(spark, at, SF), "t")
    after = Counter(rows(at))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = counts(r[1])[0]
        sizes[r[3]] += n
        taken[r[3]] += n * after[r] / Counter(before)[r]
        largest[r[3]] = max(largest[r[3]], n)
    want = targets(sizes)
    assert at.columns == columns and set(after) <= set(before) and max(after.values()) <= 2 * max(Counter(before).values())
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    last = pipe.pieces(spark, at, SF)
    texts = last.select("doc_id", F.explode("samples").alias("s")).select("doc_id", pieces.decode_ids(F.col("s.ids"), pieces.vocabulary("piece_bpe_32k.model")))
    assert last.count() == sum(after.values())
    assert {tuple(r) for r in texts.collect()} == {(r[0], r[1] or "") for r in after}


def test_stages_on_the_table(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_stages_on_awkward_rows(spark, tmp_path):
    check(spark, awkward(spark, str(tmp_path / "t")))


@pytest.mark.parametrize("stage", [f for _, f in pipe.STAGES])
def test_empty(spark, tmp_path, stage):
    assert stage(spark, stored(spark, [], str(tmp_path / "t"), SCHEMA), SF).count() == 0


def test_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert entry.queries()["pipeline"](spark, SF).columns == ["doc_id", "samples"]
