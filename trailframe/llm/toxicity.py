"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that
stand for letters), searched once by an Aho-Corasick automaton, and scored by
the weights found against the text's length; hits inside exception phrases
don't count. Lexicon, weights and score are learned from labelled documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import pick
from trailframe.runtime import materialize

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "абвгеёзіјкмнорѕстухԁһӏԛԝαβεηικνορτυχωγσ",
        "abbreezijkmhopsctyxdhlqwabenikvoptuxwyo",
    )
)
# Digits and signs read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# Ordinary phrases whose words don't insult.
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bin", "clown fish", "clown car", "pond scum", "sore loser board game")

SHORTEST, LONGEST = 3, 8


class Folding(dict):
    """Table for ``str.translate``: one character to folded text, filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        out = ""
        for c in unicodedata.normalize("NFKD", char.lower()):
            c = LOOKALIKES.get(c, LEET.get(c, c))
            if unicodedata.category(c) in ("Mn", "Cf"):  # accents, invisible marks
                continue
            out += c if c.isalpha() else " "
        self[code] = out
        return out


def fold(text: str, table: Folding) -> str:
    """Folded words between single blanks, a blank at either end.

    Signs stand for letters only before a letter ("$tupid", "p@thetic"): a run
    of signs after a word is punctuation.
    """
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = "".join(
            " " if c in "$@!|" and not text[i + 1 : i + 2].isalpha() else c for i, c in enumerate(text)
        )
    return " " + " ".join(text.translate(table).split()) + " "


def features(folded: str) -> set[str]:
    """Lexicon candidates of a text: whole words, and starts of words, each after a blank."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            found.add(f" {word[:n]}")
    return found


@dataclass
class Lexicon:
    """Patterns with weights, exception phrases, and the coefficients of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-8.0, 0.0, 0.0)

    def automaton(self):
        made = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            made.add_word(pattern, (len(pattern), weight, False))
        for phrase in self.exceptions:
            text = fold(phrase, Folding())
            made.add_word(text, (len(text), 0.0, True))
        if len(made):
            made.make_automaton()
        return made if len(made) else None


def measure(folded: str, automaton) -> tuple[float, float]:
    """(log of the weight found, weight by length). Of patterns at one place the heaviest counts."""
    hits: dict[int, float] = {}
    spans: list[tuple[int, int]] = []
    for end, (length, weight, exempt) in automaton.iter(folded):
        start = end - length + 1
        if exempt:
            spans.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    for a, b in spans:
        for at in [at for at in hits if a <= at < b]:
            del hits[at]
    total = sum(hits.values())
    return math.log1p(total), total / (20.0 + folded.count(" "))


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: candidates of labelled texts, counted by label before the shuffle."""
    counts = (Counter(), Counter())
    for batch in rows:
        table_ = Folding()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(features(fold(text or "", table_)))
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())],
        ["f", "pos", "neg"],
    )


def learn(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int = 5000, most: int = 3000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fifth.

    About ``per_class`` rows of either label are drawn by the hash of their id;
    that bound is what makes their ids small enough to broadcast. ``most``
    bounds the lexicon. Without labels of both kinds the lexicon is empty and
    every text scores next to 0.
    """
    fit = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    fit = fit.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = dict(fit.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(exceptions=exceptions)
    rate = F.when(F.col("toxic") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    drawn = fit.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < rate * 1_000_000)
    rows = pick(df, doc_id=id_col, text=text_col).join(F.broadcast(drawn), "doc_id")
    # One row a drawn id, however many share it: the bound holds for rows.
    texts = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    texts = materialize(texts, "labelled")
    counted = texts.mapInArrow(_count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon(exceptions=exceptions)
    odds = F.log((F.col("pos") + 0.5) / (n[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (n[0] + 1.0))
    sure = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    least = 4
    ranked = counted.filter(F.col("pos") >= least).withColumn("w", odds - sure).filter("w > 1.0")
    top = ranked.orderBy(F.desc("w"), "f").limit(most).collect()
    weights = {r["f"]: float(r["w"]) for r in top}
    # The shortest start that says as much stands for all that it begins.
    kept = {
        f: w for f, w in weights.items()
        if not any(weights.get(f[:k], -9.0) >= w - 0.25 for k in range(SHORTEST + 1, len(f)))
    }
    lexicon = Lexicon(_cover(texts, Lexicon(kept)), exceptions)
    if lexicon.weights:
        lexicon.coefficients = _calibrate(texts, lexicon)
    return lexicon


def _cover(texts: DataFrame, lexicon: Lexicon, least: int = 3) -> dict[str, float]:
    """The patterns, heaviest first, that explain toxic texts which no heavier one does.

    Other words of toxic texts that were copied many times look telling too;
    they explain nothing that the insults beside them don't.
    """
    names = sorted(lexicon.weights, key=lambda f: (-lexicon.weights[f], f))
    if not names:
        return {}
    ranks = Lexicon({f: float(i) for i, f in enumerate(names)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_, automaton = Folding(), ranks.automaton()
        for f in frames:
            yield pd.DataFrame({"hits": [sorted({int(x[1]) for _, x in automaton.iter(fold(t or "", table_))}) for t in f["text"]]})

    # Bounded by the drawn rows and the size of the lexicon.
    open_ = [set(h) for h in texts.filter("toxic = 1").mapInPandas(run, "hits array<int>").toPandas()["hits"]]
    kept = {}
    for i, name in enumerate(names):
        if sum(i in h for h in open_) >= least:
            kept[name] = lexicon.weights[name]
            open_ = [h for h in open_ if i not in h]
    return kept


def _calibrate(texts: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on the two measures: three numbers a row, bounded rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_, automaton = Folding(), lexicon.automaton()
        for f in frames:
            found = [measure(fold(t or "", table_), automaton) for t in f["text"]]
            yield pd.DataFrame({"a": [x[0] for x in found], "b": [x[1] for x in found], "y": f["toxic"].astype("float64")})

    data = texts.mapInPandas(run, "a double, b double, y double").toPandas().sort_values(["a", "b", "y"])
    x = np.column_stack([np.ones(len(data)), data["a"], data["b"]])
    y = data["y"].to_numpy()
    # Classes were drawn at like size; rows weigh alike.
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 0.05 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def held_out(doc_id: Column) -> Column:
    """The fifth of rows that is never learned from; rows without an id are in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity_score(lexicon: Lexicon):
    """A vectorised function of text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table_, automaton = Folding(), lexicon.automaton()
        c, a, b = lexicon.coefficients
        for texts in batches:
            out = []
            for t in texts:
                x, y = measure(fold(t, table_), automaton) if t and automaton is not None else (0.0, 0.0)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y)))))
            yield pd.Series(out, dtype="float64")

    return score


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 5000) -> DataFrame:
    """``id, held_out, score, predicted`` for every row.

    Null and empty texts get the score of a text without hits; null ids are held
    out; repeated rows score alike, each in its own row; an empty table gives an
    empty result; long texts are scored whole; extra columns are ignored. Scores
    use the text only. ``labels`` has ``doc_id, toxic``; labels of unknown
    documents, null labels and all labels of the held-out fifth go unread; of
    several labels of one document the higher counts.
    """
    score = toxicity_score(learn(df, labels, id_col, text_col, per_class))
    rows = pick(df, id=id_col, text=text_col)
    scored = rows.select("id", held_out(F.col("id")).alias("held_out"), score("text").alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
