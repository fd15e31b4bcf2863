"""Awkward rows that every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use for their own columns.
EXTRA = ["key", "kept", "id", "size", "row", "keep_id", "component_id"]
CLASH = T.StructType([*SCHEMA.fields, *[T.StructField(n, T.StringType()) for n in EXTRA]])

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(120))
ROWS = [
    (1, "The same Text, twice over and again", "en", "a", 1),
    (2, "the SAME text, twice over and again", "en", "b", 1),
    (2, "the SAME text, twice over and again", "en", "b", 1),
    (None, None, None, None, None),
    (3, None, None, None, None),
    (None, "", "en", "a", 0),
    (4, "", "en", "a", 0),
    (5, "   \n\t ", "en", None, 6),
    (6, LONG, "de", "a", 7),
    (7, LONG + " tail", "de", "a", 7),
    (8, BASE, "fr", "c", 7),
    (9, BASE.replace("alpha7 ", "beta7 "), "fr", "c", 7),
    (10, "one", "fr", "c", 7),
    (11, "É é ß 🙂  x y a\vb\fc\rd", "fr", "c", 7),
    (12, "a b c a b c a b c\n\nx\nx\n x", "fr", "c", 7),
    (-5, "the same text, twice over and again", "en", "z", 1),
]


def awkward(spark, path):
    """The rows as a stored table with clashing extra columns."""
    rows = [(*r, *["q"] * len(EXTRA)) for r in ROWS]
    spark.createDataFrame(rows, CLASH).repartition(3, "text").write.mode("overwrite").parquet(path)
    return spark.read.schema(CLASH).parquet(path)


def stored(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
