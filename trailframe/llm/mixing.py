"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words. A document's expected copies are its
source's target over its source's size: a whole part that all documents of the
source share, and a fraction. Fractions are rounded in pairs: words move at
random from one document of a pair to the other until one of them is integral,
so that the sum of words stays what it was; the other goes on to the next pair.
Blocks of documents run in parallel, each leaves one residual, and residuals
meet in blocks again until a source has one left. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import WORD, pick, with_key
from trailframe.runtime import materialize

# Documents (or residuals) that one fold pairs; a fold holds a few times as many.
BLOCK = 64
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` for every source.

    ``sizes`` has ``source, source_size``. Sources in code point order, null
    last, take the weights in turn. Together they get ``share`` of all words,
    but none more than ``most`` times its own; what is over goes to the others
    by weight until no target is above. In closed form: in order of cap over
    weight, the first ones stop at their caps and the rest share what is left.
    The windows run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = sizes.withColumn("w", turn).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    leveled = cap.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # Caps fill in order of cap over weight: the first source that isn't full sets the level.
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final["level"] * F.col("w")))
    return leveled.select("source", "source_size", target.alias("target"))


def _fold(rows: Column, seed: int) -> Column:
    """Round one block: ``struct<done: array<struct<row,up>>, key, row, p, a>``.

    The accumulator carries the one open document (row, p, a). With the next
    document j the pair's words a*p are moved until either is 0 or 1. Going one
    way ends after ``x`` words, the other way after ``y``; taking the first with
    probability y / (x + y) keeps every document's expectation.
    """
    done = "array<struct<row:bigint,up:int>>"
    state = f"struct<done:{done},key:bigint,row:bigint,p:double,a:double>"
    start = F.struct(
        F.array().cast(done).alias("done"),
        F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("row"),
        F.lit(0.0).alias("p"), F.lit(0.0).alias("a"),
    )

    def step(acc: Column, j: Column) -> Column:
        up = F.least((1 - acc["p"]) * acc["a"], j["p"] * j["a"])  # words from j to the open one
        down = F.least(acc["p"] * acc["a"], (1 - j["p"]) * j["a"])  # words from the open one to j
        coin = (F.xxhash64(acc["key"], j["key"], F.lit(seed)) % 1000000007 + 1000000007) % 1000000007 / 1000000007.0
        moved = F.when(coin * (up + down) < down, up).otherwise(-down)
        p, q = acc["p"] + moved / acc["a"], j["p"] - moved / j["a"]
        pair = F.struct(p.alias("p"), q.alias("q"))
        # One of the two is integral now (both, at times: then the other waits as good as integral).
        settled = F.transform(
            F.array(pair),
            lambda x: F.when(
                (x["p"] <= EPS) | (x["p"] >= 1 - EPS),
                F.struct(
                    F.concat(acc["done"], F.array(F.struct(acc["row"].alias("row"), F.round(x["p"]).cast("int").alias("up")))).alias("done"),
                    j["key"].alias("key"), j["row"].alias("row"),
                    F.least(F.greatest(x["q"], F.lit(0.0)), F.lit(1.0)).alias("p"), j["a"].alias("a"),
                ).cast(state),
            ).otherwise(
                F.struct(
                    F.concat(acc["done"], F.array(F.struct(j["row"].alias("row"), F.round(x["q"]).cast("int").alias("up")))).alias("done"),
                    acc["key"].alias("key"), acc["row"].alias("row"),
                    F.least(F.greatest(x["p"], F.lit(0.0)), F.lit(1.0)).alias("p"), acc["a"].alias("a"),
                ).cast(state)
            ),
        )[0]
        first = F.struct(
            acc["done"].alias("done"), j["key"].alias("key"), j["row"].alias("row"), j["p"].alias("p"), j["a"].alias("a")
        ).cast(state)
        return F.when(acc["row"].isNull(), first).otherwise(settled)

    return F.aggregate(rows, start.cast(state), step)


def pivotal_round(open_rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``row, up`` (0 or 1) for ``grp, key, row, p, a`` with 0 < p < 1 and a > 0.

    Within every ``grp`` the sum of ``up * a`` comes within one row's ``a`` of
    the sum of ``p * a``, and a row is rounded up with probability ``p``.
    ``key`` drives all chance and tells rows apart: equal keys give equal
    results, in any partitioning. A block is dealt by the key's hash, so that no group of any
    size lies in one task; each round of the tree is written to the shared
    folder, with a residual a block left.
    """
    level, left, finished = 0, open_rows, []
    while True:
        counts = left.groupBy("grp").agg(F.count("*").alias("n")).withColumnRenamed("grp", "of")
        blocks = F.ceil(F.col("n") / block)
        dealt = left.join(counts, F.col("grp").eqNullSafe(F.col("of"))).withColumn(
            "block", F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), blocks)
        )
        # Random order inside a block: another hash of the key.
        item = F.struct(F.xxhash64("key", F.lit(level), F.lit(seed + 1)).alias("o"), "key", "row", "p", "a")
        gathered = dealt.groupBy("grp", "block").agg(F.sort_array(F.collect_list(item)).alias("rows"))
        folded = materialize(
            gathered.select("grp", _fold(F.col("rows"), seed + level).alias("f")).select("grp", "f.*"), f"mix-{level}"
        )
        finished.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        left = folded.filter("row IS NOT NULL").select("grp", "key", "row", "p", "a")
        # A source with one residual left flips a last coin.
        most = left.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        level += 1
        if most <= 1:
            coin = (F.xxhash64("key", F.lit(seed), F.lit("last")) % 1000000007 + 1000000007) % 1000000007 / 1000000007.0
            finished.append(left.select("row", (coin < F.col("p")).cast("int").alias("up")))
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def _numbered(rows: DataFrame, parts: int = 256) -> DataFrame:
    """Number (``n``) the rows that share ``like``, from 0 without gaps.

    Equal rows may take each other's numbers, so it doesn't matter which row has
    which. They are counted in parts by their key, so that no task sorts all.
    """
    parted = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    sizes = parted.groupBy("like", "part").agg(F.count("*").alias("size_"))
    before = Window.partitionBy("like").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select("like", "part", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("base")), "mix-offsets")
    place = F.row_number().over(Window.partitionBy("like", "part").orderBy("key")) - 1
    return parted.withColumn("place", place).join(offsets.hint("merge"), ["like", "part"]).withColumn("n", F.col("base") + F.col("place"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    key_col: str | None = None,
) -> DataFrame:
    """``key, id, source, size, source_size, target, copies`` for every row.

    ``key`` is the stored row key ``key_col`` of ``rows.keyed``, for joining
    back; without one, rows are numbered once, here. ``copies`` is
    what the mix takes of the document, 0 up to ``most`` rounded up. Null text
    has size 0 and gets the whole part of its source's copies; a null source is
    a source, last in order; an empty table gives an empty result. Chance comes
    from the id (null too), the source, the text and the number among rows equal
    in these, so rows that repeat an id are rounded one by one, and reruns agree
    however the table is split.
    """
    wanted = {"id": id_col, "source": source_col, "text": text_col}
    rows = pick(df, key=key_col, **wanted) if key_col else with_key(pick(df, **wanted), "key")
    sized = materialize(
        rows.select(
            "key", "id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64("id", F.col("id").isNull(), "source", F.col("source").isNull(), "text").alias("like"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, list(weights), share, most), "mix-targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(rate)
    exact = F.when(F.abs(rate - near) < 1e-9, near).otherwise(rate)
    planned = (
        sized.join(targets, sized["source"].eqNullSafe(targets["of"]))
        .drop("of")
        .withColumn("whole", F.floor(exact).cast("int"))
        .withColumn("p", exact - F.floor(exact))
    )
    open_rows = _numbered(planned.filter((F.col("p") > EPS) & (F.col("size") > 0))).select(
        F.col("source").alias("grp"),
        F.xxhash64("like", "n").alias("chance"),
        F.col("key").alias("row"),
        "p",
        F.col("size").cast("double").alias("a"),
    ).withColumnRenamed("chance", "key")
    rounded = pivotal_round(open_rows, seed)
    # As many rows as documents: never broadcast, however small the files look.
    return planned.join(rounded.withColumnRenamed("row", "key").hint("merge"), "key", "left").select(
        "key", "id", "source", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("up", F.lit(0))).cast("int").alias("copies"),
    )


@query("op9_mix_sources")
def op9_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )
