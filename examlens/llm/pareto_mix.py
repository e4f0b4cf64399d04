"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997).

A source whose target is r times its size gives every document floor(r) certain copies. One
more copy goes to a sample with inclusion probability p = r - floor(r): documents are ranked by
u / (1 - u) divided by p / (1 - p), with u uniform, and the first ones are taken until the
source's remaining words are reached. With weights, r and p differ from document to document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.llm.common import n_words, written

#: Weights of the sources by their place in code-point order, repeated.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Slices of the rank scale. The slice where a source's cut falls is the only one sorted; with
#: equal weights it holds one document in ``SLICES`` of its source at most, in expectation.
SLICES = 8192


def targets(sizes: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, n_docs, target`` from ``source, size`` rows.

    Sources in code-point order, a missing source last, have the weights in turn. They share
    ``share`` times all words by weight; no target is above ``most`` times its source's size,
    and what is cut off is shared again among the others. That ends at one level L with
    targets min(L * weight, most * size): sources are sorted by the level at which they fill
    up, and running sums give the level at each of them. One row per source meets in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = totals.withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights)))).cast("double")
    ).withColumn("room", most * F.col("source_size"))
    filling = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    levels = listed.withColumn("level", level).withColumn("open", F.col("room") / F.col("weight") > F.col("level"))
    # the first source that does not fill up sets the level for all after it; theirs are lower
    final = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    return levels.select(
        "source",
        "source_size",
        "n_docs",
        F.least("room", F.coalesce(final * F.col("weight"), F.col("room"))).alias("target"),
    )


def uniform(seed: int, *columns: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the columns and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _expected_copies(sized: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """``rate`` per source so that sum(size * min(most, rate * weight)) is the target.

    Documents that reach ``most`` copies are set to it and the rest is shared again, until no
    new document reaches it; each round is one aggregate. Equal weights end after one round.
    """
    rate = goals.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    if "weight" not in sized.columns:
        return rate
    rate = rate.withColumn("rate", F.lit(0.0))
    full_before = -1
    while True:
        capped = F.col("rate") * F.col("weight") >= most
        sums = (
            sized.join(rate.select(F.col("source").alias("_s"), "rate"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source")
            .agg(
                F.sum(F.when(capped, most * F.col("size")).otherwise(0.0)).alias("fixed"),
                F.sum(F.when(capped, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("free"),
                F.sum(F.when(capped, 1).otherwise(0)).alias("full"),
            )
            .withColumnRenamed("source", "_s")
        )
        both = goals.join(sums, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rate = written(
            both.withColumn("rate", F.when(F.col("free") > 0, (F.col("target") - F.col("fixed")) / F.col("free")).otherwise(most)),
            "rates",
        )
        full = rate.agg(F.sum("full")).first()[0] or 0
        rate = rate.drop("fixed", "free", "full")
        if full == full_before:
            return rate
        full_before = full


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[float, ...] = SOURCE_WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, content, size, source, source_size, target, copies, taken`` for every document.

    ``content`` is a hash of the text, ``size`` counts words (a missing text has 0), ``copies`` how often the mix takes the
    document, ``taken`` its words in the mix. A source's taken words differ from its target by
    half a document at most: the sample has a fixed size in words, and the document on the cut
    is taken if that comes nearer. Documents without words get their certain copies only.
    ``weight_col`` (positive numbers; others count as 1) makes some documents of a source
    likelier than others. Repeated rows are ranked apart by their content; the same rows always
    give the same mix.

    Texts are read once, into a written table of numbers. Sources are not gathered anywhere: a
    first aggregate counts words per source and slice of the rank scale, and only the slice on
    the cut is sorted.
    """
    weighted = []
    if weight_col:
        w = F.col(weight_col).cast("double")
        weighted = [F.when(w > 0, w).otherwise(1.0).alias("weight")]
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("content"),
            *weighted,
        ),
        "sizes",
    )
    goals = written(_expected_copies(sized, targets(sized, weights, share, most), most), "targets")

    expected = F.least(F.lit(most), F.col("rate") * (F.col("weight") if weight_col else F.lit(1.0)))
    u, p = uniform(seed, F.col("doc_id"), F.col("size"), F.col("content")), F.col("chance")
    odds = (u / (1 - u)) * ((1 - p) / p)
    ranked = (
        sized.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("certain", F.floor(expected).cast("long"))
        .withColumn("chance", expected - F.floor(expected))
        .withColumn("odds", F.when((p > 0) & (F.col("size") > 0), odds))
        # the scale odds / (1 + odds) is fine enough around the cut, which lies near one half
        .withColumn("slice", F.floor(F.col("odds") / (1 + F.col("odds")) * SLICES).cast("int"))
        .select(
            "doc_id", "source", "source_size", "target", "size", "content", "certain", "odds", "slice",
        )
    )
    # words per source and slice; the certain words have the slice null
    slices = (
        ranked.groupBy("source", "target", "slice")
        .agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("certain_words"))
    )
    of_source = Window.partitionBy("source")
    running = of_source.orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = F.when(F.col("slice").isNotNull(), F.col("words")).otherwise(0)
    cuts = written(
        slices.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.sum("certain_words").over(of_source)))
        .withColumn("upto", F.sum(drawn).over(running))
        .withColumn("before", F.col("upto") - drawn)
        .where(F.col("slice").isNotNull() & (F.col("upto") > F.col("left")) & (F.col("before") <= F.col("left")))
        .groupBy("source")
        .agg(F.min_by(F.struct("slice", "left", "before"), "slice").alias("cut"))
        .select(F.col("source").alias("_s"), F.col("cut.slice").alias("cut_slice"), "cut.left", "cut.before"),
        "cuts",
    )
    placed = ranked.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    outside = placed.where(~F.coalesce(F.col("slice") == F.col("cut_slice"), F.lit(False))).withColumn(
        "extra",
        F.when(F.col("slice").isNull(), 0).when(F.col("cut_slice").isNull() | (F.col("slice") < F.col("cut_slice")), 1).otherwise(0),
    )
    line = Window.partitionBy("source").orderBy("odds", "doc_id", "size", "content")
    upto = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = placed.where(F.col("slice") == F.col("cut_slice")).withColumn(
        "extra", (F.col("before") + upto - F.col("size") / 2 <= F.col("left")).cast("int")
    )
    copies = F.col("certain") + F.col("extra")
    result = ["doc_id", "content", "size", "source", "source_size", "target"]
    return outside.select(*result, copies.alias("copies"), (copies * F.col("size")).alias("taken")).unionByName(
        inside.select(*result, copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )
