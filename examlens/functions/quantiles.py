"""Exact quantiles of large, skewed groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000
MARGIN = 0.001  # ten times the rank error of the sketch
SMALL_GROUP = 4000  # below this the margin is less than a few ranks: rank all rows


def bracket_measures(value: Column, quantiles: dict[str, float]) -> list[Column]:
    """Aggregates that bracket quantiles; put them into an aggregation that is made anyway."""
    points = [
        min(1.0, max(0.0, q + d)) for q in quantiles.values() for d in (-MARGIN, MARGIN)
    ]
    value = value.cast("double")
    return [
        F.count(value).alias("_n"),
        F.percentile_approx(value, points, ACCURACY).alias("_points"),
    ]


def exact_quantiles(
    frame: DataFrame,
    by: list[str],
    value: str,
    quantiles: dict[str, float],
    sketched: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group without holding a group in one task.

    ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a
    mergeable sketch only brackets each quantile; the bracket's rows are then counted exactly
    (pre-aggregated per distinct value) and ranked behind the exact count below the bracket.
    ``sketched`` may hold the :func:`bracket_measures` from an earlier aggregation.
    """
    known = frame.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    names = list(quantiles)
    if sketched is None:
        sketched = known.groupBy(*by).agg(*bracket_measures(F.col("_v"), quantiles))
    small = F.col("_n") <= SMALL_GROUP
    packed = sketched.select(
        *by,
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    F.when(small, float("-inf"))
                    .otherwise(F.get("_points", F.lit(2 * i)))
                    .alias("low"),
                    F.when(small, float("inf"))
                    .otherwise(F.get("_points", F.lit(2 * i + 1)))
                    .alias("high"),
                    (F.lit(float(q)) * (F.col("_n") - 1)).alias("position"),
                )
                for i, (name, q) in enumerate(quantiles.items())
            ]
        ).alias("_brackets"),
    )
    placed = known.join(packed, by) if by else known.withColumn("_brackets", packed.scalar())
    marked = placed.select(
        *by,
        "_v",
        F.explode(
            F.filter("_brackets", lambda b: F.col("_v") <= b["high"])
        ).alias("b"),
    ).select(
        *by,
        F.col("b.name").alias("name"),
        F.col("b.position").alias("position"),
        F.when(F.col("_v") >= F.col("b.low"), F.col("_v")).alias("_v"),
    )
    # one row per distinct value inside the bracket, one (null) row for everything below it
    counted = marked.groupBy(*by, "name", "position", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by, "name").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_c").over(order))
    lower, upper = F.floor("position") + 1, F.ceil("position") + 1

    def at(rank: Column) -> Column:
        inside = F.col("_v").isNotNull() & (F.col("_upto") >= rank)
        return F.min(F.when(inside, F.col("_v")))

    fraction = F.max(F.col("position") - F.floor("position"))
    values = ranked.groupBy(*by, "name").agg(
        (at(lower) + fraction * (at(upper) - at(lower))).alias("value")
    )
    found = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(
        F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    )
    return values.groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == n, found)).alias(n) for n in names]
    )
