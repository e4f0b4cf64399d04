"""Ranks of all rows of a table, or of huge groups, without a task that sees them all.

Distinct values are counted, dealt to tasks by ranges and numbered in each range; running totals
of the ranges, a row per range, complete the ranks. Equal values are one row from the start, so no
tie spans two ranges, and values are compared as they are, without rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.operators.panel import materialize


def _same(names: list[str], left: str = "", right: str = "_") -> Column:
    return F.lit(True) if not names else _all([F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}")) for n in names])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def value_ranks(frame: DataFrame, by: list[str], value: str, count: str | None = None) -> DataFrame:
    """``(*by, value, _count, rank)``: the mean rank of every distinct value of a group, from 1.

    ``count`` names a column that says how many rows a row stands for. Missing values have no rank.
    The counted values are written with the number of their range, because the borders of ranges
    come from a sample and must not change between two uses.
    """
    spark = frame.sparkSession
    rows = F.sum(F.col(count)) if count else F.count(F.lit(1))
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.cast("bigint").alias("_count"))
    placed = counted.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id())
    placed = materialize(placed, "ranges")
    totals = placed.groupBy(*by, "_range").agg(F.sum("_count").alias("_rows"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(n).alias(f"_{n}") for n in by], F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_count").over(within), F.lit(0))
    numbered = placed.withColumn("_before", before).join(offsets, (F.col("_range") == F.col("_of")) & _same(by))
    rank = F.col("_offset") + F.col("_before") + (F.col("_count") + 1) / 2
    return numbered.select(*by, value, "_count", rank.cast("double").alias("rank"))


def spearman(frame: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(*by, rows, spearman_rho)``: rank correlation over all rows in which both values are known.

    Equal pairs are counted first; a value's rank is looked up once per pair. The correlation is
    null if a side is constant.
    """
    pairs = (
        frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .groupBy(*by, "_x", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    pairs = materialize(pairs, "pairs")
    placed = pairs
    for side in ("_x", "_y"):
        ranked = value_ranks(pairs, by, side, "_n").select(
            *[F.col(n).alias(f"_{n}") for n in by], F.col(side).alias("_value"), F.col("rank").alias(f"{side}_rank")
        )
        kept = [*placed.columns, f"{side}_rank"]
        placed = placed.join(ranked, _same(by) & (F.col(side) == F.col("_value"))).select(*kept)
    n = F.sum("_n")
    # the mean rank is known, so ranks are centred in the same pass
    sizes = pairs.groupBy(*by).agg(((n + 1) / 2).alias("_mean"), n.cast("bigint").alias("rows"))
    if by:
        named = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "_mean", "rows")
        placed = placed.join(named, _same(by))
    else:
        placed = placed.select("*", sizes.select("_mean").scalar().alias("_mean"), sizes.select("rows").scalar().alias("rows"))
    dx, dy, w = F.col("_x_rank") - F.col("_mean"), F.col("_y_rank") - F.col("_mean"), F.col("_n")
    products = F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))
    return placed.groupBy(*by).agg(
        F.max("rows").alias("rows"), F.try_divide(F.sum(w * dx * dy), products).alias("spearman_rho")
    )
