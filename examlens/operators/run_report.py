"""The report of a run: counts, accuracies, latencies, tokens, cost, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import count_if
from examlens.functions.quantiles import bracket_measures, exact_quantiles
from examlens.functions.scoring import DECLINED
from examlens.operators.panel import materialize

MEDIAN = {"median_latency_ms": 0.5}


def _answered() -> Column:
    """Answered rows include declined ones; failed rows never count."""
    return F.col("predicted").isNotNull() & F.col("error").isNull()


def _correct() -> Column:
    return F.coalesce(F.col("is_correct"), F.lit(False))


def run_report(results: DataFrame, by: list[str]) -> DataFrame:
    """One row per run.

    All measures and a bracket around the median latency come from one scan, whose few rows
    are written; a second scan counts the bracket's rows for the exact median.
    """
    answered = _answered()
    points = F.coalesce(F.col("points").cast("double"), F.lit(0.0))
    earned = F.coalesce(F.col("points_earned").cast("double"), F.lit(0.0))
    start = count_if((points > 0) & F.col("exam").isNotNull())

    def of(name: str) -> Column:
        return F.when(answered, F.col(name))

    declined = (
        F.upper(F.coalesce(F.col("predicted"), F.lit(""))) == DECLINED
    ) & F.col("error").isNull()
    tokens = []
    for name in (
        "total_tokens",
        "prompt_tokens",
        "completion_tokens",
        "reasoning_tokens",
        "explicit_reasoning_tokens",
    ):
        tokens += [
            F.avg(of(name)).alias(f"mean_{name}"),
            F.sum(of(name)).cast("bigint").alias(f"sum_{name}"),
            F.count(of(name)).cast("bigint").alias(f"{name}_known"),
        ]
    grouped = results.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        count_if(answered).alias("answered_count"),
        count_if(declined).alias("declined_count"),
        count_if(F.col("error").isNotNull()).alias("failed_count"),
        count_if(_correct() & answered).alias("_correct"),
        F.sum(points).alias("_reachable"),
        F.sum(earned).alias("_earned"),
        start.alias("_start"),
        F.avg(of("latency_ms")).alias("mean_latency_ms"),
        *tokens,
        F.coalesce(F.sum(of("cost_usd")), F.lit(0.0)).alias("total_cost_usd"),
        *bracket_measures(of("latency_ms"), MEDIAN),
    )
    grouped = materialize(grouped, "run-report")
    reachable = F.col("_reachable") + F.col("_start")
    total = F.col("_earned") + F.col("_start")
    zero = F.lit(0.0)
    report = grouped.withColumns(
        {
            "accuracy": F.coalesce(F.try_divide(F.col("_correct"), F.col("answered_count")), zero),
            "total_points_earned": total,
            "points_weighted_accuracy": F.when(reachable > 1e-12, total / reachable).otherwise(zero),
            "unknown_usage_count": F.col("answered_count") - F.col("total_tokens_known"),
        }
    ).drop("_correct", "_reachable", "_earned", "_start", "_n", "_points")
    median = exact_quantiles(
        results.filter(answered), by, "latency_ms", MEDIAN, grouped.select(*by, "_n", "_points")
    )
    return report.join(median, by, "left")


def breakdown(results: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of answered rows per group; no start points in the weighted accuracy."""
    return (
        results.filter(_answered())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("count"),
            F.avg(_correct().cast("double")).alias("accuracy"),
            F.sum(F.col("points").cast("double")).alias("_points"),
            F.sum(F.col("points_earned").cast("double")).alias("_earned"),
        )
        .withColumn(
            "points_weighted_accuracy",
            F.when(F.col("_points") > 0, F.col("_earned") / F.col("_points")).otherwise(0.0),
        )
        .drop("_points", "_earned")
    )


def warning_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences of each non-empty warning."""
    return (
        results.select(*by, F.explode("warnings").alias("warning"))
        .filter(F.coalesce(F.col("warning"), F.lit("")) != "")
        .groupBy(*by, "warning")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    )


def rows_with_warnings(results: DataFrame, by: list[str]) -> DataFrame:
    filled = F.exists("warnings", lambda w: F.coalesce(w, F.lit("")) != "")
    return results.groupBy(*by).agg(count_if(filled).alias("rows_with_warnings"))


def top_warnings(results: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent warnings; ties by name."""
    return warning_counts(results, []).orderBy(F.desc("n"), "warning").limit(k)
