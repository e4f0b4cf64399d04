"""Later runs: assembled series, variants of fallback rows, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import count_if, share, share_where
from examlens.functions.linalg import least_squares
from examlens.operators import options
from examlens.operators.bootstrap import REPETITIONS, cluster_draws, interval
from examlens.operators.forecast import forecast_changes
from examlens.operators.moments import cell_moments, weighted_moments, within_gram
from examlens.operators.regressions import spread_and_association
from examlens.operators.scoring import EXAM


def later_items(
    repeat: DataFrame, reordered: DataFrame, mapping: DataFrame, fallback: DataFrame, base: str, fallback_name: str
) -> DataFrame:
    """Attempts of all later series in one table.

    ``repeat`` and ``reordered`` are runs of the model ``base``, the second with reordered
    options that ``mapping`` undoes; ``fallback`` gives the variants of another model's later
    run. The series are named after the model and the arm.
    """
    again = repeat.filter(F.col("model") == base).withColumn("model", F.lit(f"{base}__repeat"))
    arm = options.unmap_positions(reordered, mapping).withColumn("model", F.lit(f"{base}__option_order"))
    return arm.unionByName(again, allowMissingColumns=True).unionByName(
        fallback_variants(fallback, fallback_name), allowMissingColumns=True
    )


def fallback_variants(attempts: DataFrame, name: str) -> DataFrame:
    """A run three times: as parsed, with stated answers, and with fallback rows unparsed.

    Every row is unfolded into its three variants, so the run is read once.
    """
    fallback = F.coalesce(F.col("fallback_parse"), F.lit(False))
    parsed = F.col("predicted")
    variants = F.array(
        F.struct(F.lit(name).alias("model"), parsed.alias("predicted")),
        F.struct(
            F.lit(f"{name}__stated").alias("model"),
            F.when(fallback, F.col("stated_answer")).otherwise(parsed).alias("predicted"),
        ),
        F.struct(
            F.lit(f"{name}__unparsed").alias("model"),
            F.when(~fallback, parsed).alias("predicted"),
        ),
    )
    return attempts.select("item_id", F.inline(variants)).select("model", "item_id", "predicted")


def fallback_metrics(scored: DataFrame) -> DataFrame:
    """Parse-fallback rows of one scored run: counts and accuracies by either reading."""
    fallback, capped = F.col("fallback_parse"), F.col("output_capped")
    stated = fallback & F.col("stated_answer").isNotNull()
    return scored.agg(
        count_if(fallback).alias("fallback_rows"),
        count_if(capped).alias("capped_rows"),
        count_if(fallback | capped).alias("fallback_or_capped_rows"),
        share_where(F.col("answered_correctly"), fallback).alias("first_letter_accuracy"),
        count_if(stated).alias("rows_with_stated_answer"),
        share_where(F.col("stated_answer") == F.col("answer"), stated).alias(
            "stated_answer_accuracy"
        ),
    )


def visual_slopes(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 7200
) -> DataFrame:
    """Grade-FE slope of each series on the visual share, per 10 points."""
    columns = ["model_pct", "multimodal_share"]
    cells = cell_moments(panel, columns, ["series", *EXAM])
    draws = cluster_draws(panel, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, ["series"], "exam", draws, "year")
    slope = least_squares(within_gram, ["multimodal_share"], "model_pct")["multimodal_share"]
    replicates = moments.select(
        "series", "rep", (slope / 10).alias("pct_per_10pp_visual_share")
    )
    return interval(replicates, ["series"], ["pct_per_10pp_visual_share"], repetitions).drop(
        "bootstrap_samples"
    )


def item_summary(scored: DataFrame) -> DataFrame:
    correct, visual = F.col("answered_correctly"), F.col("multimodal")
    return scored.groupBy(F.col("model").alias("series")).agg(
        F.count(F.lit(1)).cast("bigint").alias("items"),
        share(correct).alias("item_accuracy"),
        share_where(correct, ~visual).alias("text_only_accuracy"),
        share_where(correct, visual).alias("multimodal_accuracy"),
        share(F.col("declined")).alias("declined_share"),
    )


def later_runs(
    panel: DataFrame, scored: DataFrame, repetitions: int = REPETITIONS
) -> DataFrame:
    """One row per later series: items, spread, association, visual slope, forecast changes.

    ``panel`` holds the later series only (long); mean-of-runs series have no items.
    """
    changes = forecast_changes(panel, repetitions)
    names = ["per_grade", "shared_slope", "with_visual_vs_visual", "recent_mean"]
    wide = changes.groupBy("series").agg(
        *[
            F.max(F.when(F.col("comparison") == name, F.col(f"mae_change{suffix}"))).alias(
                f"mae_change_{name}{suffix}"
            )
            for name in names
            for suffix in ("", "_ci_low", "_ci_high")
        ]
    )
    return (
        spread_and_association(panel, ["series"], repetitions)
        .drop("bootstrap_samples")
        .join(visual_slopes(panel, repetitions), "series")
        .join(wide, "series")
        .join(item_summary(scored), "series", "left")
    )
