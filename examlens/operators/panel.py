"""The exam panel: one row per (year, exam, series), kept long until the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.common import count_if
from examlens.functions.stats import pearson
from examlens.operators import checks
from examlens.operators.scoring import EXAM
from examlens.session import shared_folder

ENSEMBLE = "ensemble"


def materialize(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a small, often reused table to the shared folder and read it back.

    Cuts the lineage, so that the fact rows behind a panel are scanned once however many
    statistics follow, and survives the loss of executors.
    """
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ensemble_scores(scores: DataFrame, reference_model: str) -> DataFrame:
    """Per exam: equal-weight mean, pooled mean, reference model, number of models."""
    return scores.groupBy(*EXAM).agg(
        F.avg("model_pct").alias("ensemble_pct"),
        F.max(F.when(F.col("model") == reference_model, F.col("model_pct"))).alias("reference_pct"),
        F.count("model_pct").cast("bigint").alias("model_count"),
        (100 * F.avg("total_score") / F.min("possible_points")).alias("pooled_ensemble_pct"),
        F.min("possible_points").alias("possible_points"),
    )


def leave_one_model_out(scores: DataFrame) -> DataFrame:
    """Mean of the other models per exam, one row per omitted model."""
    exam = Window.partitionBy(*EXAM)  # as many rows as there are models
    total, count = F.sum("model_pct").over(exam), F.count("model_pct").over(exam)
    return scores.select(
        *EXAM,
        F.col("model").alias("model_omitted"),
        F.try_divide(total - F.col("model_pct"), (count - 1).cast("double")).alias("lomo_pct"),
    )


def z_score(value: str, keys: list[str]) -> Column:
    """Population z-score within a group; 0 for a constant group."""
    window = Window.partitionBy(*keys)
    deviation = F.col(value) - F.avg(value).over(window)
    spread = F.stddev_pop(value).over(window)
    return F.coalesce(F.try_divide(deviation, spread), F.lit(0.0))


def demeaned(value: str, keys: list[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys))


def comparison_panel(scores: DataFrame, human: DataFrame, reference_model: str) -> DataFrame:
    """Model panel joined to the human means, with difficulties (negated z-scores)."""
    joined = ensemble_scores(scores, reference_model).join(human, EXAM, "inner")
    difficulties = {
        f"{name}_difficulty": -z_score(f"{name}_pct", ["exam"])
        for name in ("human", "ensemble", "reference")
    }
    return joined.withColumns(difficulties).withColumn(
        "opposite_difficulty_sign",
        F.col("human_difficulty") * F.col("ensemble_difficulty") < 0,
    )


def lomo_deviations(scores: DataFrame, comparison: DataFrame) -> DataFrame:
    """How far the difficulty series moves when one model is left out."""
    joined = leave_one_model_out(scores).join(
        comparison.select(*EXAM, "human_difficulty", "ensemble_difficulty"), EXAM
    )
    with_difficulty = joined.withColumn(
        "_lomo", -z_score("lomo_pct", ["exam", "model_omitted"])
    )
    deviation = F.abs(F.col("_lomo") - F.col("ensemble_difficulty"))
    return with_difficulty.groupBy("exam", "model_omitted").agg(
        F.avg(deviation).alias("mean_abs_deviation_sd"),
        F.max(deviation).alias("max_abs_deviation_sd"),
        pearson(F.col("human_difficulty"), F.col("_lomo")).alias("correlation_with_human"),
    )


def build_panel(scores: DataFrame, human: DataFrame, composition: DataFrame) -> DataFrame:
    """Long panel: every model series and their ensemble with outcome and composition.

    Exams without a human mean are not part of it; an exam without a composition, and one that
    lacks one of the series, is an error.
    """
    by_model = scores.select(*EXAM, F.col("model").alias("series"), "model_pct")
    # the ensemble row comes out of the same scan: every row also feeds the ensemble group
    series = (
        by_model.withColumn("series", F.explode(F.array("series", F.lit(ENSEMBLE))))
        .groupBy(*EXAM, "series")
        .agg(F.avg("model_pct").alias("model_pct"))
    )
    covered = series.join(human, EXAM).join(composition.withColumn("_composed", F.lit(True)), EXAM, "left")
    panel = checks.present(covered, F.col("_composed"), "exam without a composition").drop("_composed")
    # the check rides on the panel's own rows (exams times series), so nothing is computed twice
    counted = panel.withColumn("_series", F.count(F.lit(1)).over(Window.partitionBy(*EXAM)))
    most = F.max("_series").over(Window.partitionBy(F.lit(0)))
    complete = F.when(F.col("_series") == F.col("_most"), F.lit(1))
    checked = counted.withColumn("_most", most).withColumn("_complete", complete)
    return checks.present(checked, F.col("_complete"), "failed checks: every exam has every series").select(*panel.columns)


def add_mean_series(panel: DataFrame, name: str, members: list[str]) -> DataFrame:
    """Add a series that is the row mean of some existing series."""
    facts = [c for c in panel.columns if c not in (*EXAM, "series", "model_pct")]
    mean = (
        panel.filter(F.col("series").isin(members))
        .groupBy(*EXAM)
        .agg(F.avg("model_pct").alias("model_pct"), *[F.min(c).alias(c) for c in facts])
        .withColumn("series", F.lit(name))
    )
    return panel.unionByName(mean)


def panel_checks(panel: DataFrame, models: list[str]) -> DataFrame:
    """Coverage and consistency of a panel as rows ``(check, rows, violations)``."""
    per_exam = panel.groupBy(*EXAM).agg(
        F.count_distinct("series").alias("series"),
        F.avg(F.when(F.col("series").isin(models), F.col("model_pct"))).alias("mean"),
        F.max(F.when(F.col("series") == ENSEMBLE, F.col("model_pct"))).alias("ensemble"),
        F.max(F.col("human_pct").isNull().cast("int")).alias("missing"),
    )
    checks = per_exam.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col("series") != len(models) + 1).alias("every series present"),
        count_if(F.abs(F.col("mean") - F.col("ensemble")) > 1e-6).alias("ensemble is the mean"),
        count_if(F.col("missing") > 0).alias("human mean present"),
    )
    names = ["every series present", "ensemble is the mean", "human mean present"]
    return checks.select(
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("violations"))
                    for n in names
                ]
            )
        ),
    ).select("check", "rows", "violations")
