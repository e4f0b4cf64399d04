"""Whole reports: every table of an analysis as one dictionary of lazy DataFrames.

The item rows are scored, reduced to cells and written once; exam scores, panel and every table
start from those small results. The attempts are read once for the cells and once for the list
of evaluated items, and again by comparisons of runs, whatever the number of tables. ``sources.writers`` puts a report on disk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlens.operators import (
    agreement,
    describe,
    forecast,
    later_runs,
    options,
    regressions,
    run_report,
    scoring,
)
from examlens.operators import panel as panels
from examlens.operators.bootstrap import REPETITIONS


@dataclass(frozen=True)
class Inputs:
    """What every analysis reads. ``items`` is the key table with its image flags."""

    items: DataFrame
    attempts: DataFrame
    adjustments: DataFrame
    human: DataFrame
    reference_model: str
    grades: list[str]
    tiers: tuple[str, ...] = ("3", "4", "5")
    repetitions: int = REPETITIONS


@dataclass(frozen=True)
class Base:
    """Small written results that the tables of all reports share."""

    scored: DataFrame
    cells: DataFrame
    scores: DataFrame
    composition: DataFrame
    comparison: DataFrame
    panel: DataFrame
    slices: DataFrame


def prepare(inputs: Inputs) -> Base:
    """Score the items and write the panel-sized results once."""
    scored = scoring.score_attempts(inputs.attempts, inputs.items)
    cells = panels.materialize(scoring.item_cells(scored), "cells")
    scores = panels.materialize(scoring.exam_scores(cells, inputs.adjustments), "scores")
    human = panels.materialize(inputs.human, "human")
    evaluated = describe.evaluated_items(inputs.items, inputs.attempts)
    composition = panels.materialize(describe.exam_composition(evaluated), "composition")
    panel = panels.materialize(panels.build_panel(scores, human, composition), "panel")
    return Base(
        scored=scored,
        cells=cells,
        scores=scores,
        composition=composition,
        comparison=panels.comparison_panel(scores, human, inputs.reference_model),
        panel=panel,
        slices=panels.materialize(describe.slice_scores(cells), "slices"),
    )


def diagnostics(inputs: Inputs, base: Base) -> dict[str, DataFrame]:
    """Descriptive tables, calibration and composition-controlled correlations."""
    reps, panel = inputs.repetitions, base.panel
    conditioned = describe.with_conditions(base.cells)
    text_only = conditioned.filter(F.col("visual_condition") == describe.TEXT_ONLY)
    pearson = regressions.pearson_intervals(panel, ["series"], "year", 4900, reps)
    spearman = regressions.spearman_intervals(panel, ["series"], "year", 4901, reps)
    lomo = panels.lomo_deviations(base.scores, base.comparison)
    return {
        "shared_exam_comparisons": base.comparison,
        "shared_exam_composition": describe.with_decades(
            panel.filter(F.col("series") == panels.ENSEMBLE)
        ),
        "composition_controlled_models": regressions.controlled_models(panel, reps),
        "per_grade_correlations": regressions.per_grade_correlations(panel, reps),
        "text_only_diagnostic": regressions.slice_correlations(base.slices, panel, reps),
        "image_subtype_results": describe.subtype_results(conditioned),
        "option_position_diagnostic": describe.option_positions(base.cells),
        "response_status_by_visual_condition": describe.response_status(conditioned),
        "visual_accuracy_by_point_tier": describe.accuracy_table(
            conditioned, ["model", "question_points", "visual_condition"]
        ),
        "visual_accuracy_by_grade": describe.accuracy_table(
            conditioned, ["model", "exam", "visual_condition"]
        ),
        "no_visual_accuracy_by_year": describe.accuracy_table(text_only, ["model", "year"]),
        "model_correlations": pearson.join(spearman.drop("bootstrap_samples"), "series"),
        "model_performance": scoring.league_table(base.scores),
        "lomo_deviations": lomo,
        "pooled_statistics": regressions.pooled_statistics(base.comparison, lomo),
        "per_grade_calibration": regressions.calibration(base.comparison),
        "out_of_sample_r2": regressions.out_of_sample(base.comparison),
        "form_adjustments": inputs.adjustments,
    }


def surrogate(inputs: Inputs, base: Base) -> dict[str, DataFrame]:
    """Regressions of the human mean, prospective forecasts and their sensitivity."""
    reps, panel = inputs.repetitions, base.panel
    errors = panels.materialize(forecast.forward_errors(panel), "forecasts")
    adjusted = inputs.adjustments.filter("fixed_bonus > 0")
    return {
        "yearly_composition": describe.yearly_composition(base.composition),
        "shared_exam_panel": panel,
        "sensitivity_checks": regressions.sensitivity_checks(
            panel, adjusted, inputs.grades, reps
        ),
        "human_reference_means": panel.filter(F.col("series") == panels.ENSEMBLE)
        .groupBy("year")
        .pivot("exam", inputs.grades)
        .agg(F.max("human_pct")),
        "human_outcome_regressions": regressions.outcome_regressions(panel, reps),
        "forward_predictions": errors,
        "forward_prediction_by_grade": forecast.per_grade_summary(errors),
        "forward_prediction_pooled": forecast.pooled_summary(errors, reps),
        "forward_prediction_sensitivity": forecast.forward_sensitivity(panel, errors, reps),
        "human_mean_sensitivity": forecast.human_mean_sensitivity(panel, reps),
        "variance_decomposition": regressions.variance_decomposition(
            panel, inputs.grades, reps
        ),
    }


def robustness(
    inputs: Inputs,
    base: Base,
    repeat: DataFrame,
    blind: DataFrame,
    late_start: int,
    cutoff_year: int,
) -> dict[str, DataFrame]:
    """Further checks; ``repeat`` and ``blind`` are attempts of two more runs."""
    reps, panel = inputs.repetitions, base.panel
    repeat_scored = scoring.score_attempts(repeat, inputs.items)
    blind_scored = scoring.score_attempts(blind, inputs.items)
    cells = panels.materialize(
        regressions.control_cells(
            regressions.item_controls(base.cells), "correct", ["model"]
        ),
        "cells",
    )
    removal = panels.materialize(
        regressions.control_cells(
            regressions.removal_rows(base.scored, blind_scored), "removal_effect", ["model"]
        ),
        "cells",
    )
    keys = ["model"]
    # one join of item rows per pair of runs; the tables start from the written cells
    again, ablation = (
        panels.materialize(agreement.pair_cells(agreement.paired(base.scored, run), keys), "pairs")
        for run in (repeat_scored, blind_scored)
    )
    return {
        "recent_mean_increment": forecast.recent_mean_increment(panel, reps),
        "ceiling_checks": regressions.ceiling_checks(
            panel, regressions.modality_cells(base.cells), reps
        ),
        "change_correlations": forecast.change_correlations(panel, reps),
        "exposure_checks": regressions.exposure_checks(
            cells,
            removal,
            panel,
            inputs.grades,
            list(inputs.tiers),
            (inputs.reference_model, cutoff_year),
            late_start,
            reps,
        ),
        "rerun_agreement": agreement.agreement(again, keys).join(
            agreement.difference_interval(again, keys, 6500, reps).drop("difference_pp"), keys
        ),
        "ablation_pairs": agreement.paired_comparison(ablation, keys).join(
            agreement.difference_interval(ablation, keys, 5700, reps).drop("difference_pp"), keys
        ),
        "nonlinear_fits": regressions.nonlinear_fits(panel, reps),
        "nonlinear_forward": forecast.nonlinear_forward(
            regressions.nonlinear_terms(panel), reps
        ),
        "within_grade_metrics": regressions.within_grade_metrics(panel, inputs.grades),
    }


def later(
    later_panel: DataFrame,
    later_scored: DataFrame,
    base_scored: DataFrame,
    mapping: DataFrame,
    runs: list[str],
    repetitions: int = REPETITIONS,
) -> dict[str, DataFrame]:
    """Tables of later runs: ``runs`` are a base run, its repeat and its reordered arm."""
    first, repeat, arm = runs
    pairs = [(first, repeat), (repeat, arm), (first, arm)]
    rows = later_scored.unionByName(
        base_scored.filter(F.col("model") == first), allowMissingColumns=True
    )
    matched = agreement.run_pairs(rows, runs, pairs, ["multimodal"])
    return {
        "later_runs": later_runs.later_runs(later_panel, later_scored, repetitions),
        "run_agreement": agreement.subset_agreement(matched, mapping),
        "exam_score_agreement": agreement.exam_score_agreement(later_panel, pairs),
        "option_positions": options.position_effects(
            later_scored.filter(F.col("model") == arm),
            later_scored.filter(F.col("model") == repeat),
            mapping,
        ),
    }


def metrics_sections(tables: dict[str, tuple[DataFrame, list[str], list[str]]]) -> dict[str, tuple[DataFrame, str]]:
    """Sections of a metrics tree from result tables: (table, naming columns, value columns)."""
    return {
        section: (frame.select(F.concat_ws(" / ", *keys).alias("entry"), *values), "entry")
        for section, (frame, keys, values) in tables.items()
    }


def diagnostics_metrics(inputs: Inputs, base: Base) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Contest totals of complete forms and results by image subtype, every model and subtype."""
    totals = base.scores.filter("complete_exam").groupBy("model").agg(
        F.count(F.lit(1)).alias("forms"),
        F.sum("possible_points").alias("possible_points"),
        F.sum("total_score").alias("contest_points"),
    )
    subtypes = describe.accuracy_table(describe.with_conditions(base.cells), ["model", "image_subtype"])
    subtypes = subtypes.withColumnRenamed("abstention_rate", "decline_rate")
    return {
        "contest_totals": (totals, ["model"], ["forms", "possible_points", "contest_points"]),
        "image_subtype": (subtypes, ["model", "image_subtype"], ["items", "accuracy", "decline_rate"]),
    }


def surrogate_metrics(panel: DataFrame) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Forecast errors per series and specification."""
    errors = forecast.forward_errors(panel).groupBy("series", "specification").agg(
        F.count(F.lit(1)).alias("predictions"), F.avg(F.abs("error")).alias("mae")
    )
    return {"forecast_errors": (errors, ["series", "specification"], ["predictions", "mae"])}


def robustness_metrics(scored: DataFrame, repeat: DataFrame) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Agreement of the repeat with the first run, per model."""
    again = agreement.agreement(agreement.paired(scored, repeat), ["model"])
    return {"rerun_agreement": (again, ["model"], ["items", "same_outcome"])}


def run_tables(results: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """The report of one or more runs."""
    return {
        "summary": run_report.run_report(results, by),
        "by_exam": run_report.breakdown(results, [*by, "exam"]),
        "by_year": run_report.breakdown(results, [*by, "year"]),
        "warnings": run_report.warning_counts(results, by),
        "rows_with_warnings": run_report.rows_with_warnings(results, by),
    }
