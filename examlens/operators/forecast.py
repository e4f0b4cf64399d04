"""Prospective forecasts of the human mean: every prediction uses earlier years only.

The panel holds one row per (series, exam, year), so ordered windows run over the years of
one exam group. Forecasts that share slopes across exam groups use running differences of
within-group moments instead of a join on ``year < target year``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.linalg import least_squares
from examlens.operators.bootstrap import (
    REPETITIONS,
    cluster_draws,
    interval,
    mean_interval,
)
from examlens.operators.moments import (
    cell_moments,
    correlation,
    pairs,
    partial_correlation,
    total_gram,
    weighted_moments,
    within_gram,
)
from examlens.operators.panel import ENSEMBLE
from examlens.operators.scoring import EXAM

MIN_TRAINING = 8
RECENT_YEARS = 3
# label -> predictors of the four forecast forms
FORECASTS = {
    "Grade mean": [],
    "Visual share": ["multimodal_share"],
    "Model score": ["model_pct"],
    "Model score + visual share": ["model_pct", "multimodal_share"],
}
BASELINE = "Grade mean"
VISUAL = "Visual share"


def _history(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("year")


def _earlier(keys: list[str]):
    return _history(keys).rowsBetween(Window.unboundedPreceding, -1)


def expanding_prediction(predictors: list[str], keys: list[str], outcome: str) -> Column:
    """Prediction of this row from a fit on all earlier rows of its group."""
    window = _earlier(keys)

    def gram(a: str, b: str) -> Column:
        # covariances over the frame; the common factor n cancels in the solution
        return F.covar_pop(F.col(a), F.col(b)).over(window)

    prediction = F.avg(outcome).over(window)
    for name, beta in least_squares(gram, predictors, outcome).items():
        prediction = prediction + beta * (F.col(name) - F.avg(name).over(window))
    return prediction


def forward_errors(
    panel: DataFrame,
    specifications: dict[str, list[str]] | None = None,
    outcome: str = "human_pct",
) -> DataFrame:
    """Errors of expanding-window forecasts per exam group, series and form.

    Eligible targets have at least eight earlier rows. The baseline error of the same
    target is carried along, so no self-join is needed.
    """
    specifications = specifications or FORECASTS
    keys = ["series", "exam"]
    position = F.row_number().over(_history(keys)) - 1
    predicted = {
        f"_p{i}": expanding_prediction(predictors, keys, outcome)
        for i, predictors in enumerate(specifications.values())
    }
    frame = panel.withColumns({"training_years": position, **predicted}).filter(
        F.col("training_years") >= MIN_TRAINING
    )
    labels = list(specifications)
    baseline = F.col(outcome) - F.col(f"_p{labels.index(BASELINE)}")
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("specification"), F.col(f"_p{i}").alias("predicted"))
            for i, label in enumerate(labels)
        ]
    )
    visual = (
        F.col(outcome) - F.col(f"_p{labels.index(VISUAL)}")
        if VISUAL in labels
        else F.lit(None).cast("double")
    )
    return frame.select(
        "series",
        *EXAM,
        F.col("training_years").cast("bigint").alias("training_years"),
        F.col(outcome).alias("observed"),
        baseline.alias("baseline_error"),
        visual.alias("visual_error"),
        F.inline(rows),
    ).withColumn("error", F.col("observed") - F.col("predicted"))


def forward_metrics() -> list[Column]:
    """Aggregates of a frame with ``error`` and ``baseline_error``."""
    error, base = F.col("error"), F.col("baseline_error")
    return [
        F.count(F.lit(1)).cast("bigint").alias("predictions"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(base)).alias("baseline_mae"),
        F.avg(F.abs(error) - F.abs(base)).alias("mae_change"),
        (1 - F.try_divide(F.sum(error * error), F.sum(base * base))).alias("forward_r2"),
        F.count_if(F.abs(error) < F.abs(base)).cast("bigint").alias("years_beating_baseline"),
    ]


def per_grade_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("series", "exam", "specification").agg(*forward_metrics())


def _change_intervals(
    errors: DataFrame, keys: list[str], seed: int, repetitions: int
) -> DataFrame:
    """Intervals of the mean absolute error change against baseline and visual share."""
    return mean_interval(
        errors,
        {
            "mae_change": F.abs("error") - F.abs("baseline_error"),
            "mae_change_vs_visual": F.abs("error") - F.abs("visual_error"),
        },
        keys,
        "year",
        seed,
        repetitions,
    )


def pooled_summary(
    errors: DataFrame, repetitions: int = REPETITIONS, seed: int = 5200
) -> DataFrame:
    """Pooled forecast metrics per series and form, with intervals against both references."""
    keys = ["series", "specification"]
    grades = (
        per_grade_summary(errors)
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("mae") < F.col("baseline_mae"))
            .cast("bigint")
            .alias("grades_beating_baseline_mae")
        )
    )
    return (
        errors.groupBy(*keys)
        .agg(*[m for m in forward_metrics()])
        .drop("mae_change")
        .join(_change_intervals(errors, keys, seed, repetitions), keys)
        .join(grades, keys)
    )


def recent_mean_errors(panel: DataFrame, outcome: str = "human_pct") -> DataFrame:
    """Forecast by the mean of the previous three rows of the exam group."""
    keys = ["series", "exam"]
    recent = _history(keys).rowsBetween(-RECENT_YEARS, -1)
    return (
        panel.withColumns(
            {
                "training_years": F.row_number().over(_history(keys)) - 1,
                "predicted": F.avg(outcome).over(recent),
            }
        )
        .filter(F.col("training_years") >= MIN_TRAINING)
        .select(
            "series",
            *EXAM,
            F.col("training_years").cast("bigint").alias("training_years"),
            F.col(outcome).alias("observed"),
            "predicted",
            (F.col(outcome) - F.col("predicted")).alias("error"),
        )
    )


def shared_slope_errors(
    panel: DataFrame, predictors: list[str], outcome: str = "human_pct"
) -> DataFrame:
    """Forecast with an intercept per exam group and slopes shared by all groups.

    The pooled within-group moments of all earlier years are a running sum over years of
    each row's *change* in its own group's within moments. That replaces the join of every
    target with every earlier year.
    """
    keys = ["series", "exam"]
    columns = [*predictors, outcome]
    own = cell_moments(panel, columns, [*keys, "year"])
    names = [c for c in own.columns if c not in (*keys, "year")]
    history = _history(keys)
    running = own.withColumns(
        {
            **{
                f"b_{c}": F.coalesce(
                    F.sum(c).over(history.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
                )
                for c in names
            },
            "training_years": F.row_number().over(history) - 1,
        }
    )

    def centred(prefix: str, a: str, b: str) -> Column:
        pair = "__".join(sorted((a, b)))
        after = {c: F.col(f"b_{c}") + (F.col(c) if prefix == "after" else F.lit(0.0)) for c in names}
        product = after[f"s_{a}"] * after[f"s_{b}"]
        return after[f"q_{pair}"] - F.coalesce(F.try_divide(product, after["n"]), F.lit(0.0))

    used = pairs(columns)
    deltas = running.groupBy("series", "year").agg(
        *[
            F.sum(centred("after", a, b) - centred("before", a, b)).alias(f"d_{a}__{b}")
            for a, b in used
        ]
    )
    before_year = (
        Window.partitionBy("series").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    )
    pooled = deltas.select(
        "series",
        "year",
        *[F.sum(f"d_{a}__{b}").over(before_year).alias(f"w_{a}__{b}") for a, b in used],
    )
    targets = running.filter(F.col("training_years") >= MIN_TRAINING).join(
        pooled, ["series", "year"]
    )
    prediction = F.col(f"b_s_{outcome}") / F.col("b_n")
    for name, beta in least_squares(within_gram, predictors, outcome).items():
        prediction = prediction + beta * (
            F.col(f"s_{name}") - F.col(f"b_s_{name}") / F.col("b_n")
        )
    return targets.select(
        "series",
        *EXAM,
        F.col("training_years").cast("bigint").alias("training_years"),
        F.col(f"s_{outcome}").alias("observed"),
        prediction.alias("predicted"),
    ).withColumn("error", F.col("observed") - F.col("predicted"))


def forward_sensitivity(
    panel: DataFrame, errors: DataFrame, repetitions: int = REPETITIONS, seed: int = 5500
) -> DataFrame:
    """Recent-mean baseline and shared-slope forecasts against both references."""
    history = (
        recent_mean_errors(panel.filter(F.col("series") == ENSEMBLE))
        .withColumn("series", F.lit("none"))
        .withColumn("specification", F.lit("Recent mean (last three years)"))
    )
    shared = shared_slope_errors(panel, ["model_pct"]).withColumn(
        "specification", F.lit("Model score, shared slope")
    )
    references = errors.filter(
        (F.col("series") == ENSEMBLE) & (F.col("specification") == BASELINE)
    ).select(*EXAM, "baseline_error", "visual_error")
    joined = history.unionByName(shared).join(references, EXAM)
    keys = ["series", "specification"]
    return (
        joined.groupBy(*keys)
        .agg(*forward_metrics())
        .drop("mae_change")
        .join(_change_intervals(joined, keys, seed, repetitions), keys)
    )


def recent_mean_changes(panel: DataFrame) -> DataFrame:
    """Deviation of the outcome and the score from their own previous-three-row means."""
    keys = ["series", "exam"]
    recent = _history(keys).rowsBetween(-RECENT_YEARS, -1)
    complete = F.count(F.lit(1)).over(recent) == RECENT_YEARS

    def change(name: str) -> Column:
        return F.when(complete, F.col(name) - F.avg(name).over(recent))

    return panel.select(
        "series",
        *EXAM,
        change("human_pct").alias("human_change"),
        change("model_pct").alias("model_change"),
        (F.row_number().over(_history(keys)) - 1).alias("training_years"),
    )


def recent_mean_increment_errors(panel: DataFrame) -> DataFrame:
    """Recent-mean forecast plus b times the score's own change; b fitted on earlier years."""
    changes = recent_mean_changes(panel)
    x, y = F.col("model_change"), F.col("human_change")
    yearly = changes.groupBy("series", "year").agg(
        F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx")
    )
    before = Window.partitionBy("series").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    slopes = yearly.select(
        "series",
        "year",
        F.try_divide(F.sum("xy").over(before), F.sum("xx").over(before)).alias("slope"),
    )
    return (
        changes.filter(F.col("training_years") >= MIN_TRAINING)
        .join(slopes, ["series", "year"])
        .select(
            "series",
            *EXAM,
            y.alias("baseline_error"),
            (y - F.col("slope") * x).alias("error"),
            "slope",
        )
    )


def recent_mean_increment(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 6000
) -> DataFrame:
    """Metrics of the recent-mean increment per series; the slope of the last target year."""
    errors = recent_mean_increment_errors(panel)
    summary = errors.groupBy("series").agg(
        *forward_metrics(),
        (10 * F.max_by("slope", F.struct("year"))).alias("final_slope_per_10pp_model"),
    )
    change = mean_interval(
        errors,
        {"mae_change": F.abs("error") - F.abs("baseline_error")},
        ["series"],
        "year",
        seed,
        repetitions,
    )
    return summary.drop("mae_change").join(change, "series")


def yearly_changes(panel: DataFrame) -> DataFrame:
    """Differences to the previous calendar year within an exam group; gaps are dropped."""
    history = _history(["series", "exam"])

    def step(name: str) -> Column:
        return F.col(name) - F.lag(name).over(history)

    return (
        panel.select(
            "series",
            *EXAM,
            step("year").alias("gap"),
            step("human_pct").alias("human"),
            step("model_pct").alias("model"),
            step("multimodal_share").alias("visual"),
        )
        .filter(F.col("gap") == 1)
        .drop("gap")
    )


def change_correlations(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 6200
) -> DataFrame:
    """Correlation of yearly changes, raw and given the change in visual share."""
    changes = yearly_changes(panel)
    columns = ["human", "model", "visual"]
    cells = cell_moments(changes, columns, ["series", "year"])
    draws = cluster_draws(changes, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, ["series"], None, draws, "year")
    replicates = moments.select(
        "series",
        "rep",
        F.col("n"),
        correlation(total_gram, "human", "model").alias("correlation"),
        partial_correlation(total_gram, "human", "model", ["visual"]).alias(
            "partial_correlation_given_visual"
        ),
    )
    counts = replicates.filter("rep = 0").select(
        "series", F.col("n").cast("bigint").alias("changes")
    )
    return interval(
        replicates, ["series"], ["correlation", "partial_correlation_given_visual"], repetitions
    ).join(counts, "series")


def human_mean_sensitivity(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 5200
) -> DataFrame:
    """Bin-midpoint means against reported means, and ensemble forecasts on the former."""
    ensemble = panel.filter(F.col("series") == ENSEMBLE)
    gap = F.when(
        F.col("human_mean_source") == "reported", F.col("histogram_pct") - F.col("human_pct")
    )
    deviations = ensemble.agg(
        F.count(gap).cast("bigint").alias("forms_reported"),
        F.count_if(F.col("human_mean_source") == "histogram").cast("bigint").alias("forms_estimated"),
        F.avg(gap).alias("midpoint_minus_reported_mean"),
        F.avg(F.abs(gap)).alias("midpoint_minus_reported_mae"),
        F.max(F.abs(gap)).alias("midpoint_minus_reported_max_abs"),
    ).withColumn("series", F.lit(ENSEMBLE))
    errors = forward_errors(ensemble, outcome="histogram_pct")
    pooled = pooled_summary(errors, repetitions, seed)

    def of(label: str, value: str) -> Column:
        return F.max(F.when(F.col("specification") == label, F.col(value)))

    forecasts = pooled.groupBy("series").agg(
        of(BASELINE, "mae").alias("forward_baseline_mae"),
        of(VISUAL, "mae").alias("forward_visual_mae"),
        of("Model score", "mae").alias("forward_ensemble_mae"),
        of("Model score", "mae_change").alias("forward_ensemble_mae_change"),
        of("Model score", "mae_change_ci_low").alias("forward_ensemble_mae_change_ci_low"),
        of("Model score", "mae_change_ci_high").alias("forward_ensemble_mae_change_ci_high"),
    )
    return deviations.join(forecasts, "series").drop("series")


def nonlinear_forward(
    terms: DataFrame, repetitions: int = REPETITIONS, seed: int = 8300
) -> DataFrame:
    """Forecast errors of the nonlinear forms, per exam group and with shared slopes.

    ``terms`` is the panel with the centred terms of ``regressions.nonlinear_terms``. Each
    form is compared with the visual-share forecast of its own kind.
    """
    from examlens.operators.regressions import NONLINEAR

    per_grade = {BASELINE: [], VISUAL: ["multimodal_share"]}
    per_grade |= {k: v for k, v in NONLINEAR.items() if k != "Model score + visual share"}
    own = forward_errors(terms, per_grade)
    references = own.filter(F.col("specification") == BASELINE).select(
        "series", *EXAM, "baseline_error"
    )
    grade_rows = own.filter(~F.col("specification").isin(BASELINE, VISUAL)).select(
        "series",
        *EXAM,
        "specification",
        F.lit("Per grade").alias("form"),
        "error",
        "baseline_error",
        "visual_error",
    )
    shared_visual = shared_slope_errors(terms, ["multimodal_share"]).select(
        "series", *EXAM, F.col("error").alias("visual_error")
    )
    shared = None
    for label, predictors in NONLINEAR.items():
        part = shared_slope_errors(terms, predictors).select(
            "series", *EXAM, F.lit(label).alias("specification"), "error"
        )
        shared = part if shared is None else shared.unionByName(part)
    shared_rows = (
        shared.join(shared_visual, ["series", *EXAM])
        .join(references, ["series", *EXAM])
        .withColumn("form", F.lit("Shared across grades"))
    )
    rows = grade_rows.unionByName(shared_rows.select(*grade_rows.columns))
    keys = ["series", "specification", "form"]
    return (
        rows.groupBy(*keys)
        .agg(*forward_metrics(), F.avg(F.abs("visual_error")).alias("visual_mae"))
        .drop("mae_change")
        .join(_change_intervals(rows, keys, seed, repetitions), keys)
    )


def forecast_changes(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 7302
) -> DataFrame:
    """Per series: change in forecast error of the model score in three forms.

    Per-grade and shared-slope forecasts against the grade mean, and the score added to
    visual share against visual share alone.
    """
    errors = forward_errors(panel)
    wanted = {"Model score": "per_grade", "Model score + visual share": "with_visual_vs_visual"}
    own = errors.filter(F.col("specification").isin(*wanted)).select(
        "series",
        *EXAM,
        F.when(F.col("specification") == "Model score", "per_grade")
        .otherwise("with_visual_vs_visual")
        .alias("comparison"),
        "error",
        F.when(F.col("specification") == "Model score", F.col("baseline_error"))
        .otherwise(F.col("visual_error"))
        .alias("baseline_error"),
    )
    base = errors.filter(F.col("specification") == BASELINE).select(
        "series", *EXAM, "baseline_error"
    )
    shared = (
        shared_slope_errors(panel, ["model_pct"])
        .join(base, ["series", *EXAM])
        .select("series", *EXAM, F.lit("shared_slope").alias("comparison"), "error", "baseline_error")
    )
    recent = recent_mean_increment_errors(panel).select(
        "series", *EXAM, F.lit("recent_mean").alias("comparison"), "error", "baseline_error"
    )
    stacked = own.unionByName(shared).unionByName(recent)
    return mean_interval(
        stacked,
        {"mae_change": F.abs("error") - F.abs("baseline_error")},
        ["series", "comparison"],
        "year",
        seed,
        repetitions,
    )


def _per_grade(panel: DataFrame, predictors: list[str]) -> DataFrame:
    label = "chosen"
    errors = forward_errors(panel, {BASELINE: [], label: predictors})
    return errors.filter(F.col("specification") == label).drop("specification", "visual_error")


# Forecasters by name; each takes the panel and its predictors and returns errors per target.
FORECASTERS = {
    "per_grade": _per_grade,
    "recent_mean": lambda panel, predictors: recent_mean_errors(panel),
    "shared_slope": shared_slope_errors,
}


def forecast(panel: DataFrame, forecaster: str, predictors: list[str]) -> DataFrame:
    """Errors of a named forecaster: ``series, year, exam, observed, predicted, error``."""
    errors = FORECASTERS[forecaster](panel, predictors)
    return errors.select("series", *EXAM, "observed", "predicted", "error")


def mae_change(
    errors: DataFrame,
    reference: DataFrame,
    by: list[str],
    seed: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """Change in mean absolute error between two forecasts of the same targets."""
    keys = ["series", *EXAM]
    base = reference.select(*keys, F.col("error").alias("baseline_error"))
    return mean_interval(
        errors.join(base, keys),
        {"mae_change": F.abs("error") - F.abs("baseline_error")},
        by,
        "year",
        seed,
        repetitions,
    )
