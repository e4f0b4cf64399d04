"""Fixed-effect regressions, decompositions and correlations with cluster intervals.

All tables follow one plan: moments per (group, exam, year) in one pass, joined with the
draw table, solved per replicate, summarised with percentiles. Series and specifications
are rows, never separate jobs. ``panel`` is the long panel of ``operators.panel``.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.common import Counted
from examlens.functions.linalg import design_conditioning, least_squares, residual_moment
from examlens.functions.stats import RANK_DIGITS, average_rank, pearson, two_sided_p
from examlens.operators import checks
from examlens.operators.bootstrap import (
    REPETITIONS,
    cluster_draws,
    interval,
    item_draws,
    row_correlation_interval,
)
from examlens.operators.moments import (
    Fit,
    cell_moments,
    centred_cells,
    correlation,
    indicators,
    partial_correlation,
    raw_gram,
    total_gram,
    weighted_moments,
    within_gram,
)
from examlens.operators.panel import ENSEMBLE, demeaned
from examlens.operators.scoring import EXAM

COMPOSITION = ["multimodal_share", "associated_image_share", "option_image_share"]
# label -> (covariates, grade effects absorbed); names of the published tables
SPECIFICATIONS = {
    "Raw": ([], False),
    "Grade fixed effects": ([], True),
    "Grade FE + visual share": (["multimodal_share"], True),
    "Grade FE + image-location shares": (
        ["associated_image_share", "option_image_share"],
        True,
    ),
}


def _gram(absorbed: bool):
    return within_gram if absorbed else total_gram


def _rows(frame: DataFrame, keys: list[str], entries: list[dict[str, Column]]) -> DataFrame:
    """One output row per entry, computed side by side in one projection."""
    structs = [
        F.struct(*[value.alias(name) for name, value in entry.items()]) for entry in entries
    ]
    return frame.select(*keys, F.inline(F.array(*structs)))


def outcome_regressions(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 5100
) -> DataFrame:
    """Human %max on each model series under four specifications."""
    columns = ["human_pct", "model_pct", *COMPOSITION]
    cells = centred_cells(panel, columns, ["series", *EXAM], ["series"])
    draws = cluster_draws(panel, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, ["series"], "exam", draws, "year")
    entries = []
    for label, (covariates, absorbed) in SPECIFICATIONS.items():
        full = Fit(_gram(absorbed), ["model_pct", *covariates], "human_pct")
        base = Fit(_gram(absorbed), covariates, "human_pct")
        entries.append(
            {
                "specification": F.lit(label),
                "covariates": F.lit(", ".join(covariates) or "none"),
                "fixed_effects": F.lit("exam" if absorbed else "none"),
                "effect_per_10pp_model": 10 * full.coefficients["model_pct"],
                "r2_full": full.r2,
                "r2_baseline": base.r2,
            }
        )
    keys = ["series", "specification", "covariates", "fixed_effects"]
    replicates = _rows(moments, ["series", "rep"], entries)
    return _with_r2(replicates, keys, ["effect_per_10pp_model"], ["r2_full", "r2_baseline"], repetitions).withColumn(
        "r2_increment", F.col("r2_full") - F.col("r2_baseline")
    )


def _with_r2(
    replicates: DataFrame,
    keys: list[str],
    resampled: list[str],
    estimates: list[str],
    repetitions: int,
) -> DataFrame:
    """Intervals for ``resampled``; plain replicate-0 values for ``estimates``."""
    return interval(replicates, keys, resampled, repetitions, estimates)


def controlled_models(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 4300
) -> DataFrame:
    """Ensemble %max on the human mean with composition controls.

    Adds the partial correlation, and rank, parameter count and condition number of the
    full design (intercept, predictors, a dummy per exam but the first).
    """
    ensemble = panel.filter(F.col("series") == ENSEMBLE)
    columns = ["human_pct", "model_pct", *COMPOSITION]
    cells = cell_moments(ensemble, columns, EXAM)
    draws = cluster_draws(ensemble, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, [], "exam", draws, "year")
    designs = _design_matrices(cells, columns)
    entries = []
    for label, (covariates, absorbed) in SPECIFICATIONS.items():
        gram = _gram(absorbed)
        fit = Fit(gram, ["human_pct", *covariates], "model_pct")
        entries.append(
            {
                "specification": F.lit(label),
                "covariates": F.lit(", ".join(covariates) or "none"),
                "fixed_effects": F.lit("exam" if absorbed else "none"),
                "effect_per_10pp_human": 10 * fit.coefficients["human_pct"],
                "r2": fit.r2,
                "partial_correlation": partial_correlation(
                    gram, "human_pct", "model_pct", covariates
                ),
                "parameters": (
                    F.lit(2 + len(covariates))
                    + (F.col("levels").cast("int") - 1 if absorbed else F.lit(0))
                ).cast("bigint"),
            }
        )
    keys = ["specification", "covariates", "fixed_effects"]
    replicates = _rows(moments, ["rep"], entries)
    return _with_r2(
        replicates,
        keys,
        ["effect_per_10pp_human"],
        ["r2", "partial_correlation", "parameters"],
        repetitions,
    ).join(designs, "specification")


def _design_matrices(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Rank and condition number per specification from the undemeaned design."""
    sums = [f"s_{c}" for c in columns]
    products = [c for c in cells.columns if c.startswith("q_")]
    per_exam = cells.groupBy("exam").agg(*[F.sum(c).alias(c) for c in ["n", *sums, *products]])
    packed = per_exam.agg(
        F.sort_array(F.collect_list(F.struct("exam", "n", *sums))).alias("levels"),
        *[F.sum(c).alias(c) for c in ["n", *sums, *products]],
    )
    entries = []
    for label, (covariates, absorbed) in SPECIFICATIONS.items():
        names = ["human_pct", *covariates]
        entries.append(
            {
                "specification": F.lit(label),
                "matrix": _cross_product(names, absorbed),
            }
        )
    stacked = _rows(packed, [], entries)
    checked = stacked.withColumn("_c", design_conditioning("matrix"))
    return checked.select(
        "specification",
        F.col("_c.rank").cast("bigint").alias("rank"),
        F.col("_c.condition_number").alias("condition_number"),
    )


def _cross_product(names: list[str], absorbed: bool) -> Column:
    """Flattened X'X of [1, names..., level dummies], built from level sums."""

    def q(a: str, b: str) -> Column:
        return F.col("q_" + "__".join(sorted((a, b))))

    dummies = F.slice("levels", 2, F.size("levels") - 1)
    none = F.array().cast("array<double>")

    def of_levels(field: str) -> Column:
        return F.transform(dummies, lambda level: level[field]) if absorbed else none

    first = F.concat(F.array("n", *[F.col(f"s_{a}") for a in names]), of_levels("n"))
    middle = [
        F.concat(F.array(F.col(f"s_{a}"), *[q(a, b) for b in names]), of_levels(f"s_{a}"))
        for a in names
    ]
    rows = F.concat(first, *middle)
    if not absorbed:
        return rows
    last = F.flatten(
        F.transform(
            dummies,
            lambda level, i: F.concat(
                F.array(level["n"], *[level[f"s_{a}"] for a in names]),
                F.transform(dummies, lambda other, j: F.when(i == j, level["n"]).otherwise(0.0)),
            ),
        )
    )
    return F.concat(rows, last)


def coefficient(
    frame: DataFrame,
    outcome: str,
    predictors: list[str],
    absorb: str | None,
    term: str,
    by: list[str],
    cluster: str,
    seed: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """One regression coefficient per group with its cluster interval and r².

    ``absorb`` names a factor whose levels get their own intercepts.
    """
    columns = [outcome, *predictors]
    keys = list(dict.fromkeys([*by, *([absorb] if absorb else []), cluster]))
    # values are counted from the least one: means of small numbers keep more digits
    least = frame.agg(F.struct(*[F.min(F.col(c).cast("double")).alias(c) for c in columns])).scalar()
    moved = {c: F.col(c).cast("double") - least[c] for c in columns if c not in keys}
    cells = centred_cells(frame.withColumns(moved), columns, keys, by)
    draws = cluster_draws(frame, cluster, seed, repetitions, by)
    moments = weighted_moments(cells, columns, by, absorb, draws, cluster)
    fit = Fit(_gram(absorb is not None), predictors, outcome)
    replicates = moments.select(
        *by, "rep", fit.coefficients[term].alias("coefficient"), fit.r2.alias("r2")
    )
    return _with_r2(replicates, by, ["coefficient"], ["r2"], repetitions)


def residual_rows(
    frame: DataFrame, outcome: str, predictors: list[str], absorb: str | None, by: list[str]
) -> DataFrame:
    """The rows with ``fitted`` and ``residual`` of a least-squares fit per group.

    ``absorb`` names a factor whose levels get their own intercepts. Two aggregates give the
    slopes and the means of every level, both small, and each row is joined to them.
    """
    columns = [outcome, *predictors]
    level = [*by, *([absorb] if absorb else [])]
    cells = centred_cells(frame, columns, level or [F.lit(0).alias("_all")], by)
    fit = Fit(_gram(absorb is not None), predictors, outcome)
    slopes = weighted_moments(cells, columns, by, absorb).select(
        *by, F.struct(*[fit.coefficients[p].alias(p) for p in predictors]).alias("_b")
    )
    means = frame.groupBy(*level).agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_m"))
    line = F.col(f"_m.{outcome}")
    for p in predictors:
        line = line + F.col(f"_b.{p}") * (F.col(p) - F.col(f"_m.{p}"))
    if by:
        facts = means.join(slopes, by)
    else:
        facts = means.withColumn("_b", slopes.select("_b").scalar())
    joined = frame.join(facts, level) if level else frame.withColumns(
        {"_m": means.select("_m").scalar(), "_b": slopes.select("_b").scalar()}
    )
    return joined.withColumn("fitted", line).withColumn("residual", F.col(outcome) - F.col("fitted")).drop("_m", "_b")


def pooled_correlations(panel: DataFrame) -> DataFrame:
    """Pearson and Spearman of every series with the human mean, with p-values."""
    ranked = panel.withColumns(
        {
            "_rank_human": average_rank("human_pct", ["series"]),
            "_rank_model": average_rank("model_pct", ["series"]),
        }
    )
    r = pearson(F.col("human_pct"), F.col("model_pct"))
    rho = pearson(F.col("_rank_human"), F.col("_rank_model"))
    return (
        ranked.groupBy("series")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("comparisons"),
            r.alias("pearson_r"),
            rho.alias("spearman_rho"),
        )
        .withColumns(
            {
                "pearson_p": two_sided_p(F.col("pearson_r"), F.col("comparisons")),
                "spearman_p": two_sided_p(F.col("spearman_rho"), F.col("comparisons")),
            }
        )
    )


def pearson_intervals(
    panel: DataFrame,
    by: list[str],
    cluster: str,
    seed: int,
    repetitions: int = REPETITIONS,
    columns: tuple[str, str] = ("human_pct", "model_pct"),
) -> DataFrame:
    """Pearson r with a cluster-bootstrap interval per group, from moments."""
    first, second = columns
    cells = centred_cells(panel, list(columns), [*by, cluster], by)
    draws = cluster_draws(panel, cluster, seed, repetitions, by)
    moments = weighted_moments(cells, list(columns), by, None, draws, cluster)
    replicates = moments.select(
        *by, "rep", correlation(total_gram, first, second).alias("pearson_r")
    )
    return interval(replicates, by, ["pearson_r"], repetitions)


RANK_BLOCK = 100  # replicates ranked together in one task


def _weighted_ranks(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Average ranks per replicate (row) when item j occurs ``weights[i, j]`` times.

    A tie group that reaches from position p + 1 to p + t has the mean rank p + (t + 1) / 2.
    """
    values = np.round(values, RANK_DIGITS)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    upto = np.cumsum(weights[:, order], axis=1)
    ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    group = np.searchsorted(ends, np.arange(len(values)))
    reached = upto[:, ends]
    tied = np.diff(reached, axis=1, prepend=0.0)
    ranks = np.empty_like(weights)
    ranks[:, order] = (reached - (tied - 1) / 2)[:, group]
    return ranks


def _weighted_correlations(first: np.ndarray, second: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = weights.sum(axis=1, keepdims=True)
    x = first - (weights * first).sum(axis=1, keepdims=True) / total
    y = second - (weights * second).sum(axis=1, keepdims=True) / total
    cross, xx, yy = [(weights * v).sum(axis=1) for v in (x * y, x * x, y * y)]
    size = np.sqrt(xx * yy)
    return np.where(size > 0, cross / np.where(size > 0, size, 1.0), np.nan)


def spearman_intervals(
    panel: DataFrame,
    by: list[str],
    cluster: str,
    seed: int,
    repetitions: int = REPETITIONS,
    columns: tuple[str, str] = ("human_pct", "model_pct"),
) -> DataFrame:
    """Spearman rho with a cluster-bootstrap interval per group.

    Ranks do not reduce to moments, so every replicate ranks its rows. A row drawn w times
    takes w rank positions, so ranks follow from cumulative weights over one sorted order.
    Spark spreads (group, block of replicates); a task holds one group of the panel and the
    weights of a hundred replicates.
    """
    block = F.floor(F.col("rep") / RANK_BLOCK).cast("int").alias("_block")
    draws = cluster_draws(panel, cluster, seed, repetitions, by).select("*", block)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(repetitions // RANK_BLOCK))).alias("_block")
    rows = panel.select(*by, cluster, *columns, blocks)
    keys = [*by, "_block"]

    def evaluate(drawn: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        weights = drawn.pivot_table(
            index="rep", columns=cluster, values="weight", fill_value=0.0
        ).reindex(columns=group[cluster], fill_value=0.0)
        matrix = weights.to_numpy(float)
        ranks = [_weighted_ranks(group[c].to_numpy(float), matrix) for c in columns]
        out = pd.DataFrame({"rep": weights.index, "spearman_rho": _weighted_correlations(*ranks, matrix)})
        for name in by:
            out[name] = drawn[name].iloc[0]
        return out

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema if f.name in by]
    schema = ", ".join([*types, "rep int", "spearman_rho double"])
    replicates = draws.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(evaluate, schema)
    return interval(replicates, by, ["spearman_rho"], repetitions)


def iid_correlation_interval(
    frame: DataFrame,
    by: list[str],
    columns: tuple[str, str],
    seed: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """Row bootstrap of a Pearson correlation: every (year, exam) row is drawn by itself."""
    keyed = frame.withColumn("_year", F.format_string("%05d", "year"))
    return row_correlation_interval(keyed, by, columns, ["_year", "exam"], seed, repetitions)


def per_grade_correlations(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 4400
) -> DataFrame:
    """Correlation per exam group, also after removing a linear year trend."""
    ensemble = panel.filter(F.col("series") == ENSEMBLE)
    columns = ["human_pct", "model_pct", "year"]
    moments = weighted_moments(
        cell_moments(ensemble, columns, EXAM), columns, ["exam"], None
    )
    detrended = moments.select(
        "exam",
        F.col("n").cast("bigint").alias("comparisons"),
        partial_correlation(total_gram, "human_pct", "model_pct", ["year"]).alias(
            "year_detrended_pearson_r"
        ),
    )
    return pearson_intervals(ensemble, ["exam"], "year", seed, repetitions).join(
        detrended, "exam"
    )


def slice_correlations(
    slices: DataFrame, panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 4500
) -> DataFrame:
    """Correlation and grade-FE slope of slice accuracy on the human mean."""
    human = panel.filter(F.col("series") == ENSEMBLE).select(*EXAM, "human_pct")
    joined = slices.join(human, EXAM, "inner")
    columns = ["human_pct", "ensemble_accuracy"]
    cells = centred_cells(joined, columns, ["slice", *EXAM], ["slice"])
    draws = cluster_draws(joined, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, ["slice"], "exam", draws, "year")
    fit = Fit(within_gram, ["human_pct"], "ensemble_accuracy")
    replicates = moments.select(
        "slice",
        "rep",
        F.col("n").cast("bigint").alias("comparisons"),
        correlation(total_gram, *columns).alias("pearson_r"),
        (1000 * fit.coefficients["human_pct"]).alias("grade_fe_accuracy_pp_per_10pp_human"),
    )
    return _with_r2(
        replicates,
        ["slice"],
        ["pearson_r", "grade_fe_accuracy_pp_per_10pp_human"],
        ["comparisons"],
        repetitions,
    )


def _year_demeaned(frame: DataFrame, by: list[str], columns: list[str], grades: list[str]):
    """Columns and exam dummies demeaned within (by, year).

    Year effects are constant inside a cluster, so they can be removed before any
    resampling; the remaining exam effects stay as dummies and are solved per replicate.
    Exact for unbalanced panels too.
    """
    dummies = indicators({"exam": grades})
    widened = frame.withColumns(dummies)
    keys = [*by, "year"]
    names = [*columns, *dummies]
    return widened.withColumns({f"y_{name}": demeaned(name, keys) for name in names}), [
        f"y_{name}" for name in dummies
    ]


def _two_way_slopes(
    frame: DataFrame,
    by: list[str],
    predictor: str,
    outcome: str,
    grades: list[str],
    draws: DataFrame,
) -> DataFrame:
    """Slope with exam and year effects per (by, rep)."""
    demeaned_frame, dummies = _year_demeaned(frame, by, [predictor, outcome], grades)
    x, y = f"y_{predictor}", f"y_{outcome}"
    columns = [x, y, *dummies]
    cells = cell_moments(demeaned_frame, columns, [*by, "year"])
    moments = weighted_moments(cells, columns, by, None, draws, "year")
    slope = least_squares(_uncentred, [x, *dummies], y)[x]
    return moments.select(*by, "rep", slope.alias("slope"))


def _uncentred(first: str, second: str) -> Column:
    # year-demeaned columns have mean zero in every cluster and so under all weights
    return F.col("t_" + "__".join(sorted((first, second))))


def without_forms(panel: DataFrame, forms: DataFrame) -> DataFrame:
    """The panel without the listed forms; a series in which one of them is missing stops the run."""
    listed = forms.select(*EXAM).distinct().withColumn("_listed", F.lit(1))
    marked = panel.join(listed, EXAM, "left")
    expected = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
    dropped = marked.groupBy("series").agg(F.count("_listed").alias("dropped"))
    check = dropped.agg(
        F.lit("listed forms in every series").alias("check"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("dropped") != expected).alias("violations"),
    )
    return checks.require(check, marked.filter(F.col("_listed").isNull()).select(*panel.columns))


def sensitivity_checks(
    panel: DataFrame,
    adjusted_forms: DataFrame,
    grades: list[str],
    repetitions: int = REPETITIONS,
    seed: int = 5400,
) -> DataFrame:
    """Grade-FE slope without adjusted forms, with year effects, and leaving years out."""
    columns = ["human_pct", "model_pct"]
    keys = ["series", "check"]
    reduced = without_forms(panel, adjusted_forms)
    draws = cluster_draws(panel, "year", seed, repetitions)
    slope = Fit(within_gram, ["model_pct"], "human_pct").coefficients["model_pct"]

    excluding = weighted_moments(
        cell_moments(reduced, columns, ["series", *EXAM]), columns, ["series"], "exam", draws, "year"
    ).select(
        "series",
        "rep",
        F.lit("Grade FE, excluding fixed-credit forms").alias("check"),
        F.col("n").cast("bigint").alias("comparisons"),
        (10 * slope).alias("effect_per_10pp_model"),
    )
    counts = panel.groupBy("series").agg(F.count(F.lit(1)).cast("bigint").alias("comparisons"))
    two_way = (
        _two_way_slopes(panel, ["series"], "model_pct", "human_pct", grades, draws)
        .join(counts, "series")
        .select(
            "series",
            "rep",
            F.lit("Grade + year FE").alias("check"),
            "comparisons",
            (10 * F.col("slope")).alias("effect_per_10pp_model"),
        )
    )
    resampled = _with_r2(
        excluding.unionByName(two_way),
        keys,
        ["effect_per_10pp_model"],
        ["comparisons"],
        repetitions,
    ).select(
        *keys,
        "comparisons",
        "effect_per_10pp_model",
        F.col("effect_per_10pp_model_ci_low").alias("ci_low_per_10pp"),
        F.col("effect_per_10pp_model_ci_high").alias("ci_high_per_10pp"),
    )
    return resampled.unionByName(leave_one_year_out(panel))


def leave_one_year_out(panel: DataFrame) -> DataFrame:
    """Mean, smallest and largest grade-FE slope over all single omitted years.

    The within moments without year t are the full within moments plus the change that
    year t's row makes in its own exam, so one pass over the cells gives every omission.
    """
    columns = ["human_pct", "model_pct"]
    cells = cell_moments(panel, columns, ["series", *EXAM])
    exam = Window.partitionBy("series", "exam")
    names = ["n", "s_human_pct", "s_model_pct", "q_human_pct__model_pct", "q_model_pct__model_pct"]
    totals = cells.withColumns({f"all_{n}": F.sum(n).over(exam) for n in names})

    def centred(pair: str, n: Column, a: Column, b: Column, q: Column) -> Column:
        return q - F.coalesce(F.try_divide(a * b, n), F.lit(0.0))

    def of(prefix: str, x: str) -> Column:
        q = "q_" + "__".join(sorted((x, "model_pct")))
        full = [F.col(f"all_{name}") for name in ("n", f"s_{x}", "s_model_pct", q)]
        if prefix == "all":
            return centred(q, *full)
        rest = [
            F.col(f"all_{name}") - F.col(name) for name in ("n", f"s_{x}", "s_model_pct", q)
        ]
        return centred(q, *rest)

    changes = totals.groupBy("series", "year").agg(
        F.count(F.lit(1)).alias("left_out"),
        F.sum(of("rest", "human_pct") - of("all", "human_pct")).alias("d_xy"),
        F.sum(of("rest", "model_pct") - of("all", "model_pct")).alias("d_xx"),
    )
    full = weighted_moments(cells, columns, ["series"], "exam").select(
        "series",
        F.col("n").cast("bigint").alias("rows"),
        within_gram("human_pct", "model_pct").alias("xy"),
        within_gram("model_pct", "model_pct").alias("xx"),
    )
    slopes = changes.join(full, "series").select(
        "series",
        "rows",
        "left_out",
        (10 * F.try_divide(F.col("xy") + F.col("d_xy"), F.col("xx") + F.col("d_xx"))).alias("slope"),
    )
    return slopes.groupBy("series").agg(
        F.lit("Grade FE, leave one year out").alias("check"),
        F.max(F.col("rows") - F.col("left_out")).cast("bigint").alias("comparisons"),
        F.avg("slope").alias("effect_per_10pp_model"),
        F.min("slope").alias("ci_low_per_10pp"),
        F.max("slope").alias("ci_high_per_10pp"),
    )


def outcome_rows(panel: DataFrame) -> DataFrame:
    """Every series and the human mean as rows of one outcome column ``value``."""
    human = F.when(
        F.col("series") == ENSEMBLE,
        F.struct(F.lit("human_pct").alias("outcome"), F.col("human_pct").alias("value")),
    )
    own = F.struct(F.col("series").alias("outcome"), F.col("model_pct").alias("value"))
    both = F.filter(F.array(own, human), lambda item: item.isNotNull())
    return panel.select(*EXAM, *COMPOSITION, F.inline(both))


def variance_decomposition(
    panel: DataFrame, grades: list[str], repetitions: int = REPETITIONS, seed: int = 5300
) -> DataFrame:
    """Variance of each outcome explained by grade and visual share, and visual slopes."""
    frame = outcome_rows(panel).withColumn("trend", F.col("year").cast("double"))
    columns = ["value", *COMPOSITION, "trend"]
    cells = centred_cells(frame, columns, ["outcome", *EXAM], ["outcome"])
    draws = cluster_draws(frame, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, ["outcome"], "exam", draws, "year")
    visual = Fit(within_gram, ["multimodal_share"], "value")
    location = Fit(within_gram, ["associated_image_share", "option_image_share"], "value")
    trend = Fit(within_gram, ["multimodal_share", "trend"], "value")
    grade_r2 = 1 - F.try_divide(within_gram("value", "value"), total_gram("value", "value"))
    slope = "effect_per_10pp_visual_share"
    one_way = moments.select(
        "outcome",
        "rep",
        F.sqrt(total_gram("value", "value") / (F.col("n") - 1)).alias("sd_total"),
        F.sqrt(within_gram("value", "value") / (F.col("n") - 1)).alias("sd_within_grade"),
        grade_r2.alias("r2_grade"),
        visual.r2.alias("r2_grade_visual"),
        location.r2.alias("r2_grade_location"),
        (visual.r2 - grade_r2).alias("visual_r2_increment"),
        (0.1 * visual.coefficients["multimodal_share"]).alias(slope),
        (0.1 * trend.coefficients["multimodal_share"]).alias(f"{slope}_trend"),
    )
    two_way = _two_way_slopes(
        frame, ["outcome"], "multimodal_share", "value", grades, draws
    ).select("outcome", "rep", (0.1 * F.col("slope")).alias(f"{slope}_year_fe"))
    return _with_r2(
        one_way.join(two_way, ["outcome", "rep"]),
        ["outcome"],
        ["visual_r2_increment", slope, f"{slope}_trend", f"{slope}_year_fe"],
        ["sd_total", "sd_within_grade", "r2_grade", "r2_grade_visual", "r2_grade_location"],
        repetitions,
    )


NONLINEAR = {
    "Model score + visual share": ["model", "visual"],
    "Model score x visual share": ["model", "visual", "model_x_visual"],
    "Model score squared + visual share": ["model", "model_squared", "visual"],
}
CONDITIONAL_SHARES = [0.30, 0.45, 0.60]


def nonlinear_terms(panel: DataFrame) -> DataFrame:
    """Centred model score and visual share with their product and the squared score."""
    model, visual = demeaned("model_pct", ["series"]), demeaned("multimodal_share", ["series"])
    centred = panel.withColumns(
        {
            "model": model,
            "visual": visual,
            "mean_visual": F.avg("multimodal_share").over(Window.partitionBy("series")),
        }
    )
    return centred.withColumns(
        {
            "model_x_visual": F.col("model") * F.col("visual"),
            "model_squared": F.col("model") * F.col("model"),
        }
    )


def nonlinear_fits(
    panel: DataFrame, repetitions: int = REPETITIONS, seed: int = 6300
) -> DataFrame:
    """Interaction and quadratic fits with grade effects; slopes at chosen visual shares."""
    terms = nonlinear_terms(panel)
    columns = ["human_pct", "model", "visual", "model_x_visual", "model_squared"]
    cells = cell_moments(terms, columns, ["series", *EXAM])
    draws = cluster_draws(panel, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, ["series"], "exam", draws, "year").join(
        terms.groupBy("series").agg(F.avg("multimodal_share").alias("mean_visual")), "series"
    )
    additive = Fit(within_gram, NONLINEAR["Model score + visual share"], "human_pct")
    missing = F.lit(None).cast("double")
    entries = []
    for label, predictors in NONLINEAR.items():
        fit = Fit(within_gram, predictors, "human_pct")
        beta = fit.coefficients
        added = next((t for t in ("model_x_visual", "model_squared") if t in beta), None)
        parameters = len(predictors) + F.col("levels")
        entry = {
            "specification": F.lit(label),
            "r2": fit.r2,
            "adjusted_r2": 1 - (1 - fit.r2) * (F.col("n") - 1) / (F.col("n") - parameters),
            "r2_increment_over_additive": fit.r2 - additive.r2,
            "added_term": beta[added] if added else missing,
        }
        for at in CONDITIONAL_SHARES:
            value = missing
            if "model_x_visual" in beta:
                offset = F.lit(at) - F.col("mean_visual")
                value = 10 * (beta["model"] + offset * beta["model_x_visual"])
            entry[f"slope_per_10pp_at_visual_{round(100 * at)}"] = value
        entries.append(entry)
    replicates = _rows(moments, ["series", "rep"], entries)
    resampled = ["added_term"] + [
        f"slope_per_10pp_at_visual_{round(100 * at)}" for at in CONDITIONAL_SHARES
    ]
    plain = replicates.filter("rep = 0").select(
        "series", "specification", "r2", "adjusted_r2", "r2_increment_over_additive", *resampled
    )
    bounds = _optional_intervals(replicates, ["series", "specification"], resampled)
    return plain.join(bounds, ["series", "specification"], "left")


def _optional_intervals(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Percentile bounds of columns that some specifications do not have.

    A column that a specification has (its replicate 0 is not null) must be finite in 95 % of
    the replicates; replicates that are not finite do not count.
    """
    drawn = F.col("rep") > 0
    usable = {v: F.when(drawn & ~F.isnan(v) & (F.abs(v) != float("inf")), F.col(v)) for v in values}
    aggregates = []
    for v in values:
        aggregates += [
            F.percentile(usable[v], F.array(F.lit(0.025), F.lit(0.975))).alias(v),
            F.count(usable[v]).alias(f"_usable_{v}"),
            F.max(F.when(F.col("rep") == 0, F.col(v).isNotNull())).alias(f"_has_{v}"),
        ]

    def bound(v: str, side: int) -> Column:
        enough = F.col(f"_usable_{v}") >= F.floor(0.95 * F.col("_replicates"))
        return F.when(
            F.col(f"_has_{v}") & ~enough,
            F.raise_error(F.lit(f"too many invalid bootstrap samples of {v}")).cast("double"),
        ).otherwise(F.col(v)[side])

    return (
        frame.groupBy(*keys)
        .agg(F.count_if(drawn).alias("_replicates"), *aggregates)
        .select(
            *keys,
            *[bound(v, 0).alias(f"{v}_ci_low") for v in values],
            *[bound(v, 1).alias(f"{v}_ci_high") for v in values],
        )
    )


def spread_and_association(
    panel: DataFrame,
    keys: list[str],
    repetitions: int = REPETITIONS,
    seed: int = 5101,
) -> DataFrame:
    """Mean, spread, ceiling share, within-grade correlation and grade-FE effect."""
    columns = ["human_pct", "model_pct"]
    cells = cell_moments(panel, columns, [*keys, *EXAM])
    draws = cluster_draws(panel, "year", seed, repetitions)
    moments = weighted_moments(cells, columns, keys, "exam", draws, "year")
    fit = Fit(within_gram, ["model_pct"], "human_pct")
    replicates = moments.select(
        *keys,
        "rep",
        (F.col("s_model_pct") / F.col("n")).alias("mean_pct"),
        F.sqrt(within_gram("model_pct", "model_pct") / (F.col("n") - 1)).alias("sd_within_grade"),
        correlation(within_gram, "human_pct", "model_pct").alias("within_grade_r"),
        (10 * fit.coefficients["model_pct"]).alias("effect_per_10pp_model"),
    )
    ceiling = panel.groupBy(*keys).agg(
        F.avg((F.round("model_pct", 9) >= 95).cast("double")).alias("share_at_least_95"),
        F.avg((F.abs(F.col("model_pct") - 100) <= 1e-8 + 1e-3).cast("double")).alias("share_at_100"),
    )
    return _with_r2(
        replicates,
        keys,
        ["effect_per_10pp_model"],
        ["mean_pct", "sd_within_grade", "within_grade_r"],
        repetitions,
    ).join(ceiling, keys)


def modality_cells(scored: DataFrame) -> DataFrame:
    """Item rows reduced to (model, exam, modality): all that slice tables need."""
    items = Counted(scored)
    return items.frame.groupBy("model", *EXAM, "multimodal").agg(
        items.rows().alias("n"),
        items.count_if(F.col("answered_correctly")).alias("correct"),
        items.total("awarded_points").alias("awarded"),
        items.total("question_points").alias("points"),
    )


def _modality() -> Column:
    return F.when(F.col("multimodal"), "Multimodal items").otherwise("Text-only items")


def slice_panel(cells: DataFrame, human: DataFrame) -> DataFrame:
    """Contest %max per (slice, exam, series) for text-only and multimodal items."""
    pct = 100 * (F.col("n") + F.col("awarded")) / (F.col("n") + F.col("points"))
    series = (
        cells.select(
            _modality().alias("slice"),
            *EXAM,
            F.explode(F.array("model", F.lit(ENSEMBLE))).alias("series"),
            pct.alias("model_pct"),
        )
        .groupBy("slice", *EXAM, "series")
        .agg(F.avg("model_pct").alias("model_pct"))
    )
    return series.join(human.select(*EXAM, "human_pct"), EXAM)


def ceiling_checks(
    panel: DataFrame, cells: DataFrame, repetitions: int = REPETITIONS, seed: int = 5101
) -> DataFrame:
    """Spread and association of every series on all items and on each modality.

    ``cells`` are the :func:`modality_cells` of the scored items.
    """
    everything = panel.select(
        F.lit("All items").alias("slice"), *EXAM, "series", "model_pct", "human_pct"
    )
    human = panel.filter(F.col("series") == ENSEMBLE)
    slices = everything.unionByName(slice_panel(cells, human))
    accuracy = (
        cells.join(human.select(*EXAM), EXAM, "left_semi")
        .select(
            F.col("model").alias("series"),
            F.explode(F.array(F.lit("All items"), _modality())).alias("slice"),
            "n",
            "correct",
        )
        .groupBy("slice", "series")
        .agg((F.sum("correct") / F.sum("n")).alias("item_accuracy"))
    )
    return (
        spread_and_association(slices, ["slice", "series"], repetitions, seed)
        .join(accuracy, ["slice", "series"], "left")
        .drop("share_at_100", "bootstrap_samples")
    )


# --- calibration and early/late fits on the comparison panel -------------------------------


def difficulty_series(comparison: DataFrame) -> DataFrame:
    """Human difficulty against the reference and the ensemble difficulty, long."""
    pairs = F.array(
        F.struct(F.lit("reference").alias("series"), F.col("reference_difficulty").alias("model_difficulty")),
        F.struct(F.lit("ensemble").alias("series"), F.col("ensemble_difficulty").alias("model_difficulty")),
    )
    return comparison.select(*EXAM, "human_difficulty", F.inline(pairs))


def calibration(comparison: DataFrame) -> DataFrame:
    """Line of human on model difficulty per exam group, and the same-side rate."""
    h, m = F.col("human_difficulty"), F.col("model_difficulty")
    return difficulty_series(comparison).groupBy("exam", "series").agg(
        pearson(h, m).alias("correlation"),
        F.avg(((h > 0) == (m > 0)).cast("double")).alias("same_side_rate"),
        F.regr_intercept(h, m).alias("intercept"),
        F.regr_slope(h, m).alias("slope"),
        F.regr_r2(h, m).alias("r2"),
    )


def out_of_sample(comparison: DataFrame) -> DataFrame:
    """R² when fitted before the median year and scored after it, and the reverse."""
    group = ["exam", "series"]
    rows = difficulty_series(comparison)
    split = rows.groupBy(*group).agg(F.median("year").alias("split_year"))
    sided = rows.join(split, group).withColumn("late", F.col("year") >= F.col("split_year"))
    h, m = F.col("human_difficulty"), F.col("model_difficulty")
    per_half = sided.groupBy(*group, "split_year", "late").agg(
        F.regr_slope(h, m).alias("slope"),
        F.regr_intercept(h, m).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
        F.sum(h).alias("h"),
        F.sum(m).alias("m"),
        F.sum(h * h).alias("hh"),
        F.sum(m * m).alias("mm"),
        F.sum(h * m).alias("hm"),
    )
    halves = per_half.groupBy(*group, "split_year").agg(
        *[
            F.max(F.when(F.col("late") == late, F.col(c))).alias(f"{c}_{side}")
            for late, side in [(F.lit(False), "early"), (F.lit(True), "late")]
            for c in ("slope", "intercept", "n", "h", "m", "hh", "mm", "hm")
        ]
    )

    def score(train: str, test: str) -> Column:
        b, a = F.col(f"slope_{train}"), F.col(f"intercept_{train}")
        n, sh, sm, hh, mm, hm = [F.col(f"{c}_{test}") for c in ("n", "h", "m", "hh", "mm", "hm")]
        residual = hh + n * a * a + b * b * mm - 2 * a * sh - 2 * b * hm + 2 * a * b * sm
        return 1 - F.try_divide(residual, hh - sh * sh / n)

    return halves.select(
        *group,
        F.col("split_year").cast("bigint").alias("split_year"),
        score("early", "late").alias("early_to_late_r2"),
        score("late", "early").alias("late_to_early_r2"),
    )


def year_effect_slope(panel: DataFrame) -> DataFrame:
    """Slope of the ensemble on the human mean with year effects."""
    columns = ["human_pct", "model_pct"]
    ensemble = panel.filter(F.col("series") == ENSEMBLE)
    moments = weighted_moments(cell_moments(ensemble, columns, ["year"]), columns, [], "year")
    slope = least_squares(within_gram, ["human_pct"], "model_pct")["human_pct"]
    return moments.select(
        slope.alias("year_fe_human_pct_coefficient"),
        (10 * slope).alias("year_fe_effect_per_10pp"),
    )


def pooled_statistics(comparison: DataFrame, lomo: DataFrame) -> DataFrame:
    """One row of headline statistics over the comparison panel."""
    fits = calibration(comparison).groupBy().agg(
        F.avg(F.when(F.col("series") == "reference", F.col("correlation"))).alias(
            "mean_per_grade_reference_correlation"
        ),
        F.avg(F.when(F.col("series") == "ensemble", F.col("correlation"))).alias(
            "mean_per_grade_ensemble_correlation"
        ),
    )
    signs = comparison.agg(
        F.count(F.lit(1)).cast("bigint").alias("comparisons"),
        F.count_distinct("year").cast("bigint").alias("human_years"),
        F.count_distinct("exam").cast("bigint").alias("grade_buckets"),
        F.count_if("opposite_difficulty_sign").cast("bigint").alias("opposite_sign_count"),
    ).withColumn("opposite_sign_rate", F.col("opposite_sign_count") / F.col("comparisons"))
    deviations = lomo.agg(F.max("max_abs_deviation_sd").alias("max_lomo_deviation_sd"))
    negative = out_of_sample(comparison).agg(
        F.every((F.col("early_to_late_r2") < 0) & (F.col("late_to_early_r2") < 0)).alias(
            "all_oos_r2_negative"
        )
    )
    # every part is one row: the others are scalars of the first
    parts = [
        f.select(F.struct(*f.columns).alias("part")).scalar()[name].alias(name)
        for f in (fits, deviations, negative)
        for name in f.columns
    ]
    return signs.select("*", *parts)


def trend_lines(panel: DataFrame) -> DataFrame:
    """Least-squares line of ensemble on human, raw and within exam groups."""
    ensemble = panel.filter(F.col("series") == ENSEMBLE).withColumns(
        {"_h": demeaned("human_pct", ["exam"]), "_m": demeaned("model_pct", ["exam"])}
    )
    rows = ensemble.select(
        F.inline(
            F.array(
                F.struct(F.lit("raw").alias("view"), F.col("human_pct").alias("x"), F.col("model_pct").alias("y")),
                F.struct(F.lit("within exam").alias("view"), F.col("_h").alias("x"), F.col("_m").alias("y")),
            )
        )
    )
    return rows.groupBy("view").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )


def within_grade_metrics(panel: DataFrame, grades: list[str]) -> DataFrame:
    """Visual-share/year correlation, human spread and r² of grade and year effects."""
    ensemble = panel.filter(F.col("series") == ENSEMBLE).withColumn(
        "trend", F.col("year").cast("double")
    )
    columns = ["human_pct", "multimodal_share", "trend"]
    one_way = weighted_moments(cell_moments(ensemble, columns, EXAM), columns, [], "exam")
    # grade and year effects together: exam dummies on year-demeaned values
    demeaned_frame, dummies = _year_demeaned(ensemble, [], ["human_pct"], grades)
    names = ["y_human_pct", *dummies]
    both = weighted_moments(cell_moments(demeaned_frame, names, ["year"]), names, [], None)
    betas = least_squares(_uncentred, dummies, "y_human_pct")
    unexplained = both.select(
        "rep", residual_moment(_uncentred, betas, "y_human_pct", "y_human_pct").alias("rss")
    )
    human_total = total_gram("human_pct", "human_pct")
    human_within = within_gram("human_pct", "human_pct")
    return one_way.join(unexplained, "rep").select(
        correlation(within_gram, "multimodal_share", "trend").alias(
            "within_grade_visual_share_year_correlation"
        ),
        F.sqrt(human_within / (F.col("n") - 1)).alias("human_sd_within_grade"),
        (1 - human_within / human_total).alias("human_r2_grade"),
        (1 - F.col("rss") / human_total).alias("human_r2_grade_year"),
    )


# --- exposure checks on item rows ----------------------------------------------------------


def item_controls(scored: DataFrame) -> DataFrame:
    """Scored rows with the control variables of the exposure checks."""
    return scored.withColumns(
        {
            "correct": F.col("answered_correctly").cast("double"),
            "decade": F.col("year") / 10,
            "subtype": F.concat(
                F.col("has_associated_image").cast("int").cast("string"),
                F.col("has_option_image").cast("int").cast("string"),
            ),
            "points_tier": F.col("question_points").cast("int").cast("string"),
        }
    )


CONTROLS = ["subtype", "exam", "points_tier"]


def control_cells(rows: DataFrame, outcome: str, by: list[str]) -> DataFrame:
    """Item rows counted per control combination, year and outcome value.

    The outcome takes two or three values, so the table has as many rows as there are
    control combinations, however many items there are. All exposure checks start from it.
    """
    keys = [*by, "year", "decade", *CONTROLS]
    items = Counted(rows)
    return items.frame.groupBy(*keys, F.col(outcome).alias("outcome")).agg(
        items.rows().alias("_n")
    )


def decade_trend(
    cells: DataFrame,
    by: list[str],
    factors: dict[str, list[str]],
    repetitions: int = REPETITIONS,
    seed: int = 6400,
) -> DataFrame:
    """Trend of an item outcome per decade at equal composition (additive dummies)."""
    dummies = indicators(factors)
    columns = ["decade", *dummies]
    cluster = cell_moments(
        cells.withColumns(dummies), [*columns, "outcome"], [*by, "year"], weight="_n"
    )
    draws = cluster_draws(cells, "year", seed, repetitions, by)
    moments = weighted_moments(cluster, [*columns, "outcome"], by, None, draws, "year")
    slope = least_squares(total_gram, columns, "outcome")["decade"]
    replicates = moments.select(*by, "rep", (100 * slope).alias("estimate"))
    units = cells.groupBy(*by).agg(F.sum("_n").cast("bigint").alias("units"))
    return interval(replicates, by, ["estimate"], repetitions).join(units, by)


def cutoff_gap(
    cells: DataFrame,
    by: list[str],
    cutoff_year: int,
    first_year: int,
    factors: dict[str, list[str]],
    repetitions: int = REPETITIONS,
    seed: int = 6410,
) -> DataFrame:
    """Accuracy of one late year against earlier ones at equal composition.

    A single year cannot be resampled as a cluster, so items are resampled, as multinomial
    draws over the cells of the design.
    """
    after = (F.col("year") == cutoff_year).cast("double").alias("after_cutoff")
    recent = (
        cells.filter(F.col("year") >= first_year)
        .groupBy(*by, after, *factors, "outcome")
        .agg(F.sum("_n").alias("_n"))
    )
    dummies = indicators(factors)
    columns = ["after_cutoff", *dummies]
    # both outcomes of a design cell share its dummies: one row per replicate and cell
    sampled = (
        item_draws(recent, "_n", seed, repetitions, by)
        .groupBy(*by, "rep", "after_cutoff", *factors)
        .agg(
            F.sum("weight").alias("weight"),
            F.try_divide(F.sum(F.col("weight") * F.col("outcome")), F.sum("weight")).alias(
                "outcome"
            ),
        )
        .filter("weight > 0")
        .withColumns(dummies)
    )
    names = [*columns, "outcome"]
    moments = cell_moments(sampled, names, [*by, "rep"], weight="weight")
    gap = least_squares(raw_gram, columns, "outcome")["after_cutoff"]
    replicates = moments.select(*by, "rep", (100 * gap).alias("estimate"))
    units = recent.groupBy(*by).agg(F.sum("_n").cast("bigint").alias("units"))
    return interval(replicates, by, ["estimate"], repetitions).join(units, by)


def removal_rows(reference: DataFrame, blind: DataFrame) -> DataFrame:
    """Per item and model: correctness without images minus correctness with them."""
    before = reference.select("model", "item_id", F.col("answered_correctly").alias("_before"))
    joined = checks.present(
        blind.join(before, ["model", "item_id"], "left"), F.col("_before"), "item without a reference run"
    )
    effect = F.col("answered_correctly").cast("double") - F.col("_before").cast("double")
    return item_controls(joined).withColumn("removal_effect", effect)


def period_associations(
    panel: DataFrame,
    late_start: int,
    grades: list[str],
    repetitions: int = REPETITIONS,
    seed: int = 6430,
) -> DataFrame:
    """Grade-FE association of the ensemble before and after a year, with year effects,
    and the change between the periods as an interaction."""
    ensemble = panel.filter(F.col("series") == ENSEMBLE).withColumns(
        {
            "later": (F.col("year") >= late_start).cast("double"),
            "period": F.when(F.col("year") < late_start, f"before {late_start}").otherwise(
                f"{late_start} onward"
            ),
        }
    ).withColumn("model_x_later", F.col("model_pct") * F.col("later"))
    columns = ["human_pct", "model_pct"]
    slope = Fit(within_gram, ["model_pct"], "human_pct").coefficients["model_pct"]
    per_period = weighted_moments(
        cell_moments(ensemble, columns, ["period", *EXAM]),
        columns,
        ["period"],
        "exam",
        cluster_draws(ensemble, "year", seed, repetitions, ["period"]),
        "year",
    ).select(
        F.concat(F.lit("Grade-FE association, contests "), "period").alias("check"),
        "rep",
        (10 * slope).alias("estimate"),
    )
    draws = cluster_draws(ensemble, "year", seed, repetitions)
    both = _two_way_slopes(ensemble, [], "model_pct", "human_pct", grades, draws).select(
        F.lit("Grade + year FE association, all contests").alias("check"),
        "rep",
        (10 * F.col("slope")).alias("estimate"),
    )
    names = ["human_pct", "model_pct", "later", "model_x_later"]
    change = Fit(within_gram, names[1:], "human_pct").coefficients["model_x_later"]
    interaction = weighted_moments(
        cell_moments(ensemble, names, EXAM), names, [], "exam", draws, "year"
    ).select(
        F.lit(f"Change in grade-FE association from {late_start} on (interaction)").alias("check"),
        "rep",
        (10 * change).alias("estimate"),
    )
    stacked = per_period.unionByName(both).unionByName(interaction)
    units = ensemble.select(
        F.explode(
            F.array(
                F.concat(F.lit("Grade-FE association, contests "), "period"),
                F.lit("Grade + year FE association, all contests"),
                F.lit(f"Change in grade-FE association from {late_start} on (interaction)"),
            )
        ).alias("check")
    ).groupBy("check").agg(F.count(F.lit(1)).cast("bigint").alias("units"))
    return interval(stacked, ["check"], ["estimate"], repetitions).join(units, "check")


def exposure_checks(
    cells: DataFrame,
    removal_cells: DataFrame,
    panel: DataFrame,
    grades: list[str],
    tiers: list[str],
    cutoff: tuple[str, int],
    late_start: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """All checks of a training-exposure account as one table.

    ``cells`` and ``removal_cells`` are the :func:`control_cells` of correctness and of the
    image-removal effect.
    """
    factors = {"subtype": ["00", "01", "10", "11"], "exam": grades, "points_tier": tiers}
    columns = ["check", "series", "units", "estimate", "estimate_ci_low", "estimate_ci_high", "unit"]

    def labelled(frame: DataFrame, check: str) -> DataFrame:
        named = {"check": F.lit(check), "series": F.col("model"), "unit": F.lit("pp")}
        return frame.withColumns(named).select(*columns)

    model, year = cutoff
    trend = labelled(
        decade_trend(cells, ["model"], factors, repetitions),
        "Accuracy per later decade, at equal composition",
    )
    gap = labelled(
        cutoff_gap(
            cells.filter(F.col("model") == model), ["model"], year, late_start, factors, repetitions
        ),
        f"Accuracy on {year} minus {late_start}-{year - 1} items, at equal composition (item bootstrap)",
    )
    removal = labelled(
        decade_trend(
            removal_cells,
            ["model"],
            {"exam": grades, "points_tier": tiers},
            repetitions,
            6420,
        ),
        "Image-removal effect per later decade",
    )
    periods = period_associations(panel, late_start, grades, repetitions).select(
        "check",
        F.lit(ENSEMBLE).alias("series"),
        "units",
        "estimate",
        "estimate_ci_low",
        "estimate_ci_high",
        F.lit("per 10 pp model %max").alias("unit"),
    )
    return trend.unionByName(gap).unionByName(removal).unionByName(periods)
