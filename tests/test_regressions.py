"""Regressions against least squares on the full dummy design, also on unbalanced panels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlens.functions import linalg, stats
from examlens.operators import bootstrap, moments
from examlens.operators import regressions as reg
from tests.panels import GROUPS, design, generated_panel, noisy, ols

REPS = 40


@pytest.fixture(scope="module", params=[0, 9], ids=["balanced", "unbalanced"])
def data(request, spark):
    frame = noisy(generated_panel(0.5, drop=request.param))
    return frame, spark.createDataFrame(frame).repartition(4).cache()


def series_of(frame, name="ensemble"):
    return frame[frame.series == name].reset_index(drop=True)


def test_outcome_regressions(data):
    frame, panel = data
    got = reg.outcome_regressions(panel, REPS).toPandas().set_index(["series", "specification"])
    for series in ("m1", "ensemble"):
        rows = series_of(frame, series)
        for label, (covariates, absorbed) in reg.SPECIFICATIONS.items():
            factors = ["exam"] if absorbed else []
            beta, r2 = ols(rows, "human_pct", ["model_pct", *covariates], factors)
            _, base = ols(rows, "human_pct", covariates, factors)
            row = got.loc[series, label]
            assert row.effect_per_10pp_model == pytest.approx(10 * beta["model_pct"], rel=1e-7)
            assert row.r2_full == pytest.approx(r2, abs=1e-9)
            assert row.r2_increment == pytest.approx(r2 - base, abs=1e-9)


def test_controlled_models_report_the_design(data):
    frame, panel = data
    got = reg.controlled_models(panel, REPS).toPandas().set_index("specification")
    rows = series_of(frame)
    for label, (covariates, absorbed) in reg.SPECIFICATIONS.items():
        factors = ["exam"] if absorbed else []
        x = design(rows, ["human_pct", *covariates], factors)
        singular = np.linalg.svd(x, compute_uv=False)
        assert got.loc[label, "parameters"] == x.shape[1]
        assert got.loc[label, "rank"] == np.linalg.matrix_rank(x)
        assert got.loc[label, "condition_number"] == pytest.approx(singular[0] / singular[-1], rel=1e-6)


def test_year_effects_with_missing_cells(data):
    frame, panel = data
    adjusted = panel.select("year", "exam").distinct().orderBy("year", "exam").limit(2)
    keys = [tuple(r) for r in adjusted.collect()]
    adjusted = panel.sparkSession.createDataFrame(keys, "year long, exam string")
    got = reg.sensitivity_checks(panel, adjusted, GROUPS, REPS).toPandas().set_index(["series", "check"])
    rows = series_of(frame, "m2")
    beta, _ = ols(rows, "human_pct", ["model_pct"], ["exam", "year"])
    assert got.loc[("m2", "Grade + year FE"), "effect_per_10pp_model"] == pytest.approx(
        10 * beta["model_pct"], rel=1e-7
    )
    kept = rows[[k not in keys for k in zip(rows.year, rows.exam)]]
    beta, _ = ols(kept, "human_pct", ["model_pct"], ["exam"])
    row = got.loc[("m2", "Grade FE, excluding fixed-credit forms")]
    assert row.effect_per_10pp_model == pytest.approx(10 * beta["model_pct"], rel=1e-7)
    assert row.comparisons == len(kept)
    slopes = [
        10 * ols(rows[rows.year != y], "human_pct", ["model_pct"], ["exam"])[0]["model_pct"]
        for y in rows.year.unique()
    ]
    row = got.loc[("m2", "Grade FE, leave one year out")]
    assert (row.effect_per_10pp_model, row.ci_low_per_10pp, row.ci_high_per_10pp) == pytest.approx(
        (np.mean(slopes), min(slopes), max(slopes)), rel=1e-7
    )


def test_variance_decomposition(data):
    frame, panel = data
    got = reg.variance_decomposition(panel, GROUPS, REPS).toPandas().set_index("outcome")
    rows = series_of(frame, "m3")
    beta, r2 = ols(rows, "model_pct", ["multimodal_share"], ["exam"])
    _, grade = ols(rows, "model_pct", [], ["exam"])
    both, _ = ols(rows, "model_pct", ["multimodal_share"], ["exam", "year"])
    trend, _ = ols(rows, "model_pct", ["multimodal_share", "year"], ["exam"])
    row = got.loc["m3"]
    name = "effect_per_10pp_visual_share"
    assert row.visual_r2_increment == pytest.approx(r2 - grade, abs=1e-9)
    assert row[name] == pytest.approx(0.1 * beta["multimodal_share"], rel=1e-7)
    assert row[f"{name}_year_fe"] == pytest.approx(0.1 * both["multimodal_share"], rel=1e-6)
    assert row[f"{name}_trend"] == pytest.approx(0.1 * trend["multimodal_share"], rel=1e-6)


def test_nonlinear_fits(data):
    frame, panel = data
    got = reg.nonlinear_fits(panel, REPS).toPandas().set_index(["series", "specification"])
    rows = series_of(frame, "m0")
    rows = rows.assign(
        model=rows.model_pct - rows.model_pct.mean(),
        visual=rows.multimodal_share - rows.multimodal_share.mean(),
    )
    rows = rows.assign(model_x_visual=rows.model * rows.visual, model_squared=rows.model**2)
    for label, predictors in reg.NONLINEAR.items():
        beta, r2 = ols(rows, "human_pct", predictors, ["exam"])
        row = got.loc[("m0", label)]
        assert row.r2 == pytest.approx(r2, abs=1e-9)
        if "model_x_visual" in predictors:
            offset = 0.45 - rows.multimodal_share.mean()
            slope = 10 * (beta["model"] + offset * beta["model_x_visual"])
            assert row.added_term == pytest.approx(beta["model_x_visual"], rel=1e-6)
            assert row.slope_per_10pp_at_visual_45 == pytest.approx(slope, rel=1e-6)


def test_within_grade_metrics(data):
    frame, panel = data
    got = reg.within_grade_metrics(panel, GROUPS).first()
    rows = series_of(frame)
    assert got.human_r2_grade == pytest.approx(ols(rows, "human_pct", [], ["exam"])[1], abs=1e-9)
    both = ols(rows, "human_pct", [], ["exam", "year"])[1]
    assert got.human_r2_grade_year == pytest.approx(both, abs=1e-9)


@pytest.fixture(scope="module")
def item_rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    frame = pd.DataFrame(
        {
            "model": rng.choice(["a", "b"], n, p=[0.7, 0.3]),
            "year": rng.choice(np.arange(2001, 2026), n),
            "exam": rng.choice(GROUPS, n),
            "points_tier": rng.choice(["3", "4", "5"], n),
            "subtype": rng.choice(["00", "01", "10"], n),
        }
    )
    chance = 0.5 + 0.01 * (frame.year - 2013) + 0.1 * (frame.points_tier == "3")
    frame["correct"] = (rng.uniform(size=n) < chance).astype(float)
    frame["decade"] = frame.year / 10
    return frame, spark.createDataFrame(frame)


FACTORS = {"subtype": ["00", "01", "10"], "exam": GROUPS, "points_tier": ["3", "4", "5"]}


def test_decade_trend_at_equal_composition(item_rows):
    frame, rows = item_rows
    cells = reg.control_cells(rows, "correct", ["model"])
    got = reg.decade_trend(cells, ["model"], FACTORS, REPS).toPandas().set_index("model")
    for model in ("a", "b"):
        own = frame[frame.model == model]
        beta, _ = ols(own, "correct", ["decade"], list(FACTORS))
        assert got.loc[model, "estimate"] == pytest.approx(100 * beta["decade"], rel=1e-6)
        assert got.loc[model, "units"] == len(own)


def test_cutoff_gap_resamples_items(item_rows):
    frame, rows = item_rows
    cells = reg.control_cells(rows, "correct", ["model"])
    got = reg.cutoff_gap(cells, ["model"], 2025, 2013, FACTORS, 400).toPandas().set_index("model")
    own = frame[(frame.model == "a") & (frame.year >= 2013)].reset_index(drop=True)
    own = own.assign(after_cutoff=(own.year == 2025).astype(float))
    beta, _ = ols(own, "correct", ["after_cutoff"], list(FACTORS))
    assert got.loc["a", "estimate"] == pytest.approx(100 * beta["after_cutoff"], rel=1e-6)
    rng = np.random.default_rng(5)
    draws = [
        100
        * ols(own.iloc[rng.integers(0, len(own), len(own))], "correct", ["after_cutoff"], list(FACTORS))[0][
            "after_cutoff"
        ]
        for _ in range(400)
    ]
    width = np.subtract(*np.percentile(draws, [97.5, 2.5]))
    assert got.loc["a", "estimate_ci_high"] - got.loc["a", "estimate_ci_low"] == pytest.approx(width, rel=0.2)


def test_cluster_interval_equals_brute_force_on_the_same_draws(spark, data):
    frame, panel = data
    draws = bootstrap.cluster_draws(panel, "year", 5100, REPS).toPandas()
    got = reg.outcome_regressions(panel, REPS, 5100).toPandas().set_index(["series", "specification"])
    rows = series_of(frame, "m1")
    values = []
    for rep in range(1, REPS + 1):
        weights = draws[draws.rep == rep]
        assert weights.weight.sum() == rows.year.nunique()
        sample = rows.merge(weights, on="year")
        sample = sample.loc[sample.index.repeat(sample.weight.astype(int))]
        values.append(10 * ols(sample, "human_pct", ["model_pct", "multimodal_share"], ["exam"])[0]["model_pct"])
    row = got.loc[("m1", "Grade FE + visual share")]
    assert (row.effect_per_10pp_model_ci_low, row.effect_per_10pp_model_ci_high) == pytest.approx(
        tuple(np.percentile(values, [2.5, 97.5])), rel=1e-6
    )


def test_spearman_interval_ranks_every_replicate(spark, data):
    frame, panel = data
    rounded = panel.withColumn("human_pct", F.round("human_pct", 0))  # ties
    rows = series_of(frame).assign(human_pct=lambda f: np.floor(f.human_pct + 0.5))
    draws = bootstrap.cluster_draws(panel, "year", 9, REPS).toPandas()
    only = rounded.filter("series = 'ensemble'")
    got = reg.spearman_intervals(only, ["series"], "year", 9, REPS).first()
    values = []
    for rep in range(REPS + 1):
        sample = rows.merge(draws[draws.rep == rep], on="year")
        sample = sample.loc[sample.index.repeat(sample.weight.astype(int))]
        ranks = sample[["human_pct", "model_pct"]].rank()
        values.append(np.corrcoef(ranks.human_pct, ranks.model_pct)[0, 1])
    assert got.spearman_rho == pytest.approx(values[0], rel=1e-9)
    assert (got.spearman_rho_ci_low, got.spearman_rho_ci_high) == pytest.approx(
        tuple(np.percentile(values[1:], [2.5, 97.5])), rel=1e-9
    )


def test_callable_interval_agrees_with_moments(data):
    _, panel = data
    only = panel.filter("series IN ('m1', 'm2')").select("series", "year", "human_pct", "model_pct")
    by_moments = reg.pearson_intervals(only, ["series"], "year", 4, REPS).toPandas()
    by_function = bootstrap.callable_interval(
        only, lambda f: np.corrcoef(f.human_pct, f.model_pct)[0, 1], ["series"], "year", 4, REPS
    ).toPandas()
    merged = by_moments.merge(by_function, on="series")
    assert np.allclose(merged.pearson_r_ci_low, merged.statistic_ci_low, rtol=1e-9)
    assert np.allclose(merged.pearson_r_ci_high, merged.statistic_ci_high, rtol=1e-9)


def test_rank_deficient_designs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    frame = pd.DataFrame(
        {"x": x, "z": 2 * x, "c": 1.0, "u": rng.normal(size=60), "y": 3 * x + rng.normal(size=60)}
    )
    columns = list(frame.columns)
    row = moments.weighted_moments(
        moments.cell_moments(spark.createDataFrame(frame), columns, ["u"]), columns, [], None
    )
    for predictors in (["x"], ["x", "z"], ["x", "u"], ["c"], ["x", "c"], ["x", "z", "u"]):
        solved = linalg.least_squares(moments.total_gram, predictors, "y")
        got = row.select(*[b.alias(n) for n, b in solved.items()]).first()
        centred = frame[predictors] - frame[predictors].mean()
        y = (frame.y - frame.y.mean()).to_numpy()
        want = centred.to_numpy() @ np.linalg.lstsq(centred.to_numpy(), y, rcond=1e-9)[0]
        fitted = centred.to_numpy() @ np.array([got[n] for n in predictors])
        assert np.allclose(fitted, want, atol=1e-7), predictors


def test_constant_columns_give_null_correlations(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert frame.agg(stats.pearson(F.col("a"), F.col("b")).alias("r")).first().r is None


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.14111328125), (0.5, 5, 0.391002218955771), (-0.5, 3, 2 / 3)])
def test_p_values(spark, r, n, p):
    got = spark.range(1).select(stats.two_sided_p(F.lit(r), F.lit(n)).alias("p")).first().p
    assert got == pytest.approx(p, rel=1e-9)


def _quantile_by_sums(n, p, u):
    """Binomial quantile by summing probabilities within 12 standard deviations, in numpy."""
    mean, sd = n * p, np.sqrt(n * p * (1 - p))
    ks = np.arange(max(0, int(mean - 12 * sd)), min(n, int(mean + 12 * sd)) + 1)
    steps = np.log((n - ks[:-1]) / (ks[:-1] + 1)) + np.log(p / (1 - p))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return int(ks[np.searchsorted(np.cumsum(weights) / weights.sum(), u, side="right")])


def test_binomial_quantiles_of_many_trials_take_a_set_number_of_steps(spark):
    rng = np.random.default_rng(3)
    cases = [(int(10 ** rng.uniform(3.3, 6)), float(rng.uniform(0.25, 0.8)), float(rng.uniform(1e-4, 1 - 1e-4))) for _ in range(300)]
    # beyond six deviations, where a sum from there on leaves out what lies further
    cases += [(9330214, 0.5774836611762979, 3.254795512531272e-9), (7083240, 0.5139291293661671, 0.9999999967452045)]
    frame = spark.createDataFrame(cases, "n bigint, p double, u double")
    near, whole = (f(F.col("n"), F.col("p"), F.col("u")) for f in (stats._near_quantile, stats.binomial_quantile))
    got = frame.select("*", near.alias("near"), whole.alias("whole")).collect()
    for r in got:
        assert r.near == r.whole == _quantile_by_sums(r.n, r.p, r.u), r
    huge = spark.createDataFrame([(10**12, 0.5, 0.5)], "n bigint, p double, u double").select(whole).first()[0]
    assert abs(huge - 5 * 10**11) <= 1
