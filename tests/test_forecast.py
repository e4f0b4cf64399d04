"""Recovery of constructed relations and agreement with refitting every target."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlens.operators import forecast as fc
from examlens.operators import regressions as reg
from tests.panels import GROUPS, design, generated_panel, noisy

REPS = 50


def test_exact_linear_relation_is_forecast_exactly(spark):
    panel = spark.createDataFrame(generated_panel(0.5)).filter("series = 'ensemble'")
    errors = fc.forward_errors(panel)
    got = fc.pooled_summary(errors, REPS).toPandas().set_index("specification")
    exact = got.loc["Model score"]
    assert exact.mae < 1e-9 and exact.forward_r2 == pytest.approx(1.0)
    assert exact.predictions == 15 * len(GROUPS)
    assert exact.years_beating_baseline == exact.predictions
    assert exact.grades_beating_baseline_mae == len(GROUPS)
    assert got.loc["Grade mean", "forward_r2"] == 0.0
    assert got.loc["Grade mean", "mae_change"] == 0.0


def test_fixed_effect_slope_is_recovered(spark):
    panel = spark.createDataFrame(generated_panel(0.5))
    got = reg.outcome_regressions(panel, REPS).toPandas().set_index(["series", "specification"])
    row = got.loc[("ensemble", "Grade fixed effects")]
    assert row.effect_per_10pp_model == pytest.approx(5.0)
    assert row.effect_per_10pp_model_ci_low - 1e-9 <= 5.0 <= row.effect_per_10pp_model_ci_high + 1e-9
    assert row.r2_full == pytest.approx(1.0)


def test_variance_shares_are_recovered(spark):
    panel = spark.createDataFrame(generated_panel(0.0))
    got = reg.variance_decomposition(panel, GROUPS, REPS).toPandas().set_index("outcome")
    assert got.loc["human_pct", "r2_grade"] == pytest.approx(1.0)
    assert got.loc["human_pct", "visual_r2_increment"] == pytest.approx(0.0, abs=1e-9)
    assert got.loc["ensemble", "effect_per_10pp_visual_share"] == pytest.approx(3.0, abs=0.5)


@pytest.fixture(scope="module", params=[0, 12], ids=["balanced", "unbalanced"])
def data(request, spark):
    frame = noisy(generated_panel(0.4, seed=2, drop=request.param))
    return frame, spark.createDataFrame(frame).cache()


def _targets(rows: pd.DataFrame):
    for exam, group in rows.groupby("exam"):
        group = group.sort_values("year")
        for position in range(fc.MIN_TRAINING, len(group)):
            yield exam, group.iloc[position], group.iloc[:position]


def _fit(frame, predictors, factors):
    x = design(frame, predictors, factors)
    return np.linalg.lstsq(x, frame.human_pct.to_numpy(float), rcond=None)[0]


def test_forward_errors_equal_refits(data):
    frame, panel = data
    rows = frame[frame.series == "m1"]
    got = fc.forward_errors(panel.filter("series = 'm1'")).toPandas()
    got = got.set_index(["exam", "year", "specification"])
    for exam, target, earlier in _targets(rows):
        for label, predictors in fc.FORECASTS.items():
            beta = _fit(earlier, predictors, [])
            want = beta[0] + sum(b * target[p] for b, p in zip(beta[1:], predictors))
            assert got.loc[(exam, target.year, label), "predicted"] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize(
    "predictors", [["model_pct"], ["model", "visual"], ["model", "visual", "model_x_visual"]]
)
def test_shared_slopes_equal_refits(data, predictors):
    frame, panel = data
    rows = frame[frame.series == "m1"]
    rows = rows.assign(
        model=rows.model_pct - rows.model_pct.mean(),
        visual=rows.multimodal_share - rows.multimodal_share.mean(),
    )
    rows = rows.assign(model_x_visual=rows.model * rows.visual).reset_index(drop=True)
    terms = reg.nonlinear_terms(panel.filter("series = 'm1'"))
    got = fc.shared_slope_errors(terms, predictors).toPandas().set_index(["exam", "year"])
    checked = 0
    for exam, target, _ in _targets(rows):
        train = rows[rows.year < target.year].reset_index(drop=True)
        beta = _fit(train, predictors, ["exam"])
        levels = sorted(train.exam.unique())[1:]
        shift = dict(zip(levels, beta[1 + len(predictors):])).get(exam, 0.0)
        want = beta[0] + shift + sum(b * target[p] for b, p in zip(beta[1:], predictors))
        assert got.loc[(exam, target.year), "predicted"] == pytest.approx(want, abs=1e-6)
        checked += 1
    assert checked == len(got)


def test_recent_mean_increment_equals_refits(data):
    frame, panel = data
    rows = frame[frame.series == "m2"].sort_values(["exam", "year"]).reset_index(drop=True)
    by = rows.groupby("exam", sort=False)

    def change(column):
        return rows[column] - by[column].transform(lambda v: v.shift(1).rolling(3).mean())

    human, model = change("human_pct"), change("model_pct")
    got = fc.recent_mean_increment_errors(panel.filter("series = 'm2'")).toPandas()
    got = got.set_index(["exam", "year"])
    for i in np.flatnonzero(by.cumcount().to_numpy() >= 8):
        train = (rows.year < rows.year[i]) & model.notna()
        slope = (model[train] * human[train]).sum() / (model[train] ** 2).sum()
        row = got.loc[(rows.exam[i], rows.year[i])]
        assert row.slope == pytest.approx(slope, rel=1e-9)
        assert row.error == pytest.approx(human[i] - slope * model[i], abs=1e-9)


def test_changes_skip_calendar_gaps(data):
    frame, panel = data
    got = fc.yearly_changes(panel.filter("series = 'm0'")).toPandas()
    rows = frame[frame.series == "m0"].sort_values(["exam", "year"])
    gaps = rows.groupby("exam").year.diff()
    assert len(got) == int((gaps == 1).sum())
    assert not got.year.eq(2022).any()


def test_named_forecasters_and_their_comparison(data):
    _, panel = data
    one = panel.filter("series = 'm0'")
    shared = fc.forecast(one, "shared_slope", ["model_pct"])
    recent = fc.forecast(one, "recent_mean", [])
    per_grade = fc.forecast(one, "per_grade", ["model_pct"])
    assert shared.count() == recent.count() == per_grade.count()
    row = fc.mae_change(shared, recent, ["series"], 1, REPS).first()
    joined = shared.alias("a").join(recent.alias("b"), ["series", "year", "exam"])
    want = joined.agg(F.avg(F.abs("a.error") - F.abs("b.error")).alias("v")).first().v
    assert row.mae_change == pytest.approx(want)
