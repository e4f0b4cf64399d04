"""Published values of a panel of 115 exams.

The panel itself is not part of this repository. Point EXAMLENS_GOLDEN_PANEL at a CSV with
one row per exam and one column per series (prefix ``model_pct__``) to run these tests.
"""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlens.operators import forecast as fc
from examlens.operators import panel as panels
from examlens.operators import regressions as reg

PATH = os.environ.get("EXAMLENS_GOLDEN_PANEL")
pytestmark = pytest.mark.skipif(not PATH, reason="EXAMLENS_GOLDEN_PANEL is not set")
PREFIX = "model_pct__"
REPS = 400


@pytest.fixture(scope="module")
def panel(spark):
    wide = pd.read_csv(PATH)
    series = [c for c in wide.columns if c.startswith(PREFIX)]
    long = wide.melt(
        id_vars=[c for c in wide.columns if c not in series],
        value_vars=series,
        var_name="series",
        value_name="model_pct",
    )
    long["series"] = long.series.str.removeprefix(PREFIX)
    # the label that the dummies of the published fits are sorted by
    long["exam"] = long.grade_bucket
    return spark.createDataFrame(long).cache()


@pytest.fixture(scope="module")
def ensemble(panel):
    return panel.filter("series = 'ensemble'")


def close(value, want):
    assert value == pytest.approx(want, rel=1e-9)


def test_correlations(ensemble):
    row = reg.pooled_correlations(ensemble).first()
    close(row.pearson_r, -0.49037806881338686)
    close(row.spearman_rho, -0.4567138210082801)
    assert row.pearson_p == pytest.approx(2.651319316561e-08, rel=1e-8)


def test_outcome_regressions(ensemble):
    got = reg.outcome_regressions(ensemble, REPS).toPandas().set_index("specification")
    close(got.loc["Grade fixed effects", "effect_per_10pp_model"], -2.673004019568852)
    close(got.loc["Grade FE + visual share", "effect_per_10pp_model"], -1.4768239159870211)
    # published with other random draws; equal up to Monte-Carlo error
    row = got.loc["Grade fixed effects"]
    assert row.effect_per_10pp_model_ci_low == pytest.approx(-4.4940, abs=0.4)
    assert row.effect_per_10pp_model_ci_high == pytest.approx(-0.8008, abs=0.4)


def test_spread(ensemble):
    row = reg.spread_and_association(ensemble, ["series"], REPS).first()
    close(row.within_grade_r, -0.3646809020780767)
    close(row.mean_pct, 82.5336180124)
    close(row.sd_within_grade, 5.870144446537714)
    assert row.share_at_least_95 == pytest.approx(0.0173913043, rel=1e-8)


def test_forecasts(panel, ensemble):
    errors = fc.forward_errors(ensemble)
    got = fc.pooled_summary(errors, REPS).toPandas().set_index("specification")
    row = got.loc["Model score"]
    close(row.mae, 4.11515373919375)
    close(row.baseline_mae, 4.158515257036336)
    close(row.forward_r2, -0.006481554904791631)
    assert (row.years_beating_baseline, row.predictions) == (43, 75)
    close(got.loc["Visual share", "mae"], 3.8270728110008236)
    close(got.loc["Model score + visual share", "mae"], 3.87469567115821)
    shared = fc.shared_slope_errors(ensemble, ["model_pct"])
    close(shared.agg(F.avg(F.abs("error")).alias("v")).first().v, 3.9100454672305)


def test_recent_means(ensemble):
    row = fc.recent_mean_increment(ensemble, REPS).first()
    close(row.baseline_mae, 3.550048054367495)
    close(row.mae, 3.423873475906924)
    close(row.forward_r2, 0.03827675709154721)
    close(row.final_slope_per_10pp_model, -1.7681678060224795)


def test_changes(ensemble):
    row = fc.change_correlations(ensemble, REPS).first()
    close(row.correlation, -0.2031323759377975)
    close(row.partial_correlation_given_visual, -0.07413625047034764)
    assert row.changes == 105


def test_year_effects(ensemble):
    grades = [r.exam for r in ensemble.select("exam").distinct().collect()]
    got = reg.variance_decomposition(ensemble, grades, REPS).toPandas().set_index("outcome")
    human = got.loc["human_pct"]
    close(human.effect_per_10pp_visual_share_year_fe, 0.38096443048072354)
    close(human.r2_grade, 0.17669007980741547)
    close(human.r2_grade_visual, 0.3047801471076059)
    close(reg.within_grade_metrics(ensemble, grades).first().human_sd_within_grade, 4.302643656860782)


def test_difficulties(ensemble):
    difficulty = ensemble.withColumn("ensemble_pct", F.col("model_pct")).withColumns(
        {
            "human_difficulty": -panels.z_score("human_pct", ["exam"]),
            "ensemble_difficulty": -panels.z_score("model_pct", ["exam"]),
        }
    )
    opposite = F.col("human_difficulty") * F.col("ensemble_difficulty") < 0
    assert difficulty.filter(opposite).count() == 73
    with_reference = difficulty.withColumn("reference_difficulty", F.col("ensemble_difficulty"))
    got = reg.out_of_sample(with_reference).filter("series = 'ensemble' AND exam LIKE '%3-4'").first()
    close(got.early_to_late_r2, 0.002916107536899193)
