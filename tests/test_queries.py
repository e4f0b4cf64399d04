"""Registered queries against their SQL twins on the smallest tables, and whole reports."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from examlens.operators.responses import run_records
from examlens.plans import adapters as a
from examlens.plans import adapters_runs as ar
from examlens.plans import reports
from examlens.sources import writers

# one query per family; tools/check_oracle.py compares all of them
COMPARED = [
    "b6_scored_attempts",
    "a1_a9_b12_item_scan",
    "c7_missing_items",
    "e3_shifted_regression",
    "e3_residual_rows",
    "g41_diagnostics_metrics",
    "g41_surrogate_metrics",
    "g41_robustness_metrics",
    "g1_exam_scores",
    "g7_league_table",
    "g14_image_subtype_results",
    "g16_option_positions",
    "g6_slice_scores",
    "g4_lomo_deviation",
    "v1_v4_data_checks",
    "e1_e2_pooled_correlations",
    "e5_out_of_sample_r2",
    "e12_outcome_regressions",
    "e3_fact_regression",
    "w3_forward_errors",
    "w7_shared_slope_errors",
    "g24_subset_agreement",
    "g25_position_effects",
    "i1_answer_extraction_documents",
    "i9_i10_usage",
    "i13_prompts",
    "i17_shuffled_options",
    "g30_run_report",
    "u2_latest_answers",
    "a4_g29_human_scores",
    "a8_run_configs",
    "a14_g41_metrics_tree",
    "r1_usage_rollup_stream",
    "r7_snapshot",
    "r10_tumbling_windows_stream",
]


@pytest.fixture(scope="module")
def database(small_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in Path(small_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sorted(columns, rows):
    """Rows with sorted columns, ordered by values coarse enough for both engines."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def key(row):
        return [(v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row]

    return sorted(([row[i] for i in order] for row in rows), key=key)


def _equal(left, right):
    # both sides are rounded to six digits; a value half-way between two may go either way
    if isinstance(left, float) and isinstance(right, float):
        return left == pytest.approx(right, rel=0, abs=1.1e-6)
    return left == right


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, small_dir, database, name):
    frame = entry_module.queries()[name](spark, small_dir)
    result = database.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    got = _sorted(frame.columns, map(tuple, frame.collect()))
    want = _sorted(columns, result.fetchall())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(_equal, g, w))]
    assert not wrong


def test_registry():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in queries)
    own = [name for name in queries if not re.match(r"op\d+_|pipeline$", name)]
    assert len([name for name in own if name in oracles]) > 0.95 * len(own)


def test_entry(spark, small_dir):
    frame = entry_module.entry(spark)
    assert {r.model for r in frame.collect()} == {"m1", "m2", "m3", "m4"}


def test_reports(spark, small_dir, tmp_path):
    inputs = reports.Inputs(
        items=a.items(spark, small_dir),
        attempts=a.attempts(spark, small_dir),
        adjustments=a.adjustments(spark, small_dir),
        human=a.human(spark, small_dir),
        reference_model=a.REFERENCE_MODEL,
        grades=a.GRADES,
        repetitions=40,
    )
    base = reports.prepare(inputs)
    diagnostics = reports.diagnostics(inputs, base)
    wanted = ["model_performance", "per_grade_calibration", "pooled_statistics"]
    writers.write_tables({name: diagnostics[name] for name in wanted}, str(tmp_path))
    for name in wanted:
        assert spark.read.csv(f"{tmp_path}/{name}", header=True).count() > 0
    tables = {
        **reports.surrogate(inputs, base),
        **reports.robustness(
            inputs,
            base,
            a.repeat_attempts(spark, small_dir),
            a.blind_attempts(spark, small_dir),
            14,
            26,
        ),
    }
    later = reports.later(
        a.later_panel(spark, small_dir),
        a.later_scored(spark, small_dir),
        base.scored,
        a.order_mapping(spark, small_dir),
        [a.OPTION_ORDER_MODEL, *(f"{a.OPTION_ORDER_MODEL}__{arm}" for arm in ("repeat", "option_order"))],
        40,
    )
    assert later["exam_score_agreement"].count() == 3 and later["run_agreement"].count() == 18
    assert later["option_positions"].count() == 5 and later["later_runs"].count() >= 6
    assert tables["forward_prediction_pooled"].count() == 20
    assert tables["ablation_pairs"].count() == 4
    assert all(frame.columns for frame in tables.values())
    run = reports.run_tables(run_records(ar.results(spark, small_dir)), ["model"])
    assert run["by_exam"].count() == 20
