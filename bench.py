"""Headline timings: prints one JSON line.

Each query is built and fully executed once after a short warm-up of the session. The three
reports run all their tables, as the published wall times do.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from examlens.plans import adapters as a  # noqa: E402
from examlens.plans import catalog, reports  # noqa: E402
from examlens.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "b6_scored_attempts",
    "g1_exam_scores",
    "g7_league_table",
    "g6_slice_scores",
    "g14_image_subtype_results",
    "g16_option_positions",
    "g38_panel",
    "e1_e2_pooled_correlations",
    "e12_outcome_regressions",
    "e18_model_correlations",
    "e3_fact_regression",
    "w3_forward_errors",
    "w7_shared_slope_errors",
    "g35_forecast_pooled",
    "g21_paired_comparison",
    "g23_rerun_agreement",
    "i1_answer_extraction_documents",
    "i9_i10_usage",
    "g30_run_report",
    "u2_latest_answers",
    "r1_usage_rollup",
    "r7_snapshot",
    "r10_sliding_windows",
]


def execute(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def run_all(tables) -> None:
    """Independent small tables share the session's task slots."""
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(execute, tables.values()))


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    execute(catalog.QUERIES["g37_dataset_profile"](spark, SF_DIR))
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        execute(catalog.QUERIES[name](spark, SF_DIR))
        timings[name] = round(time.perf_counter() - start, 3)

    inputs = reports.Inputs(
        items=a.items(spark, SF_DIR),
        attempts=a.attempts(spark, SF_DIR),
        adjustments=a.adjustments(spark, SF_DIR),
        human=a.human(spark, SF_DIR),
        reference_model=a.REFERENCE_MODEL,
        grades=a.GRADES,
    )
    start = time.perf_counter()
    base = reports.prepare(inputs)
    run_all(reports.diagnostics(inputs, base))
    timings["report_diagnostics"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    run_all(reports.surrogate(inputs, base))
    timings["report_surrogate"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    repeat, blind = a.repeat_attempts(spark, SF_DIR), a.blind_attempts(spark, SF_DIR)
    run_all(reports.robustness(inputs, base, repeat, blind, 14, 26))
    # the published job contains the tables of the later runs
    run_all(
        reports.later(
            a.later_panel(spark, SF_DIR),
            a.later_scored(spark, SF_DIR),
            base.scored,
            a.order_mapping(spark, SF_DIR),
            [a.OPTION_ORDER_MODEL, *(f"{a.OPTION_ORDER_MODEL}__{arm}" for arm in ("repeat", "option_order"))],
        )
    )
    timings["report_robustness"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries and reports",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name,
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
