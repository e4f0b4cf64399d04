"""Agreement, option order, responses, run report, selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlens.functions.messages import coerce_byte_list, coerce_bytes, flatten_content
from examlens.functions.quantiles import exact_quantiles
from examlens.functions import common
from examlens.operators import agreement, options, responses, run_report, selection
from examlens.operators.selection import Selection


@pytest.fixture(scope="module")
def two_runs(spark):
    rng = np.random.default_rng(0)
    n = 3000
    first, second = rng.uniform(size=n) < 0.8, rng.uniform(size=n) < 0.75

    def run(correct):
        return spark.createDataFrame(
            pd.DataFrame(
                {
                    "model": "m",
                    "item_id": np.arange(n),
                    "answered_correctly": correct,
                    "declined": False,
                    "predicted_normalized": np.where(correct, "A", "B"),
                    "awarded_points": np.where(correct, 3.0, -0.75),
                    "multimodal": np.arange(n) % 3 == 0,
                }
            )
        )

    return first, second, agreement.paired(run(first), run(second))


def test_kappa(two_runs):
    first, second, pairs = two_runs
    row = agreement.agreement(pairs, ["model"]).first()
    same = (first == second).mean()
    chance = first.mean() * second.mean() + (1 - first.mean()) * (1 - second.mean())
    assert row.kappa == pytest.approx((same - chance) / (1 - chance))
    assert row.same_outcome == pytest.approx(same)
    assert row.changed_text_only + row.changed_multimodal == int((first != second).sum())


def test_item_bootstrap_on_cells_matches_resampling_items(two_runs):
    first, second, pairs = two_runs
    row = agreement.difference_interval(pairs, ["model"], 1, 1500).first()
    difference = second.astype(float) - first.astype(float)
    rng = np.random.default_rng(2)
    means = rng.choice(difference, (1500, len(difference))).mean(axis=1)
    low, high = 100 * np.percentile(means, [2.5, 97.5])
    assert row.difference_pp == pytest.approx(100 * difference.mean())
    assert row.difference_pp_ci_low == pytest.approx(low, abs=0.25)
    assert row.difference_pp_ci_high == pytest.approx(high, abs=0.25)


def test_run_pairs_need_every_run(spark):
    rows = [("a", 1, True), ("b", 1, False), ("a", 2, True)]
    scored = spark.createDataFrame(rows, "model string, item_id int, answered_correctly boolean").withColumns(
        {
            "declined": F.lit(False),
            "predicted_normalized": F.lit("A"),
            "awarded_points": F.lit(1.0),
            "multimodal": F.lit(False),
        }
    )
    got = agreement.run_pairs(scored, ["a", "b"], [("a", "b")], ["multimodal"]).collect()
    assert [(r.item_id, r.first, r.second) for r in got] == [(1, "a", "b")]


def _items(spark, n=500):
    rows = [
        (i, "ABCDE"[i % 5], "text", *[f"{x}{i}" for x in "vwxyz"], i % 10 == 0) for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "item_id int, answer string, problem_statement string, sol_A string, sol_B string, "
        "sol_C string, sol_D string, sol_E string, has_option_image boolean",
    )


def test_shuffled_options_keep_their_key(spark):
    items = _items(spark)
    before = {r.item_id: r for r in items.collect()}
    moved = 0
    for r in options.shuffle_options(items).collect():
        old = before[r.item_id]
        assert r[f"sol_{r.answer}"] == old[f"sol_{old.answer}"]
        assert sorted(r[f"sol_{x}"] for x in "ABCDE") == sorted(old[f"sol_{x}"] for x in "ABCDE")
        assert r.new_answer == r.answer
        if old.has_option_image:
            assert r.kept_order_reason == "option images" and r.answer == old.answer
        moved += r.answer != old.answer
    # a random order moves four keys of five
    assert 0.7 < moved / 450 < 0.9


def test_positions_map_back(spark):
    mapping = options.option_mapping(options.shuffle_options(_items(spark, 50)))
    rows = [("m", 1, "A"), ("m", 2, " b"), ("m", 3, "DECLINED"), ("m", 4, None), ("m", 5, "x")]
    attempts = spark.createDataFrame(rows, "model string, item_id int, predicted string")
    got = {r.item_id: r for r in options.unmap_positions(attempts, mapping).collect()}
    source = {r.item_id: r for r in mapping.collect()}
    assert got[1].predicted == source[1].new_A_source
    assert got[2].predicted == source[2].new_B_source and got[2].position == "B"
    assert got[3].predicted == "DECLINED"
    assert got[4].predicted is None and got[5].predicted == "x"
    first = options.unmap_positions(attempts, mapping, blank_is_first=True)
    assert {r.item_id: r.predicted for r in first.collect()}[4] == source[4].new_A_source


@pytest.mark.parametrize(
    "text, tied",
    [
        ("Welche Aussage B gilt", True),
        ("siehe (C)", True),
        ("A und B", True),
        ("die obige Figur", True),
        ("Möglichkeit D", True),
        ("Das A ist ein Buchstabe", False),
        ("plain", False),
    ],
)
def test_letter_references(spark, text, tied):
    row = spark.createDataFrame([(text,)], "t string").select(
        F.col("t").rlike(options.LETTER_REFERENCE).alias("x")
    ).first()
    assert row.x == tied


@pytest.mark.parametrize(
    "content, text",
    [
        ("null", ""),
        ('"plain"', "plain"),
        ('["a", {"type": "text", "text": "b"}, {"text": ""}]', "a\nb"),
        ('[{"json": {"answer": "b"}}]', '{"answer":"b"}'),
        ('[{"content": ["x", {"content": "y"}]}]', "x\ny"),
        ('[{"arguments": {"k": 1}}, {"other": 2}, 7]', '{"k":1}'),
        ('{"text": "t", "json": 1}', "t"),
        ('{"content": [{"text": "deep"}]}', "deep"),
    ],
)
def test_message_content(spark, content, text):
    frame = spark.createDataFrame([(content,)], "c string").select(F.parse_json("c").alias("v"))
    assert frame.select(flatten_content("v").alias("t")).first().t == text


def test_bytes(spark):
    frame = spark.createDataFrame(
        [("QUFBQUFBQUFBQUFBQUFBQQ==", ["short", None, "QUFBQUFBQUFBQUFBQUFBQQ=="]), ("QUFB", ["x"])],
        "t string, l array<string>",
    )
    got = frame.select(coerce_bytes("t", "text").alias("b"), coerce_byte_list("l", "text").alias("l")).collect()
    assert bytes(got[0].b) == b"A" * 16 and [bytes(x) for x in got[0].l] == [b"A" * 16]
    assert got[1].b is None and got[1].l is None


def test_usage_quirks(spark):
    body = (
        '{"usage":{"completion_tokens":7,"completion_tokens_details":'
        '{"reasoning_tokens":3,"explicit_reasoning_tokens":2},"cost":0,"total_cost":0.5}}'
    )
    rows = [
        ("a", 1, body, None),
        ("a", 2, '{"usage":{"output_tokens":1}}', None),
        ("b", 1, '{"usage":{"prompt_tokens":"12"}}', None),
        ("c", 1, "{}", "input_tokens=5;output_tokens=2,cost=x"),
    ]
    raw = spark.createDataFrame(rows, "item_id string, attempt int, response string, usage_header string")
    got = {r.item_id: r for r in responses.normalize_usage(raw).collect()}
    # reasoning counts in both columns; the explicit count comes on top
    assert (got["a"].completion_tokens, got["a"].reasoning_tokens, got["a"].explicit_reasoning_tokens) == (8, 3, 5)
    assert got["a"].cost_usd == 0.5
    assert got["b"].prompt_tokens == 12
    assert (got["c"].prompt_tokens, got["c"].completion_tokens, got["c"].cost_usd) == (5, 2, None)
    assert got["c"].explicit_reasoning_tokens == 2


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantiles_are_exact_on_skewed_groups(spark, q):
    rng = np.random.default_rng(1)
    hot = np.round(rng.lognormal(3, 2, 50_000), 2)
    cold = rng.normal(size=7)
    frame = pd.DataFrame(
        {"g": ["hot"] * len(hot) + ["cold"] * len(cold) + ["one"], "v": [*hot, *cold, 4.0]}
    )
    got = {
        r.g: r.q for r in exact_quantiles(spark.createDataFrame(frame), ["g"], "v", {"q": q}).collect()
    }
    for name, values in (("hot", hot), ("cold", cold), ("one", np.array([4.0]))):
        assert got[name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantile_of_ties_and_whole_frame(spark):
    frame = spark.range(10_000).select((F.col("id") % 2).cast("double").alias("v"))
    row = exact_quantiles(frame, [], "v", {"median": 0.5, "high": 0.9}).first()
    assert (row.median, row.high) == (0.5, 1.0)


def test_report_counts_declined_as_answered(spark):
    rows = [
        ("r", "e", 4.0, "A", True, 4.0, None, 10.0, 5, ["w"]),
        ("r", "e", 4.0, "DECLINED", False, 0.0, None, 30.0, None, []),
        ("r", "e", 4.0, None, False, -1.0, "HTTP 500", None, None, None),
    ]
    results = spark.createDataFrame(
        rows,
        "model string, exam string, points double, predicted string, is_correct boolean, "
        "points_earned double, error string, latency_ms double, total_tokens long, warnings array<string>",
    ).withColumns(
        {
            n: F.lit(None).cast("bigint")
            for n in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "explicit_reasoning_tokens")
        }
    ).withColumn("cost_usd", F.lit(None).cast("double"))
    row = run_report.run_report(results, ["model"]).first()
    assert (row.answered_count, row.declined_count, row.failed_count) == (2, 1, 1)
    assert row.accuracy == 0.5 and row.unknown_usage_count == 1
    assert row.points_weighted_accuracy == pytest.approx((3.0 + 3) / (12 + 3))
    assert (row.mean_latency_ms, row.median_latency_ms, row.total_cost_usd) == (20.0, 20.0, 0.0)
    group = run_report.breakdown(results, ["exam"]).first()
    assert group.points_weighted_accuracy == 0.5


def test_selection_order_and_errors(spark):
    items = spark.range(100).select(
        F.col("id").alias("item_id"),
        (F.col("id") % 4 + 2000).cast("int").alias("year"),
        F.lit("e").alias("exam"),
        F.lit("de").alias("language"),
        F.lit(3.0).alias("points"),
        (F.col("id") % 2 == 0).alias("multimodal"),
    )
    chosen = Selection(years=[2001], limit=10)
    assert selection.select_items(items, chosen).count() == 10
    first = Selection(years=[2001], limit=10, limit_first=True)
    assert selection.select_items(items, first).count() == 3
    seeded = Selection(limit=5, seed=1)
    assert selection.select_items(items, seeded).collect() == selection.select_items(items, seeded).collect()
    assert selection.select_items(items, Selection(text_only=True)).count() == 50
    with pytest.raises(ValueError, match="exclude"):
        Selection(text_only=True, vision_only=True)
    for bad in ("2001", "a-b", "1-2-3"):
        with pytest.raises(ValueError, match="low-high"):
            selection.parse_range(bad, int)


def test_item_tables_are_split_by_their_items(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_ITEMS", 10)
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100)
    assert common.dealt(rows, 10, "id") is rows
    assert common.dealt(rows, 1000, "id").rdd.getNumPartitions() == max(asked, 100)


def test_paired_runs_are_scored_in_tasks_of_set_size(spark, tmp_path, monkeypatch):
    from examlens.plans import queries_runs

    monkeypatch.setattr(common, "TASK_ITEMS", 10)
    key = F.col("id") + 1
    spark.range(400).select(
        key.alias("o_orderkey"),
        F.timestamp_seconds(F.lit(800000000) + key * 86400).alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    paired = queries_runs.run_pairs(spark, str(tmp_path))
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" in plan and "40), REPARTITION_BY_NUM" in plan
    assert paired.count() == 400 * len(queries_runs.RUN_PAIRS)
