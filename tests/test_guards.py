"""Shifted regressions, join guards, lenient JSON, nested content, coverage per run."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from examlens.functions.answers import extract_answer
from examlens.functions.messages import flatten_content
from examlens.operators import agreement, bootstrap, describe, options, panel, regressions, responses, scoring
from examlens.sources import writers


@pytest.fixture(scope="module")
def line():
    rng = np.random.default_rng(12)
    u = rng.standard_normal(400)
    return u, 3 * u + rng.standard_normal(400) * 0.01


@pytest.mark.parametrize(
    "move", [(2000, 1), (1e5, 1), (1e6, 1), (0, 1e-7), (1e9, 1), (1.7e9, 100)], ids=lambda m: f"{m[0]:g}+{m[1]:g}u"
)
def test_slopes_of_shifted_and_small_predictors(spark, line, move):
    u, y = line
    shift, size = move
    frame = pd.DataFrame({"g": "a", "x": shift + size * u, "y": y, "c": np.arange(400) % 20})
    rows = spark.createDataFrame(frame)
    got = regressions.coefficient(rows, "y", ["x"], None, "x", ["g"], "c", 5, 40).first()
    want = rows.agg(F.regr_slope("y", "x").alias("b"), F.regr_r2("y", "x").alias("r2")).first()
    assert got.coefficient == pytest.approx(want.b, rel=1e-9)
    assert got.r2 == pytest.approx(want.r2, abs=1e-9)
    # two predictors: the second one is unrelated
    rows = rows.withColumn("z", F.sin("c") + 1e6)
    got = regressions.coefficient(rows, "y", ["x", "z"], None, "x", ["g"], "c", 5, 40).first()
    centred = np.column_stack([frame.x - frame.x.mean(), np.sin(frame.c) - np.sin(frame.c).mean()])
    scale = np.abs(centred).max(0)
    beta = np.linalg.lstsq(centred / scale, y - y.mean(), rcond=None)[0] / scale
    assert got.coefficient == pytest.approx(beta[0], rel=1e-6)


def test_constant_predictor_has_no_slope(spark, line):
    rows = spark.createDataFrame(pd.DataFrame({"g": "a", "x": 0.1 + 1e9, "y": line[1], "c": np.arange(400) % 20}))
    assert regressions.coefficient(rows, "y", ["x"], None, "x", ["g"], "c", 5, 40).first().coefficient == 0


def test_draws_are_dealt_before_they_are_made(spark):
    frame = spark.createDataFrame([(c,) for c in range(30)], "year int")
    draws = bootstrap.cluster_draws(frame, "year", 3, 500)
    counted = draws.groupBy("rep").agg(F.sum("weight").alias("n")).collect()
    assert len(counted) == 501 and all(r.n == 30 for r in counted)


def failing(frame):
    with pytest.raises((PySparkException, Py4JJavaError)) as error:
        frame.collect()
    return str(error.value)


ITEM = "item_id int, year int, exam string, points double, answer string, multimodal boolean"


def test_scoring_needs_one_key_row_per_attempt(spark):
    attempts = spark.createDataFrame([("m", 1, "A"), ("m", 2, "B")], "model string, item_id int, predicted string")
    items = [(1, 2000, "e", 3.0, "A", False), (2, 2000, "e", 3.0, "A", False)]
    assert scoring.score_attempts(attempts, spark.createDataFrame(items, ITEM)).count() == 2
    twice = scoring.score_attempts(attempts, spark.createDataFrame([*items, items[0]], ITEM))
    assert "one key row per item" in failing(twice)
    assert "without a key row" in failing(scoring.score_attempts(attempts, spark.createDataFrame(items[:1], ITEM)))


def test_panel_needs_composition_and_every_series(spark):
    scores = [(2000, "e", "a", 50.0), (2000, "e", "b", 60.0), (2001, "e", "a", 50.0), (2001, "e", "b", 55.0)]
    schema = "year int, exam string, model string, model_pct double"
    human = spark.createDataFrame([(2000, "e", 40.0), (2001, "e", 41.0)], "year int, exam string, human_pct double")
    composition = spark.createDataFrame([(2000, "e", 0.1), (2001, "e", 0.2)], "year int, exam string, share double")
    full = panel.build_panel(spark.createDataFrame(scores, schema), human, composition)
    assert full.count() == 6
    assert "without a composition" in failing(
        panel.build_panel(spark.createDataFrame(scores, schema), human, composition.limit(1))
    )
    assert "every exam has every series" in failing(
        panel.build_panel(spark.createDataFrame(scores[:3], schema), human, composition)
    )


def test_runs_need_their_counterparts(spark):
    schema = "model string, item_id int, answered_correctly boolean, declined boolean, predicted_normalized string, awarded_points double, multimodal boolean"
    first = spark.createDataFrame([("m", 1, True, False, "A", 3.0, False)], schema)
    second = spark.createDataFrame([("m", 1, True, False, "A", 3.0, False), ("m", 2, True, False, "A", 3.0, False)], schema)
    assert agreement.paired(second, first).count() == 1
    assert "without a counterpart" in failing(agreement.paired(first, second))


def test_unmapped_attempt(spark):
    names = ", ".join(f"new_{x}_source string" for x in "ABCDE")
    mapping = spark.createDataFrame([(1, *"BACDE")], f"item_id int, {names}")
    attempts = spark.createDataFrame([("m", 1, "A"), ("m", 2, "A")], "model string, item_id int, predicted string")
    assert options.unmap_positions(attempts.limit(1), mapping).first().predicted == "B"
    assert "without a mapping row" in failing(options.unmap_positions(attempts, mapping))


@pytest.mark.parametrize(
    "text, letter",
    [
        ('{"answer":"A","answer":"B"}', "B"),
        ('{"answer":"B","v":NaN}', "B"),
        ('{"answer": "A", "answer": 3}', None),
        ('{"answer":"C"}', "C"),
    ],
)
def test_lenient_json(spark, text, letter):
    row = spark.createDataFrame([(text,)], "t string").select(extract_answer("t").alias("a")).first().a
    if letter:
        assert row.predicted == letter and not row.warning
    else:
        assert row.warning != ""


@pytest.mark.parametrize("levels", range(1, 9))
def test_nested_content(spark, levels):
    listed = objects = '"Final answer: B"'
    listed = f'[{{"content": {listed}}}]'
    for _ in range(levels - 1):
        listed = f'[{{"content": {listed}}}]'
    frame = spark.createDataFrame([(listed,)], "c string").select(F.parse_json("c").alias("v"))
    assert frame.select(flatten_content("v").alias("t")).first().t == "Final answer: B"
    assert objects


def plain_text(content, top=True):
    """The rules of flattened content as a plain recursion."""
    if content is None:
        return "" if top else None
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(t for t in (plain_text(c, False) for c in content) if t) if top else None
    if not isinstance(content, dict):
        return json.dumps(content) if top else None
    nested, calls = content.get("content"), content.get("tool_calls", content.get("arguments"))
    payload, text = content.get("json"), content.get("text")
    held = nested if isinstance(nested, str) else plain_text(nested) if isinstance(nested, list) else None
    payload = None if payload is None else json.dumps(payload, separators=(",", ":"))
    text = text if isinstance(text, str) else None
    choices = [text, payload, held, json.dumps(content, separators=(",", ":"))]
    if not top:
        choices = [payload, text, held, None if calls is None else json.dumps(calls, separators=(",", ":"))]
    return next((c for c in choices if c is not None), None)


def random_content(rng, depth):
    """Content with lists up to fifty levels deep and brackets inside texts."""
    kind = rng.random()
    if depth and kind < 0.75:
        parts = [random_content(rng, 0) for _ in range(rng.randrange(2))]
        parts.insert(rng.randrange(len(parts) + 1), {"content": random_content(rng, depth - 1)})
        return parts
    leaf = rng.choice(["one [", "two ]", "", "three"])
    return rng.choice([leaf, {"text": leaf}, {"content": leaf}, {"json": [1, [2]]}, {"tool_calls": [{"a": leaf}]}, None, [], {"content": []}])


def test_content_of_any_depth(spark):
    rng = random.Random(8)
    contents = [random_content(rng, rng.randrange(51)) for _ in range(150)]
    deep = "x"
    for _ in range(50):
        deep = [{"content": deep}, "y"]
    contents.append(deep)
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(contents)], "i int, c string")
    got = {r.i: r.t for r in frame.select("i", flatten_content(F.parse_json("c")).alias("t")).collect()}
    for i, c in enumerate(contents):
        assert got[i] == plain_text(c), json.dumps(c)[:300]
    assert got[150] == "x" + "\ny" * 50


def test_missing_items_per_run(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    rows = [("m1", 1, "A", None), ("m2", 2, "B", None), ("m2", 3, None, None), ("m1", 3, "C", "timeout")]
    answered = spark.createDataFrame(rows, "model string, item_id int, predicted string, error string")
    got = {tuple(r) for r in responses.missing_items(items, answered, answered.select("model")).collect()}
    assert got == {("m1", 2), ("m1", 3), ("m2", 1), ("m2", 3)}


def test_metric_sections_keep_every_row(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "n int, name string")
    tree = writers.metrics_tree({"many": (rows, None), "one": (rows.limit(1), None), "keyed": (rows, "name")}).first().metrics
    assert '"many":[{"n":1,"name":"a"},{"n":2,"name":"b"}]' in tree
    assert '"one":{"n":' in tree and '"keyed":{"a":{"n":1},"b":{"n":2}}' in tree


def test_ordered_tables(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")).repartition(6)
    writers.write_tables({"t": rows}, str(tmp_path), {"t": ["n"]})
    files = sorted((tmp_path / "t").glob("part-*.csv"))
    values = [int(x) for f in files for x in f.read_text().split()[1:]]
    assert values == list(range(1000))


def test_residuals_equal_a_dummy_fit(spark):
    rng = np.random.default_rng(6)
    n = 300
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], n), "f": rng.choice(["u", "v", "w"], n), "x": rng.normal(size=n) + 1e5, "z": rng.normal(size=n)})
    frame["y"] = 2 * frame.x - frame.z + (frame.f == "u") * 5 + rng.normal(size=n)
    got = regressions.residual_rows(spark.createDataFrame(frame.reset_index()), "y", ["x", "z"], "f", ["g"]).toPandas()
    got = got.set_index("index").sort_index()
    for _, part in frame.groupby("g"):
        design = np.column_stack([part.x - 1e5, part.z, *[(part.f == level).astype(float) for level in "uvw"]])
        beta = np.linalg.lstsq(design, part.y, rcond=None)[0]
        assert got.residual.loc[part.index].to_numpy() == pytest.approx((part.y - design @ beta).to_numpy(), abs=1e-6)
    one = regressions.residual_rows(spark.createDataFrame(frame), "y", ["x"], None, [])
    assert one.agg(F.sum("residual").alias("s")).first().s == pytest.approx(0, abs=1e-4)


def test_a_listed_form_must_be_in_every_series(spark):
    rows = [(2001, e, s, 50.0) for e in ("3-4", "5-6") for s in ("a", "b")]
    frame = spark.createDataFrame(rows, "year int, exam string, series string, model_pct double")
    forms = spark.createDataFrame([(2001, "5-6")], "year int, exam string")
    assert {r.exam for r in regressions.without_forms(frame, forms).collect()} == {"3-4"}
    partly = frame.filter("NOT (exam = '5-6' AND series = 'b')")
    assert "listed forms in every series" in failing(regressions.without_forms(partly, forms))


def test_image_metadata_must_cover_every_scored_item(spark):
    items = spark.createDataFrame([(1, True, False), (2, None, False)], "item_id long, has_associated_image boolean, has_option_image boolean")
    scored = spark.createDataFrame([(1,), (1,)], "item_id long")
    assert [r.item_id for r in describe.evaluated_items(items, scored).collect()] == [1]
    assert "image metadata" in failing(describe.evaluated_items(items, scored.union(spark.createDataFrame([(2,)], "item_id long"))))
    assert "without item row" in failing(describe.evaluated_items(items, scored.union(spark.createDataFrame([(3,)], "item_id long"))))
