import pytest
from pyspark.sql import functions as F

from examlens.functions import scoring as fs
from examlens.operators import checks, describe, scoring

ITEMS = [
    ("i1", 2001, "3-4", 3.0, "A", False, False, False),
    ("i2", 2001, "3-4", 4.0, " b ", True, True, False),
    ("i3", 2001, "3-4", 5.0, "C", True, False, True),
    ("i4", 2002, "5-6", 5.0, None, False, False, False),
]
ATTEMPTS = [
    ("m", "i1", "a "),
    ("m", "i2", "DECLINED"),
    ("m", "i3", None),
    ("m", "i4", "A"),
    ("n", "i1", "B"),
    ("n", "i2", "B"),
    ("n", "i3", "x"),
]


@pytest.fixture(scope="module")
def scored(spark):
    items = spark.createDataFrame(
        ITEMS,
        "item_id string, year int, exam string, points double, answer string, "
        "multimodal boolean, has_associated_image boolean, has_option_image boolean",
    )
    attempts = spark.createDataFrame(ATTEMPTS, "model string, item_id string, predicted string")
    return scoring.score_attempts(attempts, items)


def test_contest_rule(scored):
    rows = {(r.model, r.item_id): r for r in scored.collect()}
    assert rows["m", "i1"].awarded_points == 3.0
    assert rows["m", "i2"].awarded_points == 0.0 and not rows["m", "i2"].attempted
    # a missing prediction counts as attempted and costs a quarter
    assert rows["m", "i3"].awarded_points == -1.25 and rows["m", "i3"].attempted
    assert not rows["m", "i3"].valid_selection
    assert rows["n", "i2"].answered_correctly and rows["n", "i3"].awarded_points == -1.25
    # an item without a key cannot be answered correctly
    assert not rows["m", "i4"].answered_correctly


def test_exam_scores_and_winner(spark, scored):
    adjustments = spark.createDataFrame(
        [(2001, "3-4", 4, 2.0, 17.0)],
        "year int, exam string, official_items int, fixed_bonus double, official_max double",
    )
    rows = {
        (r.model, r.year): r for r in scoring.exam_scores(scored, adjustments).collect()
    }
    first = rows["m", 2001]
    assert first.total_score == 3 + (3.0 - 1.25) + 2.0
    assert first.possible_points == 3 + 12 + 2.0 and first.complete_exam
    assert first.official_questions == 4
    assert rows["m", 2002].possible_points == 6.0 and not rows["m", 2002].complete_exam
    table = {r.model: r for r in scoring.league_table(scoring.exam_scores(scored, adjustments)).collect()}
    # n scores 3 + (4 - 0.75 - 1.25) + 2 = 7 against 6.75
    assert table["m"].exams_won == 0 and table["n"].exams_won == 1
    assert table["m"].items == 4


def test_winner_ties_go_to_the_first_name(spark):
    rows = [("b", 1, "x", 50.0, True), ("a", 1, "x", 50.0, True), ("c", 1, "x", 60.0, False)]
    scores = spark.createDataFrame(
        rows, "model string, year int, exam string, model_pct double, complete_exam boolean"
    )
    assert [tuple(r) for r in scoring.exam_winners(scores).collect()] == [("a", 1)]


def test_scalar_rules(spark):
    frame = spark.createDataFrame(
        [("nan", "7"), ("inf", "3 und 4"), (" 2.5 ", "Klasse 11-13"), ("x", "none"), (None, None)],
        "points string, grp string",
    )
    got = frame.select(
        fs.coerce_points("points").alias("p"), fs.legacy_start_points("grp").alias("s")
    ).collect()
    assert [tuple(r) for r in got] == [(0.0, 30.0), (0.0, 24.0), (2.5, 30.0), (0.0, 0.0), (0.0, 0.0)]


@pytest.mark.parametrize(
    "points, answer, predicted, want",
    [
        ("4", "A", "a", (4.0, True)),
        ("4", "A", None, (-1.0, False)),
        ("4", "A", " declined ", (0.0, False)),
        ("4", "A", "B", (-1.0, False)),
        ("0", "A", "A", (0.0, None)),
        ("4", None, "A", (0.0, None)),
    ],
)
def test_score_question(spark, points, answer, predicted, want):
    frame = spark.createDataFrame(
        [(points, answer, predicted)], "points string, answer string, predicted string"
    )
    row = frame.select(fs.score_question("points", "answer", "predicted").alias("s")).first().s
    assert (row.points_earned, row.is_correct) == want


def test_unanswered_can_be_exempt(spark):
    frame = spark.createDataFrame([("4", "A", None)], "points string, answer string, predicted string")
    scored = fs.score_question("points", "answer", "predicted", penalize_unanswered=False)
    assert frame.select(scored.alias("s")).first().s.points_earned == 0.0


def test_checks_report_and_raise(spark):
    frame = spark.createDataFrame([(1, 2.0), (1, None)], "k int, v double")
    one = checks.predicate_check(frame, "present", F.col("v").isNotNull())
    assert one.first().violations == 1
    assert checks.unique_key_check(frame, "unique", ["k"]).first().violations == 1
    assert checks.row_count_check(frame, "rows", 5).first().violations == 3
    assert checks.require(checks.row_count_check(frame, "rows", 2), frame).count() == 2
    with pytest.raises(Exception, match="failed checks: present"):
        checks.require(one, frame).collect()


def test_subtype_counts_keep_empty_categories(spark, scored):
    items = spark.createDataFrame(
        [("i1", False, False), ("i2", True, False)],
        "item_id string, has_associated_image boolean, has_option_image boolean",
    )
    got = {r.image_subtype: r["items"] for r in describe.subtype_counts(items).collect()}
    assert got == {
        "Text-only": 1,
        "Question diagram only": 1,
        "Image answers only": 0,
        "Question diagram and image answers": 0,
    }
