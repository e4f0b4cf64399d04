"""From raw attempts to scored item rows and exam scores.

Canonical columns

* items: ``item_id, year, exam, points, answer, multimodal`` (+ image flags)
* attempts: ``model, item_id, predicted``
* scored rows: attempts joined to their item, see :func:`score_attempts`
* exam scores: one row per ``model, year, exam``, see :func:`exam_scores`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.common import CELL_ITEMS, Counted, count_if, normalized_letter
from examlens.functions.scoring import DECLINED, LETTERS, PENALTY
from examlens.operators import checks

EXAM = ["year", "exam"]


def score_attempts(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """Attempts scored against the answer key with the contest rule.

    A missing prediction counts as attempted and costs a quarter of the points; only the
    literal ``DECLINED`` is free. The join is many-to-one on ``item_id``: a key table that
    names an item twice, or an attempt without an item, is an error. Which side is broadcast is
    left to the optimizer, since the key table grows with the data.
    """
    unique = checks.require(checks.unique_key_check(items, "one key row per item", ["item_id"]), items)
    joined = checks.present(
        attempts.join(unique.withColumn("_keyed", F.lit(True)), "item_id", "left"),
        F.col("_keyed"),
        "attempt without a key row",
    ).drop("_keyed")
    predicted = normalized_letter(F.coalesce(F.col("predicted"), F.lit("")))
    scored = (
        joined.withColumn("answer", normalized_letter("answer"))
        .withColumn("predicted_normalized", predicted)
        .withColumn("question_points", F.col("points").cast("double"))
    )
    declined = F.col("predicted_normalized") == DECLINED
    correct = F.coalesce(
        F.col("predicted_normalized") == F.col("answer"), F.lit(False)
    )
    scored = scored.withColumns({"declined": declined, "answered_correctly": correct})
    return scored.withColumns(
        {
            "attempted": ~F.col("declined"),
            "awarded_points": F.when(F.col("answered_correctly"), F.col("question_points"))
            .when(F.col("declined"), F.lit(0.0))
            .otherwise(-PENALTY * F.col("question_points")),
            "valid_selection": F.col("predicted_normalized").isin(*LETTERS),
        }
    )


def run_outcomes(scored: DataFrame, model: str) -> DataFrame:
    """Correct and declined flags of one run per item, for comparisons of runs."""
    return scored.filter(F.col("model") == model).select(
        "item_id", F.col("answered_correctly").alias("correct"), "declined"
    )


OTHER = "OTHER"
CELL_KEYS = [
    "model",
    *EXAM,
    "question_points",
    "answer",
    "predicted_normalized",
    "answered_correctly",
    "declined",
    "attempted",
    "valid_selection",
    "awarded_points",
    "multimodal",
    "has_associated_image",
    "has_option_image",
]


def item_cells(scored: DataFrame) -> DataFrame:
    """Scored rows counted per combination of everything the item tables look at.

    One scan of the item rows, combined map side, leaves a table whose size depends on the
    number of models, forms and letters only. Exam scores, slices, descriptive tables and
    exposure checks all accept it in place of the item rows. Unreadable choices and keys are
    one value, so free text does not multiply the cells.
    """

    def letter(name: str) -> Column:
        known = F.col(name).isin(*LETTERS) | (F.col(name) == DECLINED)
        return F.when(known, F.col(name)).otherwise(F.lit(OTHER))

    choices = {name: letter(name) for name in ("answer", "predicted_normalized")}
    return (
        scored.withColumns(choices)
        .groupBy(*CELL_KEYS)
        .agg(F.count(F.lit(1)).alias(CELL_ITEMS))
    )


def exam_scores(scored: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Contest score per model and form.

    One starting point per evaluated item, plus the fixed credit of adjusted forms in both
    the score and the maximum. ``adjustments`` is a literal-size table keyed on (year, exam).
    """
    items = Counted(scored)
    grouped = items.frame.groupBy("model", *EXAM).agg(
        items.rows().alias("questions"),
        items.count_if(F.col("answered_correctly")).alias("correct"),
        items.count_if(F.col("attempted")).alias("attempted"),
        items.count_if(F.col("declined")).alias("declined"),
        items.count_if(~F.col("valid_selection") & ~F.col("declined")).alias(
            "no_valid_selections"
        ),
        items.share(F.col("multimodal")).alias("multimodal_share"),
        items.total("awarded_points").alias("_awarded"),
        items.total("question_points").alias("_points"),
    )
    if adjustments is None:
        grouped = grouped.withColumns(
            {
                "_official": F.lit(None).cast("bigint"),
                "_bonus": F.lit(None).cast("double"),
                "_maximum": F.lit(None).cast("double"),
            }
        )
    else:
        grouped = grouped.join(
            adjustments.select(
                *EXAM,
                F.col("official_items").cast("bigint").alias("_official"),
                F.col("fixed_bonus").cast("double").alias("_bonus"),
                F.col("official_max").cast("double").alias("_maximum"),
            ),
            EXAM,
            "left",
        )
    official = F.coalesce("_official", "questions")
    bonus = F.coalesce("_bonus", F.lit(0.0))
    possible = F.col("questions") + F.col("_points") + bonus
    total = F.col("questions") + F.col("_awarded") + bonus
    expected = F.coalesce("_maximum", 5.0 * official)
    return grouped.select(
        "model",
        *EXAM,
        "questions",
        official.alias("official_questions"),
        bonus.alias("fixed_bonus"),
        "correct",
        "attempted",
        "declined",
        "no_valid_selections",
        "multimodal_share",
        total.alias("total_score"),
        possible.alias("possible_points"),
        (100 * total / possible).alias("model_pct"),
        is_close(possible, expected).alias("complete_exam"),
    )


def is_close(value: Column, target: Column) -> Column:
    """Equality up to the usual float tolerances (relative 1e-5, absolute 1e-8)."""
    return F.abs(value - target) <= 1e-8 + 1e-5 * F.abs(target)


def with_winners(scores: DataFrame) -> DataFrame:
    """Adds ``won``: the best complete score of its exam, ties to the first model by name.

    The window holds one exam's models, a handful of already aggregated rows. Scores are
    compared to nine digits, because the last bits of a distributed sum depend on its order.
    """
    ranking = Window.partitionBy(*EXAM).orderBy(
        F.desc("complete_exam"), F.round("model_pct", 9).desc(), "model"
    )
    won = F.col("complete_exam") & (F.row_number().over(ranking) == 1)
    return scores.withColumn("won", won)


def exam_winners(scores: DataFrame) -> DataFrame:
    """Number of complete exams each winning model wins."""
    return (
        with_winners(scores)
        .filter("won")
        .groupBy("model")
        .agg(F.count(F.lit(1)).cast("bigint").alias("exams_won"))
    )


def contest_totals(scores: DataFrame) -> DataFrame:
    """Forms, reachable points and points per model over complete exams."""
    return (
        scores.filter("complete_exam")
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("forms"),
            F.sum("possible_points").alias("possible_points"),
            F.sum("total_score").alias("contest_points"),
        )
    )


def league_table(scores: DataFrame) -> DataFrame:
    """One row per model: accuracy, abstentions, contest points and exams won.

    Everything is rolled up from the exam scores in one chain: the item rows are scanned and
    shuffled once, already reduced to one row per model and form on the map side.
    """
    items, complete = F.sum("questions"), F.col("complete_exam")
    return with_winners(scores).groupBy("model").agg(
        items.cast("bigint").alias("items"),
        F.sum("correct").cast("bigint").alias("correct"),
        (F.sum("correct") / items).alias("accuracy"),
        F.sum("declined").cast("bigint").alias("abstentions"),
        (F.sum("declined") / items).alias("decline_rate"),
        F.sum("no_valid_selections").cast("bigint").alias("no_valid_selections"),
        F.sum(F.when(complete, F.col("total_score"))).alias("contest_points"),
        count_if(F.col("won")).alias("exams_won"),
    )


def form_coverage(
    scores: DataFrame, adjustments: DataFrame, human: DataFrame
) -> DataFrame:
    """Forms on which adjustments, evaluated rows and human maxima disagree.

    One row per (year, exam) with the counts side by side and the two verdicts.
    """
    counts = scores.groupBy(*EXAM).agg(
        F.min("questions").alias("questions"),
        F.min("official_questions").alias("official_questions"),
        F.min("possible_points").alias("possible_points"),
    )
    adjusted = adjustments.select(
        *EXAM, F.col("evaluated_items").cast("bigint").alias("evaluated_items")
    )
    official = human.select(*EXAM, (F.col("human_max") / 5).alias("human_items"))
    joined = counts.join(adjusted, EXAM, "left").join(official, EXAM, "left")
    return joined.withColumns(
        {
            "adjustment_agrees": F.coalesce(
                F.col("evaluated_items") == F.col("questions"), F.lit(True)
            ),
            "human_agrees": F.coalesce(
                F.col("official_questions") == F.col("human_items"), F.lit(False)
            ),
        }
    )
