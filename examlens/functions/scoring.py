"""Scalar scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examlens.functions.common import col, normalized_letter, strip

# Fixed values of the contest rules.
DECLINED = "DECLINED"
PENALTY = 0.25
LETTERS = "ABCDE"
START_POINTS_GRADES_3_TO_6 = 24.0
START_POINTS_GRADES_7_TO_13 = 30.0
Z_95 = 1.959963984540054


def coerce_points(value: Column | str) -> Column:
    """Text or number as a finite double, else 0."""
    number = strip(col(value).cast("string")).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, number).otherwise(F.lit(0.0))


def grade_numbers(group: Column | str) -> Column:
    """Every run of digits in a free-text group label, as integers."""
    digits = F.regexp_extract_all(col(group).cast("string"), F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(
        F.transform(digits, lambda item: item.try_cast("int")),
        F.array().cast("array<int>"),
    )


def legacy_start_points(group: Column | str) -> Column:
    """Former start capital, decided by the smallest grade of the group."""
    smallest = F.array_min(grade_numbers(group))
    return (
        F.when(smallest.between(7, 13), F.lit(START_POINTS_GRADES_7_TO_13))
        .when(smallest.between(3, 6), F.lit(START_POINTS_GRADES_3_TO_6))
        .otherwise(F.lit(0.0))
    )


def is_declined(predicted: Column | str) -> Column:
    return F.coalesce(normalized_letter(predicted) == DECLINED, F.lit(False))


def valid_key(answer: Column | str) -> Column:
    """The key letter when it is one of A-E after trimming, else null."""
    letter = normalized_letter(col(answer).cast("string"))
    return F.when(letter.isin(*LETTERS), letter)


def score_question(
    points: Column | str,
    answer: Column | str,
    predicted: Column | str,
    penalize_unanswered: bool = True,
) -> Column:
    """``struct(points_earned, is_correct)`` of one question.

    ``is_correct`` is null when there is no key or nothing to earn. ``answer`` must already
    be a normalised key (see :func:`valid_key`).
    """
    value = coerce_points(points)
    answer, predicted = col(answer), col(predicted)
    penalty = -value * F.lit(PENALTY)
    unanswered = penalty if penalize_unanswered else F.lit(0.0)
    unscored = answer.isNull() | (value <= 0)
    correct = normalized_letter(predicted) == answer
    earned = (
        F.when(unscored, F.lit(0.0))
        .when(predicted.isNull(), unanswered)
        .when(is_declined(predicted), F.lit(0.0))
        .when(correct, value)
        .otherwise(penalty)
    )
    verdict = (
        F.when(unscored, F.lit(None).cast("boolean"))
        .when(predicted.isNull() | is_declined(predicted), F.lit(False))
        .otherwise(correct)
    )
    return F.struct(earned.alias("points_earned"), verdict.alias("is_correct"))


def wilson_bounds(successes: Column, trials: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval of a proportion."""
    z = F.lit(Z_95)
    p = successes / trials
    shrink = 1 + z * z / trials
    middle = (p + z * z / (2 * trials)) / shrink
    spread = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / shrink
    return middle - spread, middle + spread
