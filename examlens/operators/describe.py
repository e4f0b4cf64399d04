"""Grouped descriptive tables over scored item rows or their cells (``scoring.item_cells``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import Counted, count_if, share
from examlens.functions.scoring import LETTERS, wilson_bounds
from examlens.operators import checks
from examlens.operators.scoring import EXAM

# Category names of the published tables.
TEXT_ONLY = "Text-only"
VISUAL = "Auxiliary visual content"
ALL_ITEMS = "All items"
SUBTYPES = [
    "Text-only",
    "Question diagram only",
    "Image answers only",
    "Question diagram and image answers",
]


def image_flags(items: DataFrame, option_columns: list[str]) -> DataFrame:
    """Presence flags of the image columns; store the result, the bytes are wide."""
    any_option = F.lit(False)
    for name in option_columns:
        any_option = any_option | F.col(name).isNotNull()
    associated = F.coalesce(F.size("associated_images_bin") > 0, F.lit(False))
    return items.withColumns(
        {"has_associated_image": associated, "has_option_image": any_option}
    )


def image_subtype() -> Column:
    stem, option = F.col("has_associated_image"), F.col("has_option_image")
    return (
        F.when(stem & option, F.lit(SUBTYPES[3]))
        .when(stem, F.lit(SUBTYPES[1]))
        .when(option, F.lit(SUBTYPES[2]))
        .otherwise(F.lit(SUBTYPES[0]))
    )


def with_conditions(scored: DataFrame) -> DataFrame:
    """Image subtype, visual condition and the no-valid-selection flag."""
    return scored.withColumn("image_subtype", image_subtype()).withColumns(
        {
            "visual_condition": F.when(
                F.col("image_subtype") == TEXT_ONLY, F.lit(TEXT_ONLY)
            ).otherwise(F.lit(VISUAL)),
            "no_valid_selection": ~F.col("valid_selection") & ~F.col("declined"),
        }
    )


def accuracy_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Items, accuracy and abstention rate per group."""
    items = Counted(scored)
    return items.frame.groupBy(*keys).agg(
        items.rows().alias("items"),
        items.share(F.col("answered_correctly")).alias("accuracy"),
        items.share(F.col("declined")).alias("abstention_rate"),
    )


def response_status(conditioned: DataFrame) -> DataFrame:
    items = Counted(conditioned)
    return items.frame.groupBy("model", "visual_condition").agg(
        items.rows().alias("items"),
        items.count_if(F.col("answered_correctly")).alias("correct"),
        items.share(F.col("answered_correctly")).alias("accuracy"),
        items.count_if(F.col("valid_selection")).alias("valid_selections"),
        items.count_if(F.col("declined")).alias("abstentions"),
        items.share(F.col("declined")).alias("abstention_rate"),
        items.count_if(F.col("no_valid_selection")).alias("no_valid_selections"),
        items.share(F.col("no_valid_selection")).alias("no_valid_selection_rate"),
    )


def subtype_results(conditioned: DataFrame) -> DataFrame:
    """Accuracy by image subtype with its Wilson interval and attempted accuracy."""
    items = Counted(conditioned)
    correct = F.col("answered_correctly")
    grouped = items.frame.groupBy("model", "image_subtype").agg(
        items.rows().alias("items"),
        items.count_if(correct).alias("_correct"),
        items.share(F.col("declined")).alias("decline_rate"),
        items.share_where(correct, F.col("attempted")).alias("attempted_accuracy"),
    )
    low, high = wilson_bounds(F.col("_correct").cast("double"), F.col("items"))
    return grouped.select(
        "model",
        "image_subtype",
        "items",
        (F.col("_correct") / F.col("items")).alias("accuracy"),
        low.alias("accuracy_ci_low"),
        high.alias("accuracy_ci_high"),
        "decline_rate",
        "attempted_accuracy",
    )


def subtype_counts(items: DataFrame) -> DataFrame:
    """Items per image subtype, with zero rows for categories that do not occur.

    One global aggregate with a counter per category, unpivoted afterwards: the category
    list is literal, so no join against a category table is needed.
    """
    counters = items.withColumn("image_subtype", image_subtype()).agg(
        *[
            count_if(F.col("image_subtype") == name).alias(f"_{i}")
            for i, name in enumerate(SUBTYPES)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("image_subtype"), F.col(f"_{i}").alias("items"))
            for i, name in enumerate(SUBTYPES)
        ]
    )
    return counters.select(F.inline(pairs))


def option_positions(scored: DataFrame) -> DataFrame:
    """Per model and letter: how often it is the key, how often it is chosen, accuracy.

    ``attempted`` here means a prediction among A-E. All letters come from one aggregate
    per model and are unpivoted, so letters that never occur still get a row.
    """
    items = Counted(scored)
    aggregates = [
        items.rows().alias("_rows"),
        items.count_if(F.col("valid_selection")).alias("_valid"),
    ]
    for letter in LETTERS:
        gold = F.col("answer") == letter
        aggregates += [
            items.count_if(gold).alias(f"_gold_{letter}"),
            items.count_if(F.col("predicted_normalized") == letter).alias(f"_pred_{letter}"),
            items.share_where(F.col("answered_correctly"), gold).alias(f"_acc_{letter}"),
            items.share_where(F.col("declined"), gold).alias(f"_dec_{letter}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(letter).alias("option"),
                F.col(f"_gold_{letter}").alias("gold_count"),
                (F.col(f"_gold_{letter}") / F.col("_rows")).alias("gold_share"),
                F.col(f"_pred_{letter}").alias("predicted_count"),
                F.try_divide(F.col(f"_pred_{letter}"), F.col("_valid")).alias(
                    "predicted_share_among_attempts"
                ),
                F.col(f"_acc_{letter}").alias("accuracy_when_gold"),
                F.col(f"_dec_{letter}").alias("decline_rate_when_gold"),
            )
            for letter in LETTERS
        ]
    )
    return items.frame.groupBy("model").agg(*aggregates).select("model", F.inline(rows))


def evaluated_items(items: DataFrame, scored: DataFrame) -> DataFrame:
    """Items that were evaluated at least once.

    A scored item without an item row, or one whose image flags are not known, stops the run; the
    check is part of the join.
    """
    ids = scored.select("item_id").distinct()
    joined = ids.join(items.withColumn("_known", F.lit(True)), "item_id", "left")
    found = checks.present(joined, F.col("_known"), "scored item without item row")
    flags = [c for c in ("has_associated_image", "has_option_image") if c in items.columns]
    for flag in flags:
        found = checks.present(found, F.col(flag), "image metadata does not cover every scored item")
    return found.select(*items.columns)


def exam_composition(items: DataFrame) -> DataFrame:
    """Shares of item kinds per form over distinct items."""
    associated, option = F.col("has_associated_image"), F.col("has_option_image")
    return items.groupBy(*EXAM).agg(
        F.count(F.lit(1)).cast("bigint").alias("item_count"),
        share(F.col("multimodal")).alias("multimodal_share"),
        share(associated | option).alias("auxiliary_visual_share"),
        share(associated).alias("associated_image_share"),
        share(option).alias("option_image_share"),
        share(F.col("points") == 3).alias("three_point_share"),
        share(F.col("points") == 5).alias("five_point_share"),
    )


def with_decades(exam_data: DataFrame) -> DataFrame:
    """Year in decades around the mean year of the frame's exams (``year_per_decade``)."""
    mean_year = exam_data.agg(F.avg("year")).scalar()
    return exam_data.withColumn("year_per_decade", (F.col("year") - mean_year) / 10)


def yearly_composition(composition: DataFrame) -> DataFrame:
    """Shares of item kinds per year, rolled up from the composition of its forms."""
    total = F.sum("item_count")

    def mean(name: str) -> Column:
        return F.sum(F.col(name) * F.col("item_count")) / total

    return composition.groupBy("year").agg(
        total.cast("bigint").alias("items"),
        mean("auxiliary_visual_share").alias("auxiliary_visual_share"),
        mean("associated_image_share").alias("question_diagram_share"),
        mean("option_image_share").alias("option_image_share"),
    )


def slice_scores(scored: DataFrame) -> DataFrame:
    """Ensemble accuracy per exam on all, text-only and visual items.

    The two modality groups are aggregated once; the all-items slice is their sum, so the
    item rows are read and shuffled a single time.
    """
    items = Counted(scored)
    cells = items.frame.groupBy("model", *EXAM, "multimodal").agg(
        items.rows().alias("n"),
        items.count_if(F.col("answered_correctly")).alias("correct"),
        items.count_if(F.col("declined")).alias("declined"),
    )
    name = F.when(F.col("multimodal"), F.lit(VISUAL)).otherwise(F.lit(TEXT_ONLY))
    per_model = (
        cells.withColumn("slice", F.explode(F.array(F.lit(ALL_ITEMS), name)))
        .groupBy("slice", "model", *EXAM)
        .agg(F.sum("n").alias("n"), F.sum("correct").alias("c"), F.sum("declined").alias("d"))
    )
    return per_model.groupBy("slice", *EXAM).agg(
        F.avg(F.col("c") / F.col("n")).alias("ensemble_accuracy"),
        F.avg(F.col("d") / F.col("n")).alias("ensemble_decline_rate"),
        F.min(F.struct("model", "n"))["n"].cast("bigint").alias("items_per_model"),
        F.count_distinct("model").cast("bigint").alias("model_count"),
    )


def dataset_profile(items: DataFrame) -> DataFrame:
    """Rows, multimodal rows and mean points per year."""
    return items.groupBy("year").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        count_if(F.col("multimodal")).alias("multimodal_rows"),
        F.avg("points").alias("mean_points"),
    )
