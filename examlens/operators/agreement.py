"""Paired comparisons and agreement of two runs on the same items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import CELL_ITEMS, Counted
from examlens.functions.stats import pearson
from examlens.operators import checks
from examlens.operators.bootstrap import REPETITIONS, interval, item_draws
from examlens.operators.panel import demeaned
from examlens.operators.scoring import EXAM

OUTCOME = [
    "answered_correctly",
    "declined",
    "predicted_normalized",
    "awarded_points",
]


def _renamed(scored: DataFrame, suffix: str, keys: list[str], extra: list[str]) -> DataFrame:
    return scored.select(
        *keys, *[F.col(c).alias(f"{c}_{suffix}") for c in OUTCOME], *extra
    )


def paired(
    first: DataFrame,
    second: DataFrame,
    keys: list[str] | None = None,
    facts: list[str] | None = None,
) -> DataFrame:
    """Rows of both runs side by side, matched on ids and never by position.

    Both sides are item tables, so this is the one large-large join: a shuffle on
    (model, item). Skewed models stay spread, because the item id is part of the key. Every row
    of ``second`` must have its counterpart in ``first``; what only ``first`` has is left out.
    """
    keys = keys or ["model", "item_id"]
    facts = ["multimodal"] if facts is None else facts
    joined = _renamed(second, "second", keys, []).join(
        _renamed(first, "first", keys, [*facts, F.lit(True).alias("_paired")]), keys, "left"
    )
    return checks.present(joined, F.col("_paired"), "row without a counterpart in the first run").drop("_paired")


def _with_changes(pairs: DataFrame) -> DataFrame:
    """Whether letter and points of both runs agree, unless the rows already say so."""
    if "same_letter" in pairs.columns:
        return pairs
    return pairs.withColumns(
        {
            "same_letter": F.col("predicted_normalized_first") == F.col("predicted_normalized_second"),
            "changed_points": F.col("awarded_points_first") != F.col("awarded_points_second"),
        }
    )


def pair_cells(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Paired rows counted per combination of everything the pair tables look at.

    A few rows per group, combined map side: several tables then start from one join of two
    item tables.
    """
    flags = [f"{name}_{side}" for name in ("answered_correctly", "declined") for side in ("first", "second")]
    return (
        _with_changes(pairs)
        .groupBy(*by, *flags, "same_letter", "changed_points", "multimodal")
        .agg(F.count(F.lit(1)).alias(CELL_ITEMS))
    )


def difference_interval(
    pairs: DataFrame, by: list[str], seed: int, repetitions: int = REPETITIONS
) -> DataFrame:
    """Accuracy difference in points (second minus first) with an item-bootstrap interval.

    A paired difference is -1, 0 or 1, so items are resampled on their three-cell table.
    ``pairs`` are paired rows or their cells.
    """
    difference = F.col("answered_correctly_second").cast("int") - F.col(
        "answered_correctly_first"
    ).cast("int")
    items = Counted(pairs)
    cells = items.frame.groupBy(*by, difference.alias("difference")).agg(items.rows().alias("_n"))
    drawn = item_draws(cells, "_n", seed, repetitions, by)
    means = drawn.groupBy(*by, "rep").agg(
        (100 * F.sum(F.col("weight") * F.col("difference")) / F.sum("weight")).alias("difference_pp")
    )
    return interval(means, by, ["difference_pp"], repetitions)


def paired_comparison(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Accuracies, difference, lost and gained items, decline rates, of rows or cells."""
    items = Counted(pairs)
    first, second = F.col("answered_correctly_first"), F.col("answered_correctly_second")
    return items.frame.groupBy(*by).agg(
        items.rows().alias("items"),
        items.share(first).alias("accuracy_reference"),
        items.share(second).alias("accuracy_treated"),
        (100 * (items.share(second) - items.share(first))).alias("difference_pp"),
        items.count_if(first & ~second).alias("lost"),
        items.count_if(~first & second).alias("gained"),
        items.share(F.col("declined_first")).alias("decline_rate_reference"),
        items.share(F.col("declined_second")).alias("decline_rate_treated"),
    )


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Same outcome, Cohen's kappa, same letter and the items whose result changed.

    Wrong and declined answers score differently, so points can change where correctness
    does not. ``pairs`` are paired rows or their cells.
    """
    items = Counted(_with_changes(pairs))
    first, second = F.col("answered_correctly_first"), F.col("answered_correctly_second")
    changed = first != second
    grouped = items.frame.groupBy(*by).agg(
        items.rows().alias("items"),
        items.share(first).alias("accuracy_first"),
        items.share(second).alias("accuracy_second"),
        (100 * (items.share(second) - items.share(first))).alias("difference_pp"),
        items.share(first == second).alias("same_outcome"),
        items.share(F.col("same_letter")).alias("same_letter"),
        items.count_if(F.col("changed_points")).alias("changed_points"),
        items.count_if(changed & ~F.col("multimodal")).alias("changed_text_only"),
        items.count_if(changed & F.col("multimodal")).alias("changed_multimodal"),
        items.count_if(F.col("multimodal")).alias("multimodal_items"),
    )
    return grouped.withColumn("kappa", kappa("same_outcome", "accuracy_first", "accuracy_second"))


def kappa(observed: str, first: str, second: str) -> Column:
    """Chance-corrected agreement of two binary ratings."""
    p, q = F.col(first), F.col(second)
    chance = p * q + (1 - p) * (1 - q)
    return F.try_divide(F.col(observed) - chance, 1 - chance)


def run_pairs(
    scored: DataFrame, runs: list[str], pairs: list[tuple[str, str]], facts: list[str]
) -> DataFrame:
    """All listed pairs of runs on the items that every run answered.

    One aggregate per item puts the runs side by side (a single shuffle on the item id) and
    the pairs are unfolded from it, instead of one join per pair.
    """
    struct = F.struct(*OUTCOME)
    side_by_side = (
        scored.filter(F.col("model").isin(runs))
        .groupBy("item_id")
        .agg(
            *[F.max(F.when(F.col("model") == run, struct)).alias(f"r{i}") for i, run in enumerate(runs)],
            *[F.max(name).alias(name) for name in facts],
        )
    )
    complete = F.lit(True)
    for i in range(len(runs)):
        complete = complete & F.col(f"r{i}").isNotNull()
    index = {run: i for i, run in enumerate(runs)}
    options = F.array(
        *[
            F.struct(
                F.lit(first).alias("first"),
                F.lit(second).alias("second"),
                *[F.col(f"r{index[first]}.{c}").alias(f"{c}_first") for c in OUTCOME],
                *[F.col(f"r{index[second]}.{c}").alias(f"{c}_second") for c in OUTCOME],
            )
            for first, second in pairs
        ]
    )
    return side_by_side.filter(complete).select("item_id", *facts, F.inline(options))


def subset_memberships() -> Column:
    """Names of the item subsets a row belongs to; needs the option-order mapping columns."""
    reordered = F.col("kept_order_reason") == ""
    moved = F.col("old_answer") != F.col("new_answer")
    listed = F.array(
        F.lit("All items"),
        F.when(reordered, F.lit("Reordered")),
        F.when(reordered & moved, F.lit("Reordered, key moved")),
        F.when(reordered & ~F.col("multimodal"), F.lit("Reordered, text-only")),
        F.when(reordered & F.col("multimodal"), F.lit("Reordered, multimodal")),
        F.when(~reordered, F.lit("Order kept")),
    )
    return F.filter(listed, lambda name: name.isNotNull())


def subset_agreement(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Agreement of every run pair on the item subsets of the option-order mapping."""
    placed = pairs.join(
        mapping.select("item_id", "kept_order_reason", "old_answer", "new_answer"), "item_id"
    )
    unfolded = placed.withColumn("subset", F.explode(subset_memberships()))
    return agreement(unfolded, ["subset", "first", "second"])


def exam_score_agreement(panel: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlation and mean absolute change of exam scores for pairs of series."""
    names = sorted({name for pair in pairs for name in pair})
    per_exam = panel.filter(F.col("series").isin(names)).groupBy(*EXAM).agg(
        *[
            F.max(F.when(F.col("series") == name, F.col("model_pct"))).alias(f"v{i}")
            for i, name in enumerate(names)
        ]
    )
    index = {name: i for i, name in enumerate(names)}
    rows = per_exam.select(
        *EXAM,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(first).alias("first"),
                        F.lit(second).alias("second"),
                        F.col(f"v{index[first]}").alias("x"),
                        F.col(f"v{index[second]}").alias("y"),
                    )
                    for first, second in pairs
                ]
            )
        ),
    )
    keys = ["first", "second"]
    within = rows.withColumns(
        {"xw": demeaned("x", [*keys, "exam"]), "yw": demeaned("y", [*keys, "exam"])}
    )
    return within.groupBy(*keys).agg(
        pearson(F.col("x"), F.col("y")).alias("exam_score_r"),
        pearson(F.col("xw"), F.col("yw")).alias("exam_score_r_within_grade"),
        F.avg(F.abs(F.col("y") - F.col("x"))).alias("mean_abs_exam_score_change"),
    )
