"""Option order: which items may be reordered, the seeded permutation, and its undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import count_if, hash32, normalized_letter, share_where, strip
from examlens.functions.scoring import LETTERS
from examlens.operators import checks

# Wording that ties an option to its letter, and the seed of the arm.
LETTER_REFERENCE = (
    r"(?U)\(\s*[A-E]\s*\)|\b[A-E]\)"
    r"|\b(?:Antwort|Antworten|Option|Aussage|Aussagen|Angabe|Angaben|Bild|Figur|Möglichkeit)"
    r"\s+\(?[A-E]\b"
    r"|\b[A-E]\s*(?:,|und|oder|bis)\s+[A-E]\b"
    r"|\b(?:obige[nr]?|vorherige[nr]?|vorstehende[nr]?|vorangehende[nr]?|vorangegangene[nr]?)\b"
)
LETTER_ONLY = r"\A[\(\[]?[A-Ea-e][\)\]]?\.?\z"
SEED = 20261113


def _texts() -> Column:
    return F.array(*[F.coalesce(F.col(f"sol_{x}"), F.lit("")) for x in LETTERS])


def order_reason(option_images: Column) -> Column:
    """Why an item's options keep their order; '' when they may be permuted."""
    only_letters = F.exists(_texts(), lambda text: strip(text).rlike(LETTER_ONLY))
    refers = F.exists(_texts(), lambda text: text.rlike(LETTER_REFERENCE)) | F.coalesce(
        F.col("problem_statement"), F.lit("")
    ).rlike(LETTER_REFERENCE)
    return (
        F.when(option_images, F.lit("option images"))
        .when(only_letters, F.lit("letter options"))
        .when(refers, F.lit("letter reference"))
        .otherwise(F.lit(""))
    )


def permutation(item: Column, reason: Column, seed: int = SEED) -> Column:
    """Old letters in their new order: sorted by a hash of (seed, item, letter)."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    shuffled = F.transform(
        F.array_sort(
            F.transform(
                letters,
                lambda x: F.struct(hash32(F.lit(seed), item, x).alias("h"), x.alias("letter")),
            )
        ),
        lambda entry: entry["letter"],
    )
    return F.when(reason == "", shuffled).otherwise(letters)


def letter_of(position: Column) -> Column:
    """Letter at a 1-based position; null outside A-E."""
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), position.cast("int") - 1)


def shuffle_options(items: DataFrame, seed: int = SEED) -> DataFrame:
    """Items with permuted options, moved key and their mapping columns.

    Needs ``item_id, answer, problem_statement, sol_A..sol_E`` and ``has_option_image``.
    """
    with_reason = items.withColumn("kept_order_reason", order_reason(F.col("has_option_image")))
    ordered = with_reason.withColumn(
        "_order", permutation(F.col("item_id"), F.col("kept_order_reason"), seed)
    )
    old = F.array(*[F.col(f"sol_{x}") for x in LETTERS])
    moved = ordered.withColumn(
        "_new",
        F.transform(F.col("_order"), lambda x: F.get(old, F.ascii(x) - 65)),
    ).withColumn("_order_answer", letter_of(F.array_position("_order", F.col("answer"))))
    return moved.select(
        *[c for c in items.columns if c != "answer" and not c.startswith("sol_")],
        *[F.get("_new", F.lit(i)).alias(f"sol_{x}") for i, x in enumerate(LETTERS)],
        F.col("_order_answer").alias("answer"),
        "kept_order_reason",
        F.col("answer").alias("old_answer"),
        F.col("_order_answer").alias("new_answer"),
        *[F.get("_order", F.lit(i)).alias(f"new_{x}_source") for i, x in enumerate(LETTERS)],
    )


def option_mapping(shuffled: DataFrame) -> DataFrame:
    return shuffled.select(
        "item_id",
        "kept_order_reason",
        "old_answer",
        "new_answer",
        *[f"new_{x}_source" for x in LETTERS],
    )


def shuffle_audit(mapping: DataFrame) -> DataFrame:
    """Counts per reason, moved keys and key positions before and after, as long rows."""
    reordered = F.col("kept_order_reason") == ""
    rows = F.array(
        F.struct(
            F.lit("order").alias("measure"),
            F.when(reordered, "shuffled").otherwise(F.col("kept_order_reason")).alias("value"),
        ),
        F.when(
            reordered & (F.col("old_answer") != F.col("new_answer")),
            F.struct(F.lit("key moved").alias("measure"), F.lit("yes").alias("value")),
        ),
        F.when(
            reordered,
            F.struct(F.lit("key after").alias("measure"), F.col("new_answer").alias("value")),
        ),
        F.when(
            reordered,
            F.struct(F.lit("key before").alias("measure"), F.col("old_answer").alias("value")),
        ),
    )
    return (
        mapping.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))
        .groupBy("measure", "value")
        .agg(F.count(F.lit(1)).cast("bigint").alias("items"))
    )


def unmap_positions(
    attempts: DataFrame, mapping: DataFrame, blank_is_first: bool = False
) -> DataFrame:
    """Chosen positions of the reordered arm mapped back to the original letters.

    Adds ``position``, the normalised choice as shown. A choice outside A-E (declined,
    unreadable) is kept. A missing choice stays missing; ``blank_is_first`` instead reads it
    as the first position. An attempt whose item has no mapping row is an error.
    """
    position = normalized_letter(F.coalesce(F.col("predicted"), F.lit("")))
    sources = F.array(*[F.col(f"new_{x}_source") for x in LETTERS])
    shown = F.when(
        F.col("position").isin(*LETTERS), F.ascii(F.col("position")) - 65
    )
    if blank_is_first:
        shown = F.when(F.col("position") == "", F.lit(0)).otherwise(shown)
    listed = mapping.select("item_id", *[f"new_{x}_source" for x in LETTERS], F.lit(True).alias("_mapped"))
    joined = checks.present(
        attempts.withColumn("position", position).join(listed, "item_id", "left"),
        F.col("_mapped"),
        "attempt without a mapping row",
    )
    original = F.when(shown.isNotNull(), F.get(sources, shown)).otherwise(F.col("predicted"))
    return joined.select("model", "item_id", original.alias("predicted"), "position")


def position_effects(arm: DataFrame, repeat: DataFrame, mapping: DataFrame) -> DataFrame:
    """Accuracy, key share and choice share per shown position on reordered items.

    ``repeat`` is the run with the printed order and gives accuracy by the original key.
    All letters are counted in one global aggregate and unpivoted.
    """
    reordered = mapping.filter(F.col("kept_order_reason") == "").select("item_id", "new_answer")
    rows = (
        arm.select("item_id", "position", "answered_correctly")
        .join(reordered, "item_id")
        .join(
            repeat.select(
                "item_id",
                F.col("answer").alias("printed_key"),
                F.col("answered_correctly").alias("printed_correct"),
            ),
            "item_id",
        )
    )
    wrong = ~F.col("answered_correctly") & F.col("position").isin(*LETTERS)
    aggregates = [
        F.count(F.lit(1)).alias("_rows"),
        count_if(wrong).alias("_wrong"),
    ]
    for x in LETTERS:
        key, chosen, printed = (
            F.col("new_answer") == x,
            F.col("position") == x,
            F.col("printed_key") == x,
        )
        aggregates += [
            count_if(key).alias(f"_key_{x}"),
            share_where(F.col("answered_correctly"), key).alias(f"_acc_{x}"),
            count_if(chosen).alias(f"_chosen_{x}"),
            count_if(wrong & chosen).alias(f"_wrong_{x}"),
            count_if(printed).alias(f"_printed_{x}"),
            share_where(F.col("printed_correct"), printed).alias(f"_pacc_{x}"),
        ]
    counted = rows.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(x).alias("position"),
            F.col(f"_key_{x}").alias("key_items"),
            F.col(f"_acc_{x}").alias("accuracy"),
            F.try_divide(F.col(f"_key_{x}"), F.col("_rows")).alias("key_share"),
            F.try_divide(F.col(f"_chosen_{x}"), F.col("_rows")).alias("chosen_share"),
            F.try_divide(F.col(f"_wrong_{x}"), F.col("_wrong")).alias("wrong_answer_share"),
            F.col(f"_printed_{x}").alias("printed_order_key_items"),
            F.col(f"_pacc_{x}").alias("printed_order_accuracy"),
        )
        for x in LETTERS
    ]
    return counted.select(F.inline(F.array(*entries)))
