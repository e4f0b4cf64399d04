"""Preference formatting: a common prompt and two masked completions, in column expressions.

The longest common prefix of the turns of a chosen and a rejected conversation is rendered once
as the prompt. What follows in each is a completion; only its assistant turns are to be learned,
and their character spans say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.llm.common import once

#: Fixed strings of the chat format, by code point order of their use.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"
SALTS = 64


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` (role and text in order) from ``conv_id, turn, role, text`` rows.

    Turns are ordered by number, a missing one last, then role and text; a missing role is
    ``unknown``, a missing text empty; repeated rows are repeated turns. Rows without a
    conversation form one conversation. One conversation must fit in a row.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    number = F.coalesce(F.col("turn").cast("long"), F.lit(2**62))
    packed = F.sort_array(F.collect_list(F.struct(number.alias("turn"), role.alias("role"), text.alias("text"))))
    return turns.groupBy("conv_id").agg(
        F.transform(packed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def paired_by_opening(convs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``chosen_id, rejected_id``: conversations with the same first turn, two by two.

    They are paired in the order of their ids, the smaller id chosen: first within ``salts``
    parts of each opening, dealt by the id, then the parts' odd ones. So no opening meets in one
    task, however many conversations start with it. What remains has no partner:
    ``rejected_id`` is null. A missing id comes last.
    """
    # equal openings must be equal, so the turn itself is the key, not a hash of it
    ids = convs.select("conv_id", F.col("turns")[0].alias("opening"))
    salt = F.coalesce(F.pmod(F.col("conv_id"), F.lit(salts)), F.lit(0))

    def couples(rows: DataFrame, *keys: str) -> DataFrame:
        line = Window.partitionBy(*keys).orderBy(F.col("conv_id").asc_nulls_last())
        return (
            rows.withColumn("_place", F.row_number().over(line))
            .withColumn("_next", F.lead("conv_id").over(line))
            .where(F.col("_place") % 2 == 1)
            .drop("_place")
        )

    first = couples(ids.withColumn("salt", salt), "opening", "salt")
    second = couples(first.where(F.col("_next").isNull()).drop("_next"), "opening")
    chosen = [F.col("conv_id").alias("chosen_id"), F.col("_next").alias("rejected_id")]
    return first.where(F.col("_next").isNotNull()).select(*chosen).unionByName(second.select(*chosen))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _spans(turns: Column) -> Column:
    """Start and end (exclusive), in characters of the rendered turns, of what is learned.

    The closing marker belongs to it, so that a model learns to stop.
    """
    sizes = F.transform(turns, lambda t: F.length(_rendered(t)))
    ends = F.aggregate(
        sizes,
        F.array(F.lit(0)),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    return once(
        ends,
        lambda e: F.transform(
            F.filter(
                F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), i.alias("i"))), lambda x: x["role"] == LEARNED
            ),
            lambda x: F.struct(
                (F.get(e, x["i"]) + (len(OPEN) + len(LEARNED) + len(MIDDLE))).alias("start"), F.get(e, x["i"] + 1).alias("end")
            ),
        ),
    )


def formatted(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: ``chosen_id, rejected_id, n_prompt_turns, prompt`` and, for ``chosen`` and
    ``rejected``, the rendered completion and its learned spans (``*_spans``).

    The prompt is the longest common prefix of turns, equal in role and text, but never the last
    assistant turn of either: conversations of which one begins the other, or equal ones, keep a
    completion where they have an answer to learn. A missing partner has no turns, so the prompt
    is empty and its columns are null; ids not found in ``turns`` count as missing partners. Pairs
    whose ``chosen_id`` is missing or not found have no row.
    """
    convs = conversations(turns)
    one = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_a"))
    two = convs.select(F.col("conv_id").alias("_r"), F.col("turns").alias("_b"))
    # pairs without a partner have a key of their own, so that they do not meet in one task as nulls
    alone = F.concat(F.lit("none:"), F.col("chosen_id").cast("string"))
    both = (
        pairs.select("chosen_id", "rejected_id", F.coalesce(F.col("rejected_id").cast("string"), alone).alias("_key"))
        .join(one, "chosen_id")
        .join(two.withColumn("_key", F.col("_r").cast("string")), "_key", "left")
    )

    def open_until(t: Column) -> Column:
        """Turns before the last assistant turn; all if there is none."""
        last = F.array_max(F.transform(t, lambda x, i: F.when(x["role"] == LEARNED, i)))
        return F.coalesce(last, F.size(t))

    differing = F.array_position(F.zip_with("_a", "_b", lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1
    shorter = F.least(F.size("_a"), F.size("_b"))
    common = F.when(F.col("_b").isNull(), 0).otherwise(
        F.least(F.when(differing >= 0, differing).otherwise(shorter), open_until(F.col("_a")), open_until(F.col("_b")))
    )
    cut = both.withColumn("_n", common.cast("int"))

    def after(t: str) -> Column:
        return F.slice(F.col(t), F.col("_n") + 1, F.greatest(F.size(t), F.lit(0)))

    def text(t: Column) -> Column:
        return F.array_join(F.transform(t, _rendered), "")

    return cut.select(
        "chosen_id",
        "rejected_id",
        F.col("_n").alias("n_prompt_turns"),
        text(F.slice("_a", F.lit(1), F.col("_n"))).alias("prompt"),
        text(after("_a")).alias("chosen"),
        once(after("_a"), _spans).alias("chosen_spans"),
        text(after("_b")).alias("rejected"),
        F.when(F.col("_b").isNotNull(), once(after("_b"), _spans)).alias("rejected_spans"),
    )
