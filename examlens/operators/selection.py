"""Which items a run evaluates: command-line style filters and their counters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import count_if


@dataclass(frozen=True)
class Selection:
    """Filters on items. Ranges are inclusive and written ``"low-high"``."""

    years: list[int] = field(default_factory=list)
    exams: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    year_range: str | None = None
    points_range: str | None = None
    vision_only: bool = False
    text_only: bool = False
    model_sees_images: bool = True
    limit: int | None = None
    seed: int | None = None
    limit_first: bool = False

    def __post_init__(self) -> None:
        if self.vision_only and self.text_only:
            raise ValueError("vision_only and text_only exclude each other")


def parse_range(text: str, kind: type) -> tuple:
    """Bounds of ``"low-high"``; anything else is an error."""
    parts = re.split("-", text)
    try:
        low, high = (kind(part.strip()) for part in parts)
    except ValueError:
        raise ValueError(f"expected a range 'low-high', got {text!r}") from None
    return low, high


def _conditions(chosen: Selection) -> list[Column]:
    conditions = []
    if chosen.years:
        conditions.append(F.col("year").isin(chosen.years))
    if chosen.exams:
        conditions.append(F.col("exam").isin(chosen.exams))
    if chosen.languages:
        conditions.append(F.col("language").isin(chosen.languages))
    if chosen.year_range:
        conditions.append(F.col("year").between(*parse_range(chosen.year_range, int)))
    if chosen.points_range:
        conditions.append(F.col("points").between(*parse_range(chosen.points_range, float)))
    if chosen.vision_only:
        conditions.append(F.col("multimodal"))
    return conditions


def _limited(items: DataFrame, chosen: Selection) -> DataFrame:
    """The first n items by id, or n items in a seeded random order (a sampling operator)."""
    if chosen.limit is None:
        return items
    if chosen.seed is None:
        return items.orderBy("item_id").limit(chosen.limit)
    key = F.md5(F.concat_ws(":", F.lit(str(chosen.seed)), F.col("item_id").cast("string")))
    return items.orderBy(key, "item_id").limit(chosen.limit)


def filtered(items: DataFrame, chosen: Selection) -> DataFrame:
    for condition in _conditions(chosen):
        items = items.filter(condition)
    return items


def select_items(items: DataFrame, chosen: Selection) -> DataFrame:
    """Items to evaluate. Filters come before the limit unless ``limit_first`` is set."""
    if chosen.limit_first:
        items = _limited(items, chosen)
    items = filtered(items, chosen)
    if chosen.text_only or not chosen.model_sees_images:
        items = items.filter(~F.col("multimodal"))
    return items if chosen.limit_first else _limited(items, chosen)


def selection_counts(items: DataFrame, chosen: Selection) -> DataFrame:
    """Rows loaded, dropped by the caller's or the model's modality, and kept."""
    visual = F.col("multimodal")
    by_caller = F.lit(chosen.text_only) & visual
    by_model = F.lit(not chosen.text_only and not chosen.model_sees_images) & visual
    return filtered(items, chosen).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows_loaded"),
        count_if(by_caller).alias("cli_filtered_out_rows"),
        count_if(by_model).alias("model_filtered_out_rows"),
        count_if(~by_caller & ~by_model).alias("rows_after_filter"),
    )


def image_gate(items: DataFrame, sees_images: bool, images: list[str], no_images: bool = False) -> DataFrame:
    """Label each item ``skipped`` when it has any image the model could not be shown."""
    has_any = F.lit(False)
    if not no_images:
        for name in images:
            has_any = has_any | F.coalesce(F.col(name), F.lit(False))
    skipped = has_any & F.lit(not sees_images)
    return items.withColumn("status", F.when(skipped, "skipped").otherwise("evaluated"))
