"""Moment tables: the sums from which every regression and correlation is computed.

``cell_moments`` reads the data once and leaves one row per (group, absorbed factor, cluster).
``weighted_moments`` combines those rows under bootstrap weights. Nothing after the first
step depends on the number of data rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.linalg import Gram, least_squares, residual_moment


def _pair(first: str, second: str) -> str:
    return "__".join(sorted((first, second)))


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(sorted(columns), 2))


def cell_moments(
    frame: DataFrame, columns: list[str], keys: list[str], weight: str | None = None
) -> DataFrame:
    """Count, sums and sums of products of the columns per key combination."""
    w = F.col(weight) if weight else F.lit(1.0)

    def total(value: Column) -> Column:
        return F.sum(w * value if weight else value)

    return frame.groupBy(*keys).agg(
        (F.sum(w)).alias("n"),
        *[total(F.col(name).cast("double")).alias(f"s_{name}") for name in columns],
        *[
            total(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"q_{_pair(a, b)}")
            for a, b in pairs(columns)
        ],
    )


def centred_cells(frame: DataFrame, columns: list[str], keys: list[str], by: list[str]) -> DataFrame:
    """The same table as ``cell_moments`` for columns less their mean over each ``by`` group.

    Sums of squares of large values lose the digits in which the values differ. Here a cell's
    mean and co-moments come from running updates that never form such sums, and the cells,
    few rows, are moved to the group's mean. A column that is constant moves to exactly zero.
    Slopes, correlations and r² do not depend on the shift; ``s_*`` are sums of deviations.
    """

    def mean(name: str, value: Column) -> Column:
        x = F.col(name).cast("double")
        return F.when(F.min(x) == F.max(x), F.min(x)).otherwise(value)

    def double(name: str) -> Column:
        return F.col(name).cast("double")

    cells = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[mean(c, F.avg(double(c))).alias(f"m_{c}") for c in columns],
        *[F.covar_pop(double(a), double(b)).alias(f"c_{_pair(a, b)}") for a, b in pairs(columns)],
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))

    def shift(name: str) -> Column:
        m = F.col(f"m_{name}")
        constant = F.min(m).over(group) == F.max(m).over(group)
        return F.when(constant, m).otherwise(F.sum(F.col("n") * m).over(group) / F.sum("n").over(group))

    moved = cells.select(
        *keys,
        "n",
        *[(F.col(f"m_{c}") - shift(c)).alias(f"d_{c}") for c in columns],
        *[f"c_{_pair(a, b)}" for a, b in pairs(columns)],
    )
    return moved.select(
        *keys,
        "n",
        *[(F.col("n") * F.col(f"d_{c}")).alias(f"s_{c}") for c in columns],
        *[
            (F.col("n") * (F.col(f"c_{_pair(a, b)}") + F.col(f"d_{a}") * F.col(f"d_{b}"))).alias(f"q_{_pair(a, b)}")
            for a, b in pairs(columns)
        ],
    )


def moment_columns(columns: list[str]) -> list[str]:
    return ["n", *[f"s_{c}" for c in columns], *[f"q_{_pair(a, b)}" for a, b in pairs(columns)]]


def raw_gram(first: str, second: str) -> Column:
    """Centred cross moment from the sums of one row."""
    product = F.col(f"s_{first}") * F.col(f"s_{second}")
    return F.col(f"q_{_pair(first, second)}") - F.try_divide(product, F.col("n"))


def total_gram(first: str, second: str) -> Column:
    """Centred around the overall means (no factor absorbed)."""
    return F.col(f"t_{_pair(first, second)}")


def scale(name: str) -> Column:
    """Second moment of a variable around the origin of its sums, to judge rounding noise."""
    return F.col(f"z_{name}")


def within_gram(first: str, second: str) -> Column:
    """Centred around the means of the absorbed factor's groups (fixed effects)."""
    return F.col(f"w_{_pair(first, second)}")


def weighted_moments(
    cells: DataFrame,
    columns: list[str],
    by: list[str],
    absorb: str | None,
    draws: DataFrame | None = None,
    cluster: str | None = None,
) -> DataFrame:
    """Total and within-factor cross moments per (by, rep).

    Without ``draws`` there is one replicate, the data itself. Absorbing a factor by
    demeaning is the same as a dummy per level, and under weights the demeaning is redone
    per replicate from the level sums.
    """
    names = moment_columns(columns)
    if draws is None:
        weighted = cells.withColumn("rep", F.lit(0)).withColumn("weight", F.lit(1.0))
    else:
        shared = [name for name in [*by, cluster] if name in draws.columns]
        weighted = cells.join(draws, shared)
    levels = weighted.groupBy(*by, "rep", *([absorb] if absorb else [])).agg(
        *[F.sum(F.col("weight") * F.col(name)).alias(name) for name in names]
    )
    pooled = levels.groupBy(*by, "rep").agg(
        F.count(F.lit(1)).alias("levels"),
        *[F.sum(name).alias(name) for name in names],
        *[F.sum(raw_gram(a, b)).alias(f"w_{_pair(a, b)}") for a, b in pairs(columns)],
    )
    return pooled.select(
        *by,
        "rep",
        "levels",
        "n",
        *[f"s_{name}" for name in columns],
        *[f"w_{_pair(a, b)}" for a, b in pairs(columns)],
        *[raw_gram(a, b).alias(f"t_{_pair(a, b)}") for a, b in pairs(columns)],
        *[F.col(f"q_{_pair(c, c)}").alias(f"z_{c}") for c in columns],
    )


class Fit:
    """Least-squares fit written against the columns of a moment row."""

    def __init__(self, gram: Gram, predictors: list[str], outcome: str):
        self.coefficients = least_squares(gram, predictors, outcome, scale)
        explained = residual_moment(gram, self.coefficients, outcome, outcome)
        self.r2 = 1 - F.try_divide(explained, total_gram(outcome, outcome))


def partial_correlation(gram: Gram, first: str, second: str, given: list[str]) -> Column:
    """Correlation of two variables after regressing both on ``given``."""
    of_first = least_squares(gram, given, first)
    of_second = least_squares(gram, given, second)
    cross = residual_moment(gram, of_first, first, second)
    size_first = residual_moment(gram, of_first, first, first)
    size_second = residual_moment(gram, of_second, second, second)
    return F.try_divide(cross, F.sqrt(size_first * size_second))


def correlation(gram: Gram, first: str, second: str) -> Column:
    return partial_correlation(gram, first, second, [])


def indicators(factors: dict[str, list[str]]) -> dict[str, Column]:
    """0/1 columns of several factors, the first level (sorted as text) left out."""
    out: dict[str, Column] = {}
    for name, levels in factors.items():
        for i, level in enumerate(sorted(levels)[1:]):
            out[f"d_{name}_{i}"] = (F.col(name).cast("string") == level).cast("double")
    return out
