"""Least squares from centred cross moments.

A *gram* is a function ``gram(a, b) -> Column`` that gives the centred cross moment of two
variables of one row of a moment table. One and two predictors are solved in closed form
inside the JVM; more go through one Arrow-batched solve per block of (tiny) matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from examlens.functions.common import once

Gram = Callable[[str, str], Column]

# A pivot below this share of the raw scale counts as no variation. Callers whose variables are
# percentages, shares or years may leave the scale out; it is then one.
SINGULAR = 1e-12


@F.pandas_udf(ArrayType(DoubleType()))
def solve_normal_equations(
    batches: Iterator[tuple[pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    """Minimum-norm solution of A b = c for flattened symmetric A.

    The matrix is scaled to unit diagonal first, so that predictors on different scales do
    not lose each other in the rank decision.
    """
    for matrices, sides in batches:
        out: list[np.ndarray | None] = [None] * len(matrices)
        usable = [
            i
            for i, (m, c) in enumerate(zip(matrices, sides))
            if m is not None and np.isfinite(m).all() and np.isfinite(c).all()
        ]
        if usable:
            c = np.stack([sides.iloc[i] for i in usable]).astype(float)
            k = c.shape[1]
            a = np.stack([matrices.iloc[i] for i in usable]).astype(float).reshape(-1, k, k)
            scale = np.sqrt(np.clip(np.einsum("nii->ni", a), 0.0, None))
            inverse = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)
            a = a * inverse[:, :, None] * inverse[:, None, :]
            solved = np.linalg.pinv(a, rcond=1e-11, hermitian=True) @ (c * inverse)[:, :, None]
            for i, row in zip(usable, solved[:, :, 0] * inverse):
                out[i] = row
        yield pd.Series(out, dtype=object)


#: Rounds over all pairs of rows; each squares what is left beside the diagonal.
SWEEPS = 10


def symmetric_eigenvalues(flat: Column) -> Column:
    """Eigenvalues of a flattened symmetric matrix, in no order, by Jacobi rotations.

    Every rotation makes one pair of entries zero. For the small matrices of a design.
    """

    def solved(size: Column) -> Column:
        below = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
        pairs = F.flatten(
            F.transform(
                below,
                lambda p: F.transform(F.sequence(p + 1, size - 1), lambda q: F.struct(p.alias("p"), q.alias("q"))),
            )
        )

        def rotated(m: Column, pair: Column) -> Column:
            p, q = pair["p"], pair["q"]
            off = F.get(m, p * size + q)
            theta = (F.get(m, q * size + q) - F.get(m, p * size + p)) / (2 * off)
            tangent = F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1))
            turn = once(
                tangent,
                lambda t: F.struct((1 / F.sqrt(t * t + 1)).alias("c"), (t / F.sqrt(t * t + 1)).alias("s")),
            )

            def turned(r: Column) -> Column:
                def row(i: Column, j: Column) -> Column:
                    first, second = F.get(m, p * size + j), F.get(m, q * size + j)
                    return (
                        F.when(i == p, r["c"] * first - r["s"] * second)
                        .when(i == q, r["s"] * first + r["c"] * second)
                        .otherwise(F.get(m, i * size + j))
                    )

                def entry(place: Column) -> Column:
                    i, j = F.floor(place / size).cast("int"), place % size
                    return (
                        F.when(j == p, r["c"] * row(i, p) - r["s"] * row(i, q))
                        .when(j == q, r["s"] * row(i, p) + r["c"] * row(i, q))
                        .otherwise(row(i, j))
                    )

                return F.transform(F.sequence(F.lit(0), size * size - 1), entry)

            return F.when(off == 0, m).otherwise(once(turn, turned))

        final = F.aggregate(F.flatten(F.array_repeat(pairs, SWEEPS)), flat, rotated)
        return once(final, lambda m: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(m, i * size + i)))

    return once(F.round(F.sqrt(F.size(flat))).cast("int"), solved)


def design_conditioning(matrix: Column) -> Column:
    """Rank and condition number of a design from its flattened cross-product matrix."""

    def judged(singular: Column) -> Column:
        top, low = F.array_max(singular), F.array_min(singular)
        rank = F.size(F.filter(singular, lambda v: v > 1e-8 * top))
        condition = F.when(low > 0, top / low).otherwise(float("inf"))
        return F.struct(rank.alias("rank"), condition.alias("condition_number"))

    return once(F.transform(symmetric_eigenvalues(matrix), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))), judged)


def least_squares(
    gram: Gram, predictors: list[str], outcome: str, scale: Callable[[str], Column] | None = None
) -> dict[str, Column]:
    """Coefficient of every predictor; a predictor without variation gets 0.

    ``scale`` gives a variable's second moment before centring, in the same unit as its gram.
    """
    if not predictors:
        return {}
    if len(predictors) == 1:
        (x,) = predictors
        return {x: F.coalesce(F.try_divide(gram(x, outcome), _pivot(gram, x, scale)), F.lit(0.0))}
    if len(predictors) == 2:
        return _two_predictors(gram, *predictors, outcome, scale)
    matrix = F.array(*[gram(a, b) for a in predictors for b in predictors])
    side = F.array(*[gram(a, outcome) for a in predictors])
    solved = solve_normal_equations(matrix, side)
    return {name: solved[i] for i, name in enumerate(predictors)}


def _pivot(gram: Gram, name: str, scale: Callable[[str], Column] | None) -> Column:
    """The variable's own moment, or null when it is rounding noise around a constant."""
    value = gram(name, name)
    return F.when(value > (SINGULAR * scale(name) if scale else F.lit(SINGULAR)), value)


def _two_predictors(
    gram: Gram, x: str, z: str, y: str, raw: Callable[[str], Column] | None
) -> dict[str, Column]:
    xx, zz, xz = gram(x, x), gram(z, z), gram(x, z)
    xy, zy = gram(x, y), gram(z, y)
    determinant = xx * zz - xz * xz
    regular = determinant > SINGULAR * xx * zz
    # rank one: the minimum-norm solution is A c / trace(A)^2
    trace = xx + zz
    least = SINGULAR * (raw(x) + raw(z)) if raw else F.lit(SINGULAR)
    scale = F.coalesce(
        F.try_divide(F.lit(1.0), F.when(trace > least, trace * trace)), F.lit(0.0)
    )
    safe = F.when(regular, determinant)
    return {
        x: F.coalesce(F.try_divide(zz * xy - xz * zy, safe), scale * (xx * xy + xz * zy)),
        z: F.coalesce(F.try_divide(xx * zy - xz * xy, safe), scale * (xz * xy + zz * zy)),
    }


def residual_moment(
    gram: Gram, coefficients: dict[str, Column], first: str, second: str
) -> Column:
    """Cross moment of ``first``'s residual (after the given fit of first) with ``second``."""
    value = gram(first, second)
    for name, beta in coefficients.items():
        value = value - beta * gram(name, second)
    return value
