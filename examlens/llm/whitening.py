"""Whitening of embeddings from a covariance recovered by polarisation.

Only variances are aggregated, as exact whole numbers: of every dimension and of the sum of every
two dimensions. 2 cov(a, b) = var(a + b) - var(a) - var(b) gives the covariances, the eigenvectors
of their matrix the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries are held within this bound, so that they are whole numbers in double precision.
LARGEST = 2**52
#: Rows of a batch whose sums are taken at once.
ROWS = 1024


class Fit(NamedTuple):
    """Facts of all vectors of one length; whole numbers are Python integers of any size."""

    n: int
    sums: list[int]
    variances: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # a component per row
    total: float  # trace of the covariance


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that are not null and whose entries are finite numbers."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("vec_id"), v.alias("v"))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers; beyond 2**52 (after scaling) the nearest that is held."""
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of at most ``ROWS`` vectors of one length."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            column = b.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                picked = flat[starts[rows][:, None] + np.arange(size)]
                yield b.column("vec_id").take(pa.array(rows)), whole_numbers(picked)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """The numbers in 64 bits if results up to ``bound`` fit there, else as Python integers."""
    return x if bound < 2**63 else x.astype(object)


def _square_sums(x: np.ndarray) -> list[int]:
    """Sums over the rows of the squares of every dimension, and of the sum of every two of them."""
    rows, size = x.shape
    x = _exact(x, 4 * max(1, int(np.abs(x).max(initial=0))) ** 2 * max(1, rows))
    out = [*(x * x).sum(0).tolist()]
    for a in range(size - 1):
        both = x[:, a, None] + x[:, a + 1 :]
        out += (both * both).sum(0).tolist()
    return [int(v) for v in out]


def _summed(vectors: DataFrame, sums_of) -> dict[int, list[int]]:
    """Sums over all rows of what ``sums_of`` gives for the rows of a block, by length of vector.

    Every task sends its own sums; they meet per number, not per vector. The result's size
    depends on the vectors' length alone.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for _, x in _blocks(batches):
            new = sums_of(x)
            old = held.get(x.shape[1])
            held[x.shape[1]] = [p + q for p, q in zip(old, new)] if old else new
        for size, numbers in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(numbers), pa.int32()), pa.array(range(len(numbers)), pa.int32())]
                + [pa.array([str(v) for v in numbers], pa.string())],
                names=["size", "at", "part"],
            )

    parts = vectors.mapInArrow(partial, "size int, at int, part string")
    found = parts.groupBy("size", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("string").alias("total"))
    out: dict[int, dict[int, int]] = {}
    for r in found.collect():
        out.setdefault(r.size, {})[r.at] = int(r.total)
    return {size: [numbers[k] for k in range(len(numbers))] for size, numbers in out.items()}


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """Covariance from sums of squares around the whole part of the mean, exact until the last step.

    ``squares`` has, of y = x - floor(S / n), the sums of squares of the dimensions and of the
    sums of two. With r = S - n * floor(S / n), the sum of (n * x - S)**2 is n * (n * squares - r**2).
    """
    size = len(sums)
    rest = [s % n for s in sums]
    centred = [n * (n * squares[k] - rest[k] ** 2) for k in range(size)]
    out, at = np.zeros((size, size)), size
    for a in range(size):
        out[a, a] = centred[a] / n**3
        for b in range(a + 1, size):
            both = n * (n * squares[at] - (rest[a] + rest[b]) ** 2)
            out[a, b] = out[b, a] = (both - centred[a] - centred[b]) / (2 * n**3)
            at += 1
    return out


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Fit]:
    """Components of all valid vectors, by length of vector.

    Two passes: sums, then squares around the whole part of the mean. Whole numbers are exact.
    For vectors of length d the driver gets d * (d + 1) / 2 numbers, whatever their count.
    Components without variance (up to rounding) are left out; an empty table has no fit.
    """
    slim = valid_vectors(vectors, id_col, vector_col).select("vec_id", "v").where(F.size("v") > 0)
    first = _summed(slim, lambda x: [len(x), *x.astype(object).sum(0).tolist()])
    means = {size: np.array([s // n for s in sums], np.int64) for size, (n, *sums) in first.items()}
    squares = _summed(slim, lambda x: _square_sums(x - means[x.shape[1]]))
    out = {}
    for size, (n, *sums) in first.items():
        matrix = covariance(n, sums, squares[size])
        values, columns = np.linalg.eigh(matrix)
        values, rows = values[::-1], columns.T[::-1]
        real = values > max(0.0, values[0]) * size * np.finfo(float).eps
        out[size] = Fit(n, sums, values[real], rows[real], float(np.trace(matrix)))
    return out


def _projected(x: np.ndarray, one: Fit, components: int) -> np.ndarray:
    """Whitened values of whole-number vectors."""
    centred = _scaled(x, one)
    values = one.variances[:components]
    return (centred.astype(float) / one.n) @ one.vectors[:components].T / np.sqrt(values)


def _scaled(x: np.ndarray, one: Fit) -> np.ndarray:
    """n * x - S, exact."""
    means = np.array([s // one.n for s in one.sums], np.int64)
    rest = np.array([s % one.n for s in one.sums], np.int64)
    y = x - means
    return _exact(y, (int(np.abs(y).max(initial=0)) + 1) * one.n) * one.n - rest


def identity_error(vectors: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float]:
    """Largest entry of the whitened values' covariance minus the identity, measured over all rows.

    Every task centres its own rows; the moments of the tasks are merged, so nothing is squared
    before it is centred.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for _, x in _blocks(batches):
            w = _projected(x, fits[x.shape[1]], components)
            mean = w.mean(0)
            new = (len(w), mean, (w - mean).T @ (w - mean))
            if x.shape[1] in held:
                n, m, c = held[x.shape[1]]
                gap, both = new[1] - m, n + new[0]
                new = (both, m + gap * new[0] / both, c + new[2] + np.outer(gap, gap) * n * new[0] / both)
            held[x.shape[1]] = new
        for size, (n, mean, moments) in held.items():
            a, b = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(a), size, np.int32)),
                    pa.array(a.astype(np.int32)),
                    pa.array(b.astype(np.int32)),
                    pa.array(np.full(len(a), float(n))),
                    pa.array(mean[a]),
                    pa.array(mean[b]),
                    pa.array(moments[a, b]),
                ],
                names=["size", "a", "b", "n", "ma", "mb", "m"],
            )

    parts = vectors.mapInArrow(partial, "size int, a int, b int, n double, ma double, mb double, m double")
    n = F.sum("n")
    merged = parts.groupBy("size", "a", "b").agg(
        # tasks of unequal sizes: covariance of their means, weighed by rows
        ((F.sum("m") + F.sum(F.col("n") * F.col("ma") * F.col("mb"))) / n - F.sum(F.col("n") * F.col("ma")) / n * F.sum(F.col("n") * F.col("mb")) / n).alias("c")
    )
    off = F.abs(F.col("c") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return {r.size: r.off for r in merged.groupBy("size").agg(F.max(off).alias("off")).collect()}


def whitened(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    fits: dict[int, Fit] | None = None,
) -> DataFrame:
    """A row per valid vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Null vectors and such with null or non-finite entries are dropped. Vectors of different
    lengths have a fit each. ``deviation`` is exact, and null if it takes more than 63 bits.
    Components without variance have no rows (nor has a table of equal or no vectors); repeated
    rows stay and count. The sign of a component is that of its largest entry, made positive.
    Other columns are not read.
    """
    ids = vectors.schema[id_col].dataType.simpleString()
    fits = fit(vectors, id_col, vector_col) if fits is None else fits
    fits = {size: f._replace(vectors=_signed(f.vectors)) for size, f in fits.items() if len(f.variances)}
    slim = valid_vectors(vectors, id_col, vector_col).where(F.size("v").isin(list(fits)) if fits else F.lit(False))
    errors = identity_error(slim, fits, components)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _blocks(batches):
            one = fits[x.shape[1]]
            scaled = _scaled(x, one)
            scaled = _exact(scaled, max(1, int(np.abs(scaled).max(initial=0))) ** 2 * x.shape[1])
            far = [int(d) for d in (scaled * scaled).sum(1)]
            w = _projected(x, one, components)
            k, n = w.shape[1], len(w)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, one.n, np.int64)),
                    pa.array([d if d < 2**63 else None for d in far for _ in range(k)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(one.variances[:k] / one.total, n)),
                    pa.array(np.full(n * k, errors[x.shape[1]])),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    return slim.mapInArrow(rows, f"vec_id {ids}, {kinds}")


def _signed(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).argmax(1)
    return rows * np.sign(rows[np.arange(len(rows)), top])[:, None]
