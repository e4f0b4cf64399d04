"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Vectors of unit length are dealt to the list of their nearest coarse centroid. What is left of
them is coded in subspaces. A vector is compared with the members of all lists near enough:
first by table look-ups of its distance to the members' codes, then, where the codes leave it
open, by the exact cosine.

- Near enough: (|x - c|^2 - |x - c0|^2) / (2 |c - c0|), c0 being the centroid nearest to x, is
  the distance from x to the plane beyond which c is nearer. Two vectors at distance r in the
  lists of c0 and c lie on either side of that plane, and their distances to it sum to r at
  most, so one of them is within r / 2. All lists within r / 2 are probed, from both vectors of
  a pair: nothing is lost, however the vectors are spread. A finite ``margin`` also limits the
  probes to that many steps of r / sqrt(d), typical of random directions in d dimensions, and
  may lose pairs that differ in few directions.
- The look-up test loses nothing: |x - y| >= |x - code(y)| - |y - code(y)|, and the second term
  is kept with the code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlens.llm.common import written
from examlens.llm.components import components, forest

#: Vectors of the fitting sample at most; members of a list on average; lists at most.
SAMPLE, LIST_ROWS, MAX_LISTS = 16_384, 256, 2_048
SUBSPACES, CODES = 16, 64
#: No limit on the probes but the exact one.
MARGIN = float("inf")
#: Members and queries of a list that one group compares.
TILE = 4_096
#: Slack for rounding in the bounds; the decision itself is the exact cosine.
EPS = 1e-6


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _kmeans(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(data))
    centres = data[rng.choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * data @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centroids and the codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, lists, 8, 5)
        near = self.nearest(sample)[0]
        rest = sample - self.centres[near]
        width = sample.shape[1]
        m = max(x for x in range(1, min(SUBSPACES, width) + 1) if width % x == 0)
        self.books = [_kmeans(part, CODES, 6, 11 + k) for k, part in enumerate(np.split(rest, m, axis=1))]
        apart = (self.centres**2).sum(1)
        self.between = np.sqrt(np.maximum(apart[:, None] + apart - 2 * self.centres @ self.centres.T, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector, and its squared distances to all centroids."""
        squares = np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)
        return squares.argmin(1), squares

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the distance between each residual and its code."""
        out, lost = [], np.zeros(len(rest))
        for book, part in zip(self.books, np.split(rest, len(self.books), axis=1)):
            near = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            out.append(near.astype(np.uint8))
            lost += ((part - book[near]) ** 2).sum(1)
        return np.stack(out, 1), np.sqrt(lost)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Per subspace, squared distances of each residual's part to the codewords."""
        return [
            (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            for book, part in zip(self.books, np.split(rest, len(self.books), axis=1))
        ]

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own list of each vector, and all lists behind planes within the margin."""
        own, squares = self.nearest(x)
        base = squares[np.arange(len(x)), own][:, None]
        may = squares - base <= 2 * (margin + EPS) * self.between[own] + EPS
        may[np.arange(len(x)), own] = True
        return own, [np.flatnonzero(row) for row in may]


def links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least_cosine: float = 0.95,
    sample: int = SAMPLE,
    list_rows: int = LIST_ROWS,
    margin: float = MARGIN,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    ``n_links`` counts the other vectors with cosine of ``least_cosine`` at least, in double
    precision; ``component_id`` is the smallest id reachable by links. Vectors that are null or
    zero or hold null or non-finite components link with nothing, as do rows without an id.
    Vectors of another length than most of the sample are linked with their equals only. Rows
    that repeat an id count as one more vector each when links are counted.

    Equal vectors form one class, compared once and counted as often as it occurs. The centroids
    and codebooks are fitted on a sample chosen by hash; every vector is indexed, the number of
    lists grows with the vectors up to ``MAX_LISTS``. Long lists are cut into tiles that are
    compared pair by pair in tasks of their own. A task returns a vector's number of links and a
    forest of the links, never the pairs.
    """
    ids = vectors.schema[id_col].dataType.simpleString()
    values = F.col(vector_col).cast("array<double>")
    sane = (
        F.coalesce(F.size(values) > 0, F.lit(False))
        & ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(values, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.when(F.coalesce(sane, F.lit(False)) & F.col(id_col).isNotNull(), values).alias("v")
    )
    classes = written(
        rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors"
    )
    total = classes.count()
    spark = vectors.sparkSession
    zero = F.lit(0).cast("long")
    if not total:
        return rows.select(
            "vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    picked = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()
    lengths = pd.Series([len(r.v) for r in picked]).value_counts()
    width = int(lengths[lengths == lengths.max()].index.min())
    fitting = _unit(np.array([r.v for r in picked if len(r.v) == width]))
    index = spark.sparkContext.broadcast(Index(fitting, max(1, min(MAX_LISTS, len(fitting), total // list_rows))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    reach = radius * min(0.5, margin / np.sqrt(width))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per vector and probed list; the vector's own list comes with home = true."""
        ix = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
                x = _unit(flat.reshape(b.num_rows, width))
                own, lists = ix.probes(x, reach)
                reps, n = b.column("rep").to_numpy(), b.column("n").to_numpy()
                who = np.repeat(np.arange(len(x)), [len(p) for p in lists])
                to = np.concatenate(lists)
                raw, wide = [r.tobytes() for r in x], [p.astype(np.int32).tobytes() for p in lists]
                home = own[who] == to
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to.astype(np.int32)), pa.array(home), pa.array(reps[who]), pa.array(n[who]),
                        pa.array(own[who].astype(np.int32)), pa.array([raw[k] for k in who], pa.binary()),
                        pa.array([wide[k] if h else b"" for k, h in zip(who, home)], pa.binary()),
                    ],
                    names=["list", "home", "rep", "n", "own", "raw", "probes"],
                )

    placed = written(
        classes.where(F.size("v") == width).mapInArrow(
            assigned, f"list int, home boolean, rep {ids}, n long, own int, raw binary, probes binary"
        ),
        "lists",
    )
    # one row per list, MAX_LISTS at most: the bound makes the broadcast safe
    sizes = placed.groupBy("list").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / TILE).cast("int").alias("mt"),
        F.ceil(F.count("*") / TILE).cast("int").alias("qt"),
    )
    cut = placed.join(F.broadcast(sizes), "list").where(F.col("mt") > 0)
    member_tile = F.pmod(F.xxhash64("rep"), F.col("mt")).cast("int")
    query_tile = F.pmod(F.xxhash64("rep"), F.col("qt")).cast("int")
    slim = ["list", "rep", "n", "own", "raw", "probes"]
    members = cut.where("home").select(
        *slim, member_tile.alias("m"), F.explode(F.sequence(F.lit(0), F.col("qt") - 1)).alias("q"), F.lit(True).alias("member")
    )
    queries = cut.select(
        *slim, F.explode(F.sequence(F.lit(0), F.col("mt") - 1)).alias("m"), query_tile.alias("q"), F.lit(False).alias("member")
    )

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        ix = index.value
        here = key[0].as_py()
        kind = table.column("member").to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(kind)
        rep, n, own = (table.column(c).to_numpy() for c in ("rep", "n", "own"))
        x = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(len(kind), width)
        wide = table.column("probes").to_pylist()
        codes, lost = ix.code(x[mine] - ix.centres[here])
        # where the pair is counted: in the lower of both lists if both probe each other's
        lists_of = np.zeros((len(mine), len(ix.centres)), bool)
        for k, i in enumerate(mine):
            lists_of[k, np.frombuffer(wide[i], np.int32)] = True
        degree, a, b = np.zeros(len(kind), np.int64), [], []
        asking = np.flatnonzero(~kind)
        for at in range(0, len(asking), 256):
            q = asking[at : at + 256]
            tables = ix.tables(x[q] - ix.centres[here])
            near = np.zeros((len(q), len(mine)))
            for k, t in enumerate(tables):
                near += t[:, codes[:, k]]
            may = np.sqrt(np.maximum(near, 0)) <= radius + lost + EPS
            same = own[q] == here
            may &= np.where(same[:, None], rep[q][:, None] < rep[mine], (own[q] > here)[:, None] | ~lists_of[:, own[q]].T)
            i, j = np.nonzero(may)
            i, j = q[i], mine[j]
            good = np.concatenate(
                [np.zeros(0, bool)]
                + [
                    np.einsum("ij,ij->i", x[i[k : k + 50_000]], x[j[k : k + 50_000]]) >= least_cosine
                    for k in range(0, len(i), 50_000)
                ]
            )
            i, j = i[good], j[good]
            np.add.at(degree, i, n[j])
            np.add.at(degree, j, n[i])
            a.append(i)
            b.append(j)
        # members also stand among the queries: rows of one vector are one node
        nodes, at = np.unique(rep, return_inverse=True)
        sums = np.zeros(len(nodes), np.int64)
        np.add.at(sums, at, degree)
        left, right = (at[np.concatenate(s)] if s else np.zeros(0, int) for s in (a, b))
        child, parent = forest(len(nodes), left, right)
        root = nodes.copy()
        root[child] = nodes[parent]
        kept = sums > 0
        return pa.table({"rep": nodes[kept], "degree": sums[kept], "root": root[kept]})

    found = written(
        members.unionByName(queries)
        .groupBy("list", "m", "q")
        .applyInArrow(compared, f"rep {ids}, degree long, root {ids}"),
        "links",
    )
    degrees = found.groupBy("rep").agg(F.sum("degree").alias("degree"))
    roots = components(found, "rep", "root")
    graded = (
        classes.join(degrees, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("v").alias("_v"),
            (F.coalesce("degree", zero) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    return rows.join(graded, F.col("v") == F.col("_v"), "left").select(
        "vec_id",
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
