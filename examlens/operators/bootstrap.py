"""Bootstrap resampling as joins of draw tables with small moment tables.

Draws come from hashes of (seed, repetition, position), so a run is repeatable on any
cluster and in any engine. Replicate 0 is the original sample with weight 1, so one pass
gives the estimate and its replicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import hash32, once
from examlens.functions.stats import binomial_quantile, hashed_uniform

REPETITIONS = 2000


def cluster_draws(
    frame: DataFrame,
    cluster: str,
    seed: int,
    repetitions: int = REPETITIONS,
    by: list[str] | None = None,
) -> DataFrame:
    """Clusters drawn with replacement: ``(*by, rep, cluster, weight)``.

    ``weight`` is how often a cluster was drawn in a replicate. Clusters are contest years, so
    the list per group is short. Replicates are dealt to all tasks before anything is drawn:
    one group's come from a range over the replicates, several groups' from an exchange.
    """
    by = by or []
    listed = frame.groupBy(*by).agg(F.sort_array(F.collect_set(cluster)).alias("_clusters"))
    size = F.size("_clusters")
    if by:
        reps = listed.select(
            *by, "_clusters", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep")
        ).repartition(*by, "rep")
    else:
        reps = frame.sparkSession.range(1, repetitions + 1).select(
            listed.scalar().alias("_clusters"), F.col("id").cast("int").alias("rep")
        )
    drawn = reps.select(
        *by,
        "rep",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), size - 1),
                lambda i: F.get(
                    F.col("_clusters"),
                    F.pmod(hash32(F.lit(seed), F.col("rep"), i), size).cast("int"),
                ),
            )
        ).alias(cluster),
    )
    sampled = drawn.groupBy(*by, "rep", cluster).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    original = listed.select(
        *by, F.lit(0).alias("rep"), F.explode("_clusters").alias(cluster), F.lit(1.0).alias("weight")
    )
    return original.unionByName(sampled)


def _tasks(frame: DataFrame) -> int:
    """Tasks to deal replicates to; a set number, since few bytes would be merged into one task."""
    spark = frame.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def item_draws(
    cells: DataFrame,
    count: str,
    seed: int,
    repetitions: int = REPETITIONS,
    by: list[str] | None = None,
) -> DataFrame:
    """Items drawn with replacement, expressed on a table of distinct cells.

    Resampling n items and counting them per cell is a multinomial draw over the cells, so
    the cost depends on the number of cells and not on the number of items. ``cells`` has one
    row per distinct combination of values with its ``count``; the result repeats it per
    replicate with the drawn ``weight``.

    The multinomial is drawn cell by cell: of the items still to be placed, a binomial number
    falls into the next cell. Each is the quantile of a hashed uniform, so draws are the same on
    any cluster and in any engine. A replicate is one row with the group's cells as an array;
    replicates are dealt to all tasks before anything is drawn.
    """
    by = by or []
    values = [name for name in cells.columns if name not in by and name != count]
    packed = cells.groupBy(*by).agg(
        F.sort_array(
            F.collect_list(F.struct(*values, F.col(count).cast("bigint").alias("_n")))
        ).alias("_cells"),
        F.sum(F.col(count).cast("bigint")).alias("_total"),
    )
    reps = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions))).alias("rep"))

    def place(state: Column, cell: Column) -> Column:
        uniform = hashed_uniform(F.lit(seed), F.col("rep"), F.size(state["drawn"]))
        among = binomial_quantile(state["left"], cell["_n"] / state["rest"], uniform)
        drawn = F.when(cell["_n"] == state["rest"], state["left"]).otherwise(among)
        return once(
            drawn,
            lambda n: F.struct(
                (state["left"] - n).alias("left"),
                (state["rest"] - cell["_n"]).alias("rest"),
                F.array_append(state["drawn"], n).alias("drawn"),
            ),
        )

    start = F.struct(
        F.col("_total").alias("left"), F.col("_total").alias("rest"), F.array().cast("array<bigint>").alias("drawn")
    )
    resampled = F.aggregate("_cells", start, place, lambda state: state["drawn"])
    weights = F.when(F.col("rep") == 0, F.col("_cells")["_n"]).otherwise(resampled)
    drawn = reps.repartition(_tasks(cells), *by, "rep").withColumn("_weights", weights)
    return drawn.select(
        *by, "rep", F.explode(F.arrays_zip("_cells", "_weights")).alias("_cell")
    ).select(
        *by,
        "rep",
        *[F.col(f"_cell._cells.{name}").alias(name) for name in values],
        F.col("_cell._weights").cast("double").alias("weight"),
    )


#: Replicates whose weights come from one hash, and the hexadecimal digits of each.
LANES, DIGITS = 8, 4


def _poisson_limits() -> list[str]:
    """Distribution function of Poisson(1), in 65536ths, as hexadecimal digits; ends before the last."""
    top, limits, total, term = 16**DIGITS, [], 0.0, math.exp(-1)
    for k in range(1, 12):
        total += term
        term /= k
        if round(total * top) < top:
            limits.append(f"{round(total * top):0{DIGITS}x}")
    return limits


POISSON_LIMITS = _poisson_limits()


def row_correlation_interval(
    frame: DataFrame,
    by: list[str],
    columns: tuple[str, str],
    key: list[str],
    seed: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """Pearson r with a row-bootstrap interval, in one pass that keeps no rows.

    Every row stands Poisson(1) times in every replicate, independently: what resampling n of n
    rows comes to for all but the smallest n. Weights are hashes of (seed, block of replicates,
    ``key``), so ``key`` must name a row. A task adds to one vector of weighted sums per group and
    block; vectors are merged by element. Memory depends on the number of groups and replicates
    alone. Rows in which a value is missing count for nothing. Values are moved by their group's
    mean first, so that sums of squares keep their digits.
    """
    x, y = columns
    known = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.concat_ws("|", *key).alias("_key")
    )
    means = known.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    if by:
        named = means.select(*[F.col(name).alias(f"_by_{name}") for name in by], "_mx", "_my")
        same = [F.col(name).eqNullSafe(F.col(f"_by_{name}")) for name in by]
        placed = known.join(named, same)
    else:
        placed = known.select("*", means.select("_mx").scalar().alias("_mx"), means.select("_my").scalar().alias("_my"))
    moved = placed.select(*by, "_key", (F.col("_x") - F.col("_mx")).alias("x"), (F.col("_y") - F.col("_my")).alias("y"))
    parts = {
        "n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"),
        "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y"),
    }
    blocks = -(-repetitions // LANES)
    hashed = moved.select(
        *by, "x", "y", "_key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    ).withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_block").cast("string"), "_key")))
    drawn = hashed
    for lane in range(LANES):
        digits = F.substring("_hash", lane * DIGITS + 1, DIGITS)
        drawn = drawn.withColumn(f"_w{lane}", sum(((digits >= limit).cast("double") for limit in POISSON_LIMITS), F.lit(0.0)))
    sums = [F.sum(F.col(f"_w{lane}") * part).alias(f"{name}{lane}") for lane in range(LANES) for name, part in parts.items()]
    vectors = drawn.groupBy(*by, "_block").agg(*sums)
    lanes = F.array(
        *[
            F.struct((F.col("_block") * LANES + lane + 1).alias("rep"), *[F.col(f"{name}{lane}").alias(name) for name in parts])
            for lane in range(LANES)
        ]
    )
    sampled = vectors.select(*by, F.explode(lanes).alias("r")).select(*by, "r.*").filter(F.col("rep") <= repetitions)
    original = moved.groupBy(*by).agg(F.lit(0).alias("rep"), *[F.sum(part).alias(name) for name, part in parts.items()])
    every = original.select(*by, "rep", *parts).unionByName(sampled.select(*by, "rep", *parts))
    n = F.col("n")
    xx, yy, xy = F.col("xx") - F.col("sx") ** 2 / n, F.col("yy") - F.col("sy") ** 2 / n, F.col("xy") - F.col("sx") * F.col("sy") / n
    # what is left of equal values is rounding noise
    varies = (xx > 1e-12 * F.col("xx")) & (yy > 1e-12 * F.col("yy")) & (n > 0)
    replicates = every.select(*by, "rep", F.when(varies, xy / F.sqrt(xx * yy)).alias("pearson_r"))
    return interval(replicates, by, ["pearson_r"], repetitions)


def interval(
    replicates: DataFrame,
    by: list[str],
    values: list[str],
    repetitions: int = REPETITIONS,
    plain: list[str] | None = None,
) -> DataFrame:
    """Estimate (replicate 0) and percentile interval of every value column.

    Adds ``<v>``, ``<v>_ci_low``, ``<v>_ci_high`` and ``bootstrap_samples``, the number of
    usable replicates; fewer than 95 % usable replicates is an error. ``plain`` columns keep
    their replicate-0 value only.
    """
    aggregates = []
    for value in values:
        resampled = F.when(F.col("rep") > 0, _finite(F.col(value)))
        bounds = F.percentile(resampled, F.array(F.lit(0.025), F.lit(0.975)))
        aggregates += [
            F.max(F.when(F.col("rep") == 0, F.col(value))).alias(value),
            bounds.alias(f"_bounds_{value}"),
            F.count(resampled).alias(f"_usable_{value}"),
        ]
    plain = plain or []
    aggregates += [F.max(F.when(F.col("rep") == 0, F.col(name))).alias(name) for name in plain]
    usable = F.least(*[F.col(f"_usable_{v}") for v in values]) if len(values) > 1 else F.col(
        f"_usable_{values[0]}"
    )
    enough = F.when(usable >= int(0.95 * repetitions), usable).otherwise(
        F.raise_error(F.lit("too many invalid bootstrap samples")).cast("bigint")
    )
    columns: list[Column] = [F.col(name) for name in by]
    for value in values:
        columns += [
            F.col(value),
            F.col(f"_bounds_{value}")[0].alias(f"{value}_ci_low"),
            F.col(f"_bounds_{value}")[1].alias(f"{value}_ci_high"),
        ]
    return (
        replicates.groupBy(*by)
        .agg(*aggregates)
        .select(*columns, enough.cast("bigint").alias("bootstrap_samples"), *plain)
    )


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def mean_interval(
    frame: DataFrame,
    values: dict[str, Column],
    by: list[str],
    cluster: str,
    seed: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """Cluster-bootstrap interval of means: per-cluster sums are taken once."""
    sums = frame.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(value).alias(name) for name, value in values.items()],
    )
    draws = cluster_draws(frame, cluster, seed, repetitions, by)
    replicates = (
        sums.join(draws, [*by, cluster])
        .groupBy(*by, "rep")
        .agg(
            *[
                (F.sum(F.col("weight") * F.col(name)) / F.sum(F.col("weight") * F.col("_n"))).alias(name)
                for name in values
            ]
        )
    )
    return interval(replicates, by, list(values), repetitions)


def callable_interval(
    frame: DataFrame,
    statistic: Callable[[pd.DataFrame], float],
    by: list[str],
    cluster: str,
    seed: int,
    repetitions: int = REPETITIONS,
) -> DataFrame:
    """Interval of any statistic of a panel, given as a function of a pandas frame.

    For statistics that do not reduce to moments. Every replicate is one group of panel size
    (exams of one series); the replicates are spread over the cluster.
    """
    draws = cluster_draws(frame, cluster, seed, repetitions, by)
    copies = F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))
    sampled = frame.join(draws, [*by, cluster]).withColumn("_copy", copies)
    names = list(by)

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        keys = {name: [rows[name].iloc[0]] for name in [*names, "rep"]}
        return pd.DataFrame({**keys, "statistic": [float(statistic(rows))]})

    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in by]
    schema = ", ".join([*key_types, "rep int", "statistic double"])
    replicates = sampled.groupBy(*by, "rep").applyInPandas(evaluate, schema)
    return interval(replicates, by, ["statistic"], repetitions)
