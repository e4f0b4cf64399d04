"""Data-quality checks that return violations as rows, so that they stay part of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.common import count_if


def predicate_check(frame: DataFrame, name: str, condition: Column) -> DataFrame:
    """One row: how many rows fail ``condition`` (null counts as failing)."""
    failed = ~F.coalesce(condition, F.lit(False))
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), count_if(failed).alias("violations")
    ).select(F.lit(name).alias("check"), "rows", "violations")


def row_count_check(frame: DataFrame, name: str, expected: int | Column) -> DataFrame:
    """One row: distance between the actual and the expected row count.

    ``expected`` may be a scalar taken from another table.
    """
    counted = frame.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        F.lit(name).alias("check"),
        "rows",
        F.abs(F.col("rows") - (expected if isinstance(expected, Column) else F.lit(expected))).cast("bigint").alias("violations"),
    )


def unique_key_check(frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row: number of key values that occur more than once (join cardinality)."""
    return (
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
            count_if(F.col("n") > 1).alias("violations"),
        )
        .select(F.lit(name).alias("check"), "rows", "violations")
    )


def coverage_check(
    frame: DataFrame, reference: DataFrame, name: str, keys: list[str]
) -> DataFrame:
    """One row: number of rows of ``frame`` whose key is missing in ``reference``."""
    known = reference.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = frame.select(*keys).join(known, keys, "left")
    return predicate_check(joined, name, F.col("_known").isNotNull())


def require(checks: DataFrame, frame: DataFrame) -> DataFrame:
    """``frame``, or an error while it is computed when any check has a violation.

    The verdict is a scalar subquery of the filter: it runs once, beside the frame, and nothing
    is collected.
    """
    failing = F.concat_ws(
        ", ", F.sort_array(F.collect_list(F.when(F.col("violations") > 0, F.col("check"))))
    )
    verdict = checks.agg(failing.alias("_failing")).scalar()
    guard = F.when(
        verdict != "", F.raise_error(F.concat(F.lit("failed checks: "), verdict)).cast("boolean")
    ).otherwise(F.lit(True))
    return frame.filter(guard)


def present(frame: DataFrame, found: Column, message: str) -> DataFrame:
    """``frame``, or an error while it is computed when ``found`` is null in a row.

    After a left join, with a column of the right side that is never null there: a row without
    a partner stops the run instead of vanishing.
    """
    return frame.filter(F.when(found.isNull(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
