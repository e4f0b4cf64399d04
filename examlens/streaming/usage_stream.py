"""Usage events as a stream: rollups, event-time windows, deduplication."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from examlens.operators.usage import total_tokens, usage_rollup
from examlens.session import shared_folder


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event once, with state bounded by the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_usage(
    events: DataFrame, length: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Counters per run and event-time window, for a table or a stream with a watermark."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    prepared = events.withColumn("_tokens", total_tokens())
    grouped = prepared.groupBy("run", window.alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("events"),
        F.count_if(F.col("type") == "failure").cast("bigint").alias("failures"),
        F.sum("_tokens").cast("bigint").alias("tokens"),
        F.sum("cost_usd_known").alias("cost_usd"),
    )
    return grouped.select(
        "run",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "events",
        "failures",
        "tokens",
        "cost_usd",
    )


def read_usage_stream(spark: SparkSession, schema: StructType, path: str, **options: Any) -> DataFrame:
    """JSON usage log as a stream of files."""
    return spark.readStream.schema(schema).options(**options).json(path)


def append_usage_log(events: DataFrame, path: str, checkpoint: str):
    """Append-only usage log; exactly once through the checkpoint."""
    return (
        events.writeStream.format("json")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain(
    stream: DataFrame, mode: str, purpose: str, merge: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Run a stream over everything available and return its written result as a table.

    Append results accumulate in one parquet folder. In update mode every trigger writes its
    changed rows to a folder named by its batch number (so a repeated batch overwrites
    itself), and ``merge`` reduces the batches to the newest row per key.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, purpose)
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(
                f"{out}/{number}"
            )

        query = writer.foreachBatch(write).outputMode(mode).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    written = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    table = spark.read.schema(written).option("recursiveFileLookup", "true").parquet(out)
    return merge(table) if merge else table


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keep the last written row per key of an update-mode result."""

    def reduce(table: DataFrame) -> DataFrame:
        rest = [c for c in table.columns if c not in (*keys, "_batch")]
        row = F.max_by(F.struct(*rest), F.col("_batch")).alias("_row")
        return table.groupBy(*keys).agg(row).select(*keys, "_row.*")

    return reduce


def streaming_rollup(events: DataFrame) -> DataFrame:
    """The batch rollup over a stream (update mode)."""
    return usage_rollup(events)
