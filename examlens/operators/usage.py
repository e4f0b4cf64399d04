"""Usage and cost of running evaluations: rollups, projections, estimates.

The same aggregate serves a batch table and a stream. A usage event holds ``run, event_id,
ts`` (its order), ``type``, ``latency_ms``, ``attempts``, token counters and ``cost_usd_known``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.common import count_if

TOKEN_SAMPLES = 512
RECENT_ITEMS = 20
ALPHA = 0.2
# Sample sizes and bands of the cost projection and the time estimate.
BANDS = [(50, 0.05), (20, 0.07), (0, 0.10)]
SMALLEST_BAND = 0.01


def usage_events(results: DataFrame, run: str) -> DataFrame:
    """Usage events from run rows: type, safe numbers and one attempt at least."""
    skipped = F.col("skipped") if "skipped" in results.columns else F.lit(False)
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    attempts = F.col("attempts") if "attempts" in results.columns else F.lit(1)
    return results.select(
        F.col(run).alias("run"),
        F.col("item_id").cast("string").alias("row_id"),
        F.when(skipped, "skipped").when(failed, "failure").otherwise("success").alias("type"),
        F.col("year").try_cast("int").alias("year"),
        F.when(F.col("exam") != "", F.col("exam").cast("string")).alias("group"),
        F.col("points").try_cast("double").alias("points"),
        F.col("multimodal").cast("boolean").alias("multimodal"),
        "latency_ms",
        F.greatest(F.coalesce(attempts, F.lit(1)), F.lit(1)).alias("attempts"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        "reasoning_tokens",
        "explicit_reasoning_tokens",
        F.col("cost_usd").alias("cost_usd_known"),
        "predicted",
        F.col("is_correct").alias("correct"),
        "warnings",
    )


def total_tokens() -> Column:
    """Tokens of an event; a zero or missing total is replaced by prompt plus completion."""
    total = F.col("total_tokens")
    parts = F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(
        F.col("completion_tokens"), F.lit(0)
    )
    return F.coalesce(F.when(total != 0, total), parts).cast("bigint")


def _positive_sum(name: str) -> Column:
    value = F.col(name)
    return F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0)).cast("bigint")


def rollup_measures(events: DataFrame) -> list[Column]:
    """Running counters of a run as plain aggregates (usable in update mode)."""
    tokens = F.col("_tokens")
    cost = F.col("cost_usd_known")
    known = cost.isNotNull()

    def optional(name: str) -> Column:
        return _positive_sum(name) if name in events.columns else F.lit(0).cast("bigint")

    latency = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    measures = [
        F.count_if(F.col("type") == kind).cast("bigint").alias(kind)
        for kind in ("success", "failure", "skipped")
    ]
    measures += [
        F.coalesce(F.sum(F.when(tokens > 0, tokens)), F.lit(0)).cast("bigint").alias("total_tokens_total"),
        count_if(tokens > 0).alias("items_with_usage"),
        _positive_sum("prompt_tokens").alias("prompt_tokens_total"),
        _positive_sum("completion_tokens").alias("completion_tokens_total"),
        F.coalesce(F.sum(latency), F.lit(0.0)).alias("latency_sum"),
        F.count(latency).cast("bigint").alias("latency_count"),
        F.sum(F.greatest(F.coalesce(F.col("attempts"), F.lit(1)), F.lit(1))).cast("bigint").alias("attempts_sum"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost_known_total"),
        F.coalesce(F.sum(F.when(tokens > 0, cost)), F.lit(0.0)).alias("cost_with_tokens_total"),
        F.coalesce(F.sum(F.when(known & (tokens > 0), tokens)), F.lit(0)).cast("bigint").alias("tokens_with_cost"),
        F.coalesce(F.sum(F.when(~known & (tokens > 0), tokens)), F.lit(0)).cast("bigint").alias("tokens_without_cost"),
        F.count(cost).cast("bigint").alias("items_with_cost"),
        count_if(~known).alias("items_without_cost"),
    ]
    for name in ("reasoning_tokens", "explicit_reasoning_tokens", "cached_prompt_tokens"):
        if name in events.columns:
            measures.append(_positive_sum(name).alias(f"{name}_total"))
    if "status_code" in events.columns:
        status = F.col("status_code")
        measures += [
            count_if(status == 429).alias("throttles"),
            F.max_by(status, F.when(status.isNotNull(), F.struct("ts", "event_id"))).alias("last_status"),
        ]
    return measures


def usage_rollup(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Running counters per run; identical for a batch and a streaming frame."""
    by = by or ["run"]
    prepared = events.withColumn("_tokens", total_tokens())
    return (
        prepared.groupBy(*by)
        .agg(*rollup_measures(prepared))
        .withColumn("completed", F.col("success") + F.col("failure") + F.col("skipped"))
    )


def last_events(events: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The newest n events of each run in (ts, event_id) order.

    The optimizer turns the rank filter into a group limit before the shuffle, so every task
    sends at most n rows of a run, however large the run is.
    """
    keys = keys or ["run"]
    order = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)


def token_statistics(events: DataFrame) -> DataFrame:
    """Median and nearest-rank p90 of the last 512 events that used tokens."""
    used = events.withColumn("_tokens", total_tokens()).filter(F.col("_tokens") > 0)
    return token_statistics_of(last_events(used, TOKEN_SAMPLES))


def token_statistics_of(recent: DataFrame) -> DataFrame:
    """The same of events chosen before, with their ``_tokens``."""
    return recent.groupBy("run").agg(
        F.count(F.lit(1)).cast("bigint").alias("token_samples"),
        F.expr("percentile(_tokens, 0.5)").alias("median_tokens_per_item"),
        F.expr("CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY _tokens) AS DOUBLE)").alias(
            "p90_tokens_per_item"
        ),
    )


def recent_items(events: DataFrame, n: int = RECENT_ITEMS) -> DataFrame:
    """The newest items of each run as an array, newest first."""
    item = F.struct(
        F.col("_rank").alias("position"), "event_id", "type", "latency_ms", "cost_usd_known"
    )
    return (
        last_events(events, n)
        .groupBy("run")
        .agg(F.sort_array(F.collect_list(item)).alias("recent_items"))
    )


def mean_tokens() -> Column:
    return F.try_divide(F.col("total_tokens_total").cast("double"), F.col("items_with_usage"))


def remaining_items(total_items: Column) -> Column:
    return F.greatest(total_items - F.col("completed"), F.lit(0))


def cost_projection(rollup: DataFrame, total_items: Column) -> DataFrame:
    """Projected total cost with a band and a confidence label.

    Cost per token is used where tokens and cost are known together, else cost per item,
    else what is known so far.
    """
    known, samples = F.col("cost_known_total"), F.col("items_with_cost")
    per_token = F.try_divide(F.col("cost_with_tokens_total"), F.col("tokens_with_cost"))
    per_item = F.try_divide(known, samples)
    remaining = remaining_items(total_items)
    tokens_left = F.when(remaining > 0, mean_tokens() * remaining)
    by_tokens = (
        known
        + F.col("tokens_without_cost") * per_token
        + F.coalesce(tokens_left * per_token, F.lit(0.0))
    )
    projected = F.coalesce(by_tokens, per_item * total_items, known)
    share = F.lit(BANDS[-1][1])
    for least, band in reversed(BANDS[:-1]):
        share = F.when(samples >= least, F.lit(band)).otherwise(share)
    staged = rollup.withColumns(
        {"_projected": projected, "_share": share, "_per_token": per_token, "_per_item": per_item}
    ).withColumn("_band", F.greatest(F.col("_projected") * F.col("_share"), F.lit(SMALLEST_BAND)))
    open_end = F.col("_projected") > known
    high = samples >= 50
    by_item_only = F.col("_per_token").isNull() & F.col("_per_item").isNotNull()
    confidence = (
        F.when(high & ~by_item_only, "high").when(samples >= 10, "medium").otherwise("low")
    )
    return staged.select(
        "run",
        known.alias("known_cost"),
        F.when(F.col("_projected") > 0, F.col("_projected")).alias("projected_total"),
        F.when(open_end, F.greatest(known, F.col("_projected") - F.col("_band"))).alias("projected_low"),
        F.when(open_end, F.col("_projected") + F.col("_band")).alias("projected_high"),
        F.col("_per_item").alias("average_cost_per_item"),
        samples.alias("samples"),
        F.lit("USD").alias("currency"),
        confidence.alias("confidence"),
    )


def request_rate(events: DataFrame, chunk: str = "1 hour", alpha: float = ALPHA) -> DataFrame:
    """Exponentially weighted request rate per run, in requests per second.

    The average is a chain of affine steps ``e -> (1 - a) e + a x``. Steps compose, so each
    time chunk of a run is folded on its own into one pair (factor, offset) and only the
    pairs are combined per run. A run with a third of all events is still spread over its
    chunks.
    """
    keyed = events.select("run", "ts", "event_id", F.window("ts", chunk)["start"].alias("chunk"))
    in_chunk = Window.partitionBy("run", "chunk").orderBy("ts", "event_id")
    # last event of the previous chunk, from one row per chunk
    over_chunks = Window.partitionBy("run").orderBy("chunk")
    edges = (
        keyed.groupBy("run", "chunk")
        .agg(F.max("ts").alias("_last"))
        .withColumn("_before", F.lag("_last").over(over_chunks))
        .select("run", "chunk", "_before")
    )
    seconds = F.col("ts").cast("double")
    previous = F.coalesce(F.lag("ts").over(in_chunk), F.col("_before")).cast("double")
    # ``greatest`` ignores nulls, so the first event of a run is excluded explicitly
    interval = F.when(previous.isNotNull(), F.greatest(seconds - previous, F.lit(1e-6)))
    steps = keyed.join(edges, ["run", "chunk"]).select(
        "run",
        "chunk",
        F.row_number().over(in_chunk).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy("run", "chunk")).alias("_m"),
        (1 / interval).alias("_rate"),
    )
    # the very first event of a run has no interval; the first rate starts the average
    weight = F.pow(F.lit(1 - alpha), F.col("_m") - F.col("_i"))
    folded = steps.groupBy("run", "chunk").agg(
        F.count("_rate").alias("_n"),
        F.sum(alpha * weight * F.col("_rate")).alias("_offset"),
        F.min_by("_rate", F.when(F.col("_rate").isNotNull(), F.col("_i"))).alias("_first"),
    )
    later = Window.partitionBy("run").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("run")
    combined = folded.withColumns(
        {
            "_after": F.coalesce(F.sum("_n").over(later), F.lit(0)),
            "_all": F.sum("_n").over(whole),
            "_start": F.min_by("_first", F.when(F.col("_n") > 0, F.col("chunk"))).over(whole),
        }
    )
    decayed = F.pow(F.lit(1 - alpha), F.col("_after")) * F.col("_offset")
    return combined.groupBy("run").agg(
        F.max("_all").cast("bigint").alias("intervals"),
        # the first rate enters with full weight instead of alpha
        (
            F.sum(decayed)
            + F.max(F.pow(F.lit(1 - alpha), F.col("_all")) * F.col("_start"))
        ).alias("request_rate_ema"),
    )


def snapshot(events: DataFrame, total_items: Column) -> DataFrame:
    """One dashboard row per run from a batch of events."""
    rollup = usage_rollup(events)
    projection = cost_projection(rollup, total_items)
    packed = projection.select(
        "run", F.struct(*[c for c in projection.columns if c != "run"]).alias("cost_projection")
    )
    return (
        rollup.withColumns(
            {
                "total_items": total_items.cast("bigint"),
                "mean_tokens_per_item": mean_tokens(),
                "mean_latency_ms": F.try_divide(F.col("latency_sum"), F.col("latency_count")),
                "mean_attempts": F.try_divide(F.col("attempts_sum"), F.col("completed")),
            }
        )
        .join(token_statistics(events), "run", "left")
        .join(packed, "run", "left")
        .join(recent_items(events), "run", "left")
        .join(request_rate(events), "run", "left")
    )
