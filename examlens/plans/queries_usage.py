"""Registered queries: usage rollups and projections, as tables and as streams; cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.operators import cohorts, usage
from examlens.plans import adapters as a
from examlens.plans import adapters_runs as ar
from examlens.plans.oracle_tables import TABLES, oracle
from examlens.plans.registry import register, round_doubles
from examlens.sources import schemas
from examlens.streaming import recent_stream
from examlens.streaming import usage_stream as us

TOTAL_ITEMS = 200000


def usage_of(events: DataFrame) -> DataFrame:
    """Usage events from the event table (batch or stream)."""
    event, kind = F.col("event_id"), F.col("event_type")
    pt, ct = F.pmod(event, F.lit(700)), F.floor("value").cast("bigint")
    status = (
        F.when((kind == "error") & (F.pmod(event, F.lit(2)) == 0), 429)
        .when(kind == "error", 500)
        .when(kind != "signup", 200)
    )
    return events.select(
        F.concat(F.lit("run"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("run"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", "failure").when(kind == "signup", "skipped").otherwise("success").alias("type"),
        (F.col("value") * 10).alias("latency_ms"),
        F.pmod(event, F.lit(3)).cast("int").alias("attempts"),
        pt.alias("prompt_tokens"),
        ct.alias("completion_tokens"),
        F.when(F.pmod(event, F.lit(3)) != 0, pt + ct).alias("total_tokens"),
        F.when(F.pmod(event, F.lit(5)) != 0, (pt + ct) / 100000).alias("cost_usd_known"),
        status.cast("int").alias("status_code"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_of(a.table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = a.table(spark, sf_dir, "events")
    raw = (
        spark.readStream.schema(source.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return usage_of(raw)


TABLES["usage"] = (
    [],
    """SELECT 'run' || (user_id % 4)::VARCHAR AS run, event_id, ts,
              CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'skipped'
                   ELSE 'success' END AS type,
              value * 10 AS latency_ms, (event_id % 3)::INTEGER AS attempts,
              event_id % 700 AS prompt_tokens, floor(value)::BIGINT AS completion_tokens,
              CASE WHEN event_id % 3 <> 0 THEN event_id % 700 + floor(value)::BIGINT END AS total_tokens,
              CASE WHEN event_id % 5 <> 0
                   THEN (event_id % 700 + floor(value)::BIGINT) / 100000 END AS cost_usd_known,
              CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 429
                   WHEN event_type = 'error' THEN 500 WHEN event_type <> 'signup' THEN 200 END AS status_code,
              event_id % 700 + floor(value)::BIGINT AS tokens
       FROM events""",
)

_ROLLUP = """SELECT run, count_if(type = 'success') AS success, count_if(type = 'failure') AS failure,
        count_if(type = 'skipped') AS skipped, count(*) AS completed,
        sum(tokens)::BIGINT AS total_tokens_total, count_if(tokens > 0) AS items_with_usage,
        sum(prompt_tokens)::BIGINT AS prompt_tokens_total,
        sum(completion_tokens)::BIGINT AS completion_tokens_total,
        sum(latency_ms) AS latency_sum, count_if(latency_ms > 0) AS latency_count,
        sum(greatest(attempts, 1))::BIGINT AS attempts_sum,
        sum(cost_usd_known) AS cost_known_total,
        sum(cost_usd_known) FILTER (WHERE tokens > 0) AS cost_with_tokens_total,
        sum(tokens) FILTER (WHERE cost_usd_known IS NOT NULL)::BIGINT AS tokens_with_cost,
        sum(tokens) FILTER (WHERE cost_usd_known IS NULL)::BIGINT AS tokens_without_cost,
        count(cost_usd_known) AS items_with_cost,
        count(*) - count(cost_usd_known) AS items_without_cost,
        count_if(status_code = 429) AS throttles,
        max_by(status_code, (ts, event_id)) FILTER (WHERE status_code IS NOT NULL) AS last_status
    FROM usage GROUP BY run"""
_ROLLUP_ROUNDED = f"""SELECT * REPLACE (round(latency_sum, 4) AS latency_sum,
    round(cost_known_total, 4) AS cost_known_total,
    round(cost_with_tokens_total, 4) AS cost_with_tokens_total) FROM ({_ROLLUP})"""


@register("r1_usage_rollup", oracle(_ROLLUP_ROUNDED, "usage"))
def r1(spark, sf_dir):
    return round_doubles(usage.usage_rollup(events(spark, sf_dir)), 4)


@register("r1_usage_rollup_stream", oracle(_ROLLUP_ROUNDED, "usage"))
def r1_stream(spark, sf_dir):
    """The same rollup computed by a stream that reads everything available."""
    stream = us.streaming_rollup(event_stream(spark, sf_dir))
    return round_doubles(us.drain(stream, "update", "rollup", us.newest(["run"])), 4)


@register(
    "r2_event_tokens",
    oracle("SELECT event_id, tokens FROM usage", "usage"),
)
def r2(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", usage.total_tokens().alias("tokens"))


_LAST = """SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS rn
    FROM usage WHERE tokens > 0"""
_TOKEN_STATS = f"""SELECT run, count(*) AS token_samples, median(tokens) AS median_tokens_per_item,
        quantile_disc(tokens, 0.9)::DOUBLE AS p90_tokens_per_item
    FROM ({_LAST}) WHERE rn <= 512 GROUP BY run"""


@register("r3_token_statistics", oracle(_TOKEN_STATS, "usage"))
def r3(spark, sf_dir):
    return round_doubles(usage.token_statistics(events(spark, sf_dir)))


@register("r3_token_statistics_stream", oracle(_TOKEN_STATS, "usage"))
def r3_stream(spark, sf_dir):
    """The same statistics from the keyed state of a stream."""
    return round_doubles(recent_stream.recent_token_statistics(event_stream(spark, sf_dir), usage.TOKEN_SAMPLES))


_PROJECTION = f"""SELECT run, cost_known_total AS known_cost, p AS projected_total,
        CASE WHEN p > cost_known_total THEN greatest(cost_known_total, p - band) END AS projected_low,
        CASE WHEN p > cost_known_total THEN p + band END AS projected_high,
        cost_known_total / items_with_cost AS average_cost_per_item, items_with_cost AS samples,
        'USD' AS currency,
        CASE WHEN items_with_cost >= 50 THEN 'high' WHEN items_with_cost >= 10 THEN 'medium'
             ELSE 'low' END AS confidence
    FROM (SELECT *, greatest(p * CASE WHEN items_with_cost >= 50 THEN 0.05
                 WHEN items_with_cost >= 20 THEN 0.07 ELSE 0.1 END, 0.01) AS band
          FROM (SELECT *, cost_known_total + tokens_without_cost * ct
                       + greatest({TOTAL_ITEMS} - completed, 0) * total_tokens_total / items_with_usage * ct AS p
                FROM (SELECT *, cost_with_tokens_total / tokens_with_cost AS ct FROM ({_ROLLUP}))))"""
_PROJECTION_COLUMNS = [
    "known_cost",
    "projected_total",
    "projected_low",
    "projected_high",
    "average_cost_per_item",
]


@register(
    "r4_cost_projection",
    oracle(
        f"""SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in _PROJECTION_COLUMNS)})
            FROM ({_PROJECTION})""",
        "usage",
    ),
)
def r4(spark, sf_dir):
    rollup = usage.usage_rollup(events(spark, sf_dir))
    return round_doubles(usage.cost_projection(rollup, F.lit(TOTAL_ITEMS)), 4)


_REQUEST = """SELECT run, max(n) AS intervals,
        sum(0.2 * pow(0.8::DOUBLE, n - i) * x) + max(CASE WHEN i = 1 THEN pow(0.8::DOUBLE, n) * x END) AS request_rate_ema
    FROM (SELECT run, x, i, count(*) OVER (PARTITION BY run) AS n
          FROM (SELECT run, 1 / greatest(epoch(ts) - epoch(p), 1e-6) AS x,
                       row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS i
                FROM (SELECT *, lag(ts) OVER (PARTITION BY run ORDER BY ts, event_id) AS p FROM usage)
                WHERE p IS NOT NULL))
    GROUP BY run"""


@register(
    "r5_request_rate",
    oracle(
        f"SELECT run, intervals, round(request_rate_ema, 6) AS request_rate_ema FROM ({_REQUEST})",
        "usage",
    ),
)
def r5_request(spark, sf_dir):
    return round_doubles(usage.request_rate(events(spark, sf_dir)))


_RECENT = """SELECT run, string_agg(event_id::VARCHAR || ':' || type, ',' ORDER BY rn) AS recent
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS rn
          FROM usage) WHERE rn <= 20 GROUP BY run"""


@register(
    "r7_snapshot",
    oracle(
        f"""SELECT run, completed, {TOTAL_ITEMS}::BIGINT AS total_items,
                   round(total_tokens_total / items_with_usage, 4) AS mean_tokens_per_item,
                   median_tokens_per_item, p90_tokens_per_item,
                   round(latency_sum / latency_count, 4) AS mean_latency_ms,
                   round(attempts_sum / completed, 4) AS mean_attempts, throttles, last_status,
                   round(projected_total, 4) AS projected_total, confidence, recent,
                   round(request_rate_ema, 4) AS request_rate_ema
            FROM ({_ROLLUP}) JOIN ({_TOKEN_STATS}) USING (run) JOIN ({_PROJECTION}) USING (run)
            JOIN ({_RECENT}) USING (run) JOIN ({_REQUEST}) USING (run)""",
        "usage",
    ),
)
def r7(spark, sf_dir):
    row = usage.snapshot(events(spark, sf_dir), F.lit(TOTAL_ITEMS))
    recent = F.transform(
        "recent_items", lambda i: F.concat(i["event_id"].cast("string"), F.lit(":"), i["type"])
    )
    return round_doubles(
        row.select(
            "run",
            "completed",
            "total_items",
            "mean_tokens_per_item",
            "median_tokens_per_item",
            "p90_tokens_per_item",
            "mean_latency_ms",
            "mean_attempts",
            "throttles",
            "last_status",
            F.col("cost_projection.projected_total").alias("projected_total"),
            F.col("cost_projection.confidence").alias("confidence"),
            F.array_join(recent, ",").alias("recent"),
            "request_rate_ema",
        ),
        4,
    )


@register(
    "r8_status_counts",
    oracle(
        "SELECT run, status_code, count(*) AS events FROM usage WHERE status_code IS NOT NULL GROUP BY ALL",
        "usage",
    ),
)
def r8(spark, sf_dir):
    return (
        events(spark, sf_dir)
        .filter(F.col("status_code").isNotNull())
        .groupBy("run", "status_code")
        .agg(F.count(F.lit(1)).cast("bigint").alias("events"))
    )


@register(
    "r9_usage_events",
    oracle(
        """SELECT model AS run, type, count(*) AS n, sum(attempts)::BIGINT AS attempts,
                  count(total_tokens) AS with_tokens, count_if(correct) AS correct
           FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'failure' ELSE 'success' END AS type,
                        1 AS attempts, is_correct AS correct FROM results) GROUP BY model, type""",
        "results",
    ),
)
def r9(spark, sf_dir):
    from examlens.operators.responses import run_records

    built = usage.usage_events(run_records(ar.results(spark, sf_dir)), "model")
    return built.groupBy("run", "type").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum("attempts").cast("bigint").alias("attempts"),
        F.count("total_tokens").cast("bigint").alias("with_tokens"),
        F.count_if("correct").cast("bigint").alias("correct"),
    )


_WINDOWS = """SELECT run, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
        time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
        count(*) AS events, count_if(type = 'failure') AS failures,
        sum(tokens)::BIGINT AS tokens, round(sum(cost_usd_known), 6) AS cost_usd
    FROM usage GROUP BY ALL"""


def _text_times(frame: DataFrame) -> DataFrame:
    """Window bounds as text, independent of time-zone handling."""
    shown = {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("window_start", "window_end")}
    return round_doubles(frame.withColumns(shown))


def _text_sql(query: str) -> str:
    return f"""SELECT * REPLACE (strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end) FROM ({query})"""


@register("r10_tumbling_windows", oracle(_text_sql(_WINDOWS), "usage"))
def r10(spark, sf_dir):
    return _text_times(us.windowed_usage(events(spark, sf_dir)))


@register("r10_tumbling_windows_stream", oracle(_text_sql(_WINDOWS), "usage"))
def r10_stream(spark, sf_dir):
    """Deduplicated stream; each trigger updates its windows, so the open ones are there too."""
    stream = us.windowed_usage(us.deduplicated(event_stream(spark, sf_dir)))
    return _text_times(us.drain(stream, "update", "windows", us.newest(["run", "window_start", "window_end"])))


@register(
    "r10_sliding_windows",
    oracle(
        _text_sql(
            """SELECT run, s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS events,
                      count_if(type = 'failure') AS failures, sum(tokens)::BIGINT AS tokens,
                      round(sum(cost_usd_known), 6) AS cost_usd
               FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS s
                     FROM usage, range(0, 4) t(k)) GROUP BY ALL"""
        ),
        "usage",
    ),
)
def r10_sliding(spark, sf_dir):
    return _text_times(us.windowed_usage(events(spark, sf_dir), "1 hour", "15 minutes"))


_NEWEST = """SELECT run, event_id, rn AS position FROM (
             SELECT run, event_id, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS rn
             FROM usage) WHERE rn <= 128"""


@register("w12_last_events", oracle(_NEWEST, "usage"))
def w12(spark, sf_dir):
    return usage.last_events(events(spark, sf_dir), 128).select(
        "run", "event_id", F.col("_rank").cast("bigint").alias("position")
    )


@register("w12_last_events_stream", oracle(_NEWEST, "usage"))
def w12_stream(spark, sf_dir):
    """The newest events from bounded lists that a stream keeps per run and part."""
    return recent_stream.recent_events(event_stream(spark, sf_dir), 128).select(
        "run", "event_id", F.col("_rank").cast("bigint").alias("position")
    )


# --- cohort summaries ---------------------------------------------------------------------------

# grade records per parity of the year: (id, members); the last one is the overall record
LAYOUTS = {
    0: [("3-4", [3, 4]), ("5", [5]), ("6", [6]), ("7-8", [7, 8]), ("9", [9]), ("10", [10]), ("11-13", [11, 12, 13]), ("overall", [])],
    1: [("3", [3]), ("4", [4]), ("5-6", [5, 6]), ("7", [7]), ("8-9", [8, 9]), ("10", [10]), ("11-13", [11, 12, 13]), ("overall", [])],
}
# (parity, exam) -> positions of the records that cover it, in document order
COVER = {
    (0, "3-4"): [0], (0, "5-6"): [1, 2], (0, "7-8"): [3], (0, "9-10"): [4, 5], (0, "11-13"): [6],
    (1, "3-4"): [0, 1], (1, "5-6"): [2], (1, "7-8"): [3, 4], (1, "9-10"): [5, 4], (1, "11-13"): [6],
}


def cohort_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON cohort summary per calendar year, built from orders in eight grade records."""
    price = F.col("o_totalprice") / 1000
    bucket = F.least(F.floor(price / 100), F.lit(4)).cast("int")
    per_grade = (
        a.table(spark, sf_dir, "orders")
        .groupBy(
            F.year("o_orderdate").alias("year"),
            F.pmod(F.col("o_custkey"), F.lit(8)).cast("int").alias("g"),
        )
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.avg(price).alias("mean"),
            F.array(*[F.count_if(bucket == i) for i in range(5)]).alias("counts"),
        )
    )
    parity = F.pmod(F.col("year"), F.lit(2))

    def layout(field: int) -> Column:
        both = [F.array(*[F.lit(r[field]) if field == 0 else F.array(*[F.lit(m) for m in r[1]]).cast("array<int>") for r in LAYOUTS[p]]) for p in (0, 1)]
        return F.when(parity == 0, both[0]).otherwise(both[1])

    unreported = (F.pmod(F.col("year"), F.lit(3)) == 0) & (F.col("g") % 2 == 0)
    named = per_grade.withColumns(
        {
            "id": F.get(layout(0), F.col("g")),
            "members": F.get(layout(1), F.col("g")),
            "mean": F.when(~unreported, F.col("mean")),
        }
    )
    ordered = named.groupBy("year").agg(
        F.sort_array(F.collect_list(F.struct("g", "id", "members", "total", "mean", "counts"))).alias("r")
    )

    def mapped(field: str) -> Column:
        return F.map_from_entries(F.transform("r", lambda x: F.struct(x["id"], x[field])))

    bins = F.array(
        *[
            F.struct(
                F.struct(F.lit(100.0 * i).alias("min"), F.lit(100.0 * i + 100).alias("max")).alias("range_default"),
                F.create_map(
                    F.lit("10"),
                    F.struct(F.lit(100.0 * i + 10).alias("min"), F.lit(100.0 * i + 100).alias("max")),
                ).alias("ranges_by_grade"),
            )
            for i in range(5)
        ]
    )
    grades = F.transform(
        "r",
        lambda x: F.struct(
            x["id"].alias("id"), x["members"].alias("members"), (600.0 - 5 * x["g"]).alias("max_points")
        ),
    )
    document = F.struct(
        "year",
        grades.alias("grades"),
        mapped("total").alias("totals_by_grade"),
        mapped("mean").alias("avg_score_by_grade"),
        mapped("counts").alias("counts_by_grade"),
        bins.alias("bins"),
    )
    return ordered.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("json", schemas.COHORT)
    return cohort_documents(spark, sf_dir).select(parsed.alias("c")).select("c.*")


_IDS = ", ".join(
    f"({p}, {g}, '{r[0]}')" for p, layout in LAYOUTS.items() for g, r in enumerate(layout)
)
_COVER_SQL = ", ".join(
    f"({p}, '{exam}', {i}, {g})" for (p, exam), gs in COVER.items() for i, g in enumerate(gs)
)


def _cohort_sql(histogram: bool) -> str:
    reported = "FALSE" if histogram else "NOT (year % 3 = 0 AND g % 2 = 0)"
    return f"""SELECT year, exam, round(score, 6) AS human_score, round(mx, 6) AS human_max,
            round(100 * score / mx, 6) AS human_pct, students, human_grades_used, human_mean_source
        FROM (SELECT year, exam, sum(total * CASE WHEN reported THEN mean ELSE hist END) / sum(total) AS score,
                     avg(600.0::DOUBLE - 5 * g) AS mx, sum(total)::BIGINT AS students,
                     string_agg(id, ',' ORDER BY pos) AS human_grades_used,
                     CASE WHEN bool_and(reported) THEN 'reported' ELSE 'histogram' END AS human_mean_source
              FROM (SELECT *, {reported} AS reported FROM (
                      SELECT year, g, id, count(*) AS total, avg(price) AS mean,
                             avg(CASE WHEN id = '10' THEN 100.0::DOUBLE * b + 55 ELSE 100.0::DOUBLE * b + 50 END) AS hist
                      FROM (SELECT year(o_orderdate) AS year, o_custkey % 8 AS g,
                                   o_totalprice / 1000 AS price,
                                   least(floor(o_totalprice / 100000), 4) AS b FROM orders)
                      JOIN (VALUES {_IDS}) ids(parity, g, id) USING (g)
                      WHERE parity = year % 2 GROUP BY year, g, id))
              JOIN (VALUES {_COVER_SQL}) c(parity, exam, pos, g) USING (g)
              WHERE parity = year % 2 GROUP BY year, exam)"""


@register("a4_g29_human_scores", oracle(_cohort_sql(False)))
def g29(spark, sf_dir):
    return round_doubles(cohorts.human_scores(cohort_rows(spark, sf_dir)))


@register("g28_histogram_means", oracle(_cohort_sql(True)))
def g28(spark, sf_dir):
    return round_doubles(cohorts.human_scores(cohort_rows(spark, sf_dir), histogram_means=True))
