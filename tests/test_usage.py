"""Usage rollups, rates and windows; a stream must give what the table gives."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlens.operators import usage
from examlens.plans import queries_usage as q
from examlens.streaming import recent_stream
from examlens.streaming import usage_stream as us


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(4)
    n = 3000
    gaps = rng.exponential(2.0, n)
    start = pd.Timestamp("2025-01-01")
    frame = pd.DataFrame(
        {
            "run": rng.choice(["hot", "b"], n, p=[0.9, 0.1]),
            "event_id": np.arange(n),
            "ts": start + pd.to_timedelta(np.cumsum(gaps), unit="s"),
            "type": rng.choice(["success", "failure", "skipped"], n),
            "latency_ms": np.where(rng.uniform(size=n) < 0.1, np.nan, rng.uniform(50, 500, n)),
            "attempts": 1,
            "prompt_tokens": rng.integers(0, 50, n),
            "completion_tokens": rng.integers(0, 50, n),
            "total_tokens": rng.integers(0, 100, n),
            "cost_usd_known": np.where(rng.uniform(size=n) < 0.3, np.nan, 0.001),
        }
    )
    # real nulls, because a null cost is an unknown cost
    rows = spark.createDataFrame(frame)
    nulls = {c: F.when(~F.isnan(c), F.col(c)) for c in ("latency_ms", "cost_usd_known")}
    return frame, rows.withColumns(nulls)


def test_request_rate_equals_the_sequential_average(events):
    frame, rows = events
    got = {r.run: r for r in usage.request_rate(rows, "10 minutes").collect()}
    for run, group in frame.groupby("run"):
        seconds = group.ts.astype("int64").to_numpy() / 1e9
        average = None
        for gap in np.diff(seconds):
            rate = 1 / max(gap, 1e-6)
            average = rate if average is None else 0.8 * average + 0.2 * rate
        assert got[run].request_rate_ema == pytest.approx(average, rel=1e-4)
        assert got[run].intervals == len(group) - 1


def test_token_totals(spark):
    rows = [(None, 3, 4), (0, 3, 4), (9, 3, 4), (None, None, None)]
    frame = spark.createDataFrame(rows, "total_tokens int, prompt_tokens int, completion_tokens int")
    assert [r.t for r in frame.select(usage.total_tokens().alias("t")).collect()] == [7, 7, 9, 0]


def _rollup(spark, **values):
    base = {
        "run": "r",
        "completed": 10,
        "total_tokens_total": 1000,
        "items_with_usage": 10,
        "cost_known_total": 1.0,
        "items_with_cost": 10,
        "cost_with_tokens_total": 1.0,
        "tokens_with_cost": 500,
        "tokens_without_cost": 500,
    }
    return spark.createDataFrame(pd.DataFrame([{**base, **values}]))


def test_cost_projection(spark):
    row = usage.cost_projection(_rollup(spark), F.lit(20)).first()
    # 1.0 known + 500 tokens + 10 items x 100 tokens, at 0.002 per token
    assert row.projected_total == pytest.approx(1.0 + 1.0 + 2.0)
    assert row.projected_low == pytest.approx(3.6) and row.confidence == "medium"
    row = usage.cost_projection(
        _rollup(spark, tokens_with_cost=0, cost_with_tokens_total=0.0, items_with_cost=60), F.lit(120)
    ).first()
    assert row.projected_total == pytest.approx(2.0) and row.confidence == "medium"
    row = usage.cost_projection(
        _rollup(spark, items_with_cost=0, tokens_with_cost=0, cost_known_total=0.0, cost_with_tokens_total=0.0),
        F.lit(20),
    ).first()
    assert row.projected_total is None and row.projected_low is None and row.confidence == "low"


def test_streams_equal_tables(spark, small_dir):
    batch, stream = q.events(spark, small_dir), q.event_stream(spark, small_dir)
    rows = us.drain(us.streaming_rollup(stream), "update", "t", us.newest(["run"]))
    want = usage.usage_rollup(batch)
    assert sorted(map(tuple, q.round_doubles(rows.select(*want.columns)).collect())) == sorted(
        map(tuple, q.round_doubles(want).collect())
    )


def test_duplicates_count_once(spark, events, tmp_path):
    _, rows = events
    rows.unionByName(rows).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream = us.windowed_usage(us.deduplicated(stream), "10 minutes")
    windows = us.drain(stream, "update", "t", us.newest(["run", "window_start", "window_end"]))
    want = us.windowed_usage(rows, "10 minutes")
    pick = ["run", "window_start", "events", "tokens"]
    assert sorted(map(tuple, windows.select(pick).collect())) == sorted(map(tuple, want.select(pick).collect()))


def test_newest_events_of_a_stream_equal_the_table(spark, tmp_path):
    """Events out of order and repeated, over several triggers, one run with most of them."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        at = datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=rng.randrange(400))
        rows.append(("hot" if i % 10 else f"run{i % 7}", i, at, "success", 5 + i % 50, i % 40))
    schema = "run string, event_id long, ts timestamp, type string, prompt_tokens long, completion_tokens long"
    events = spark.createDataFrame(rows, schema).withColumn("total_tokens", F.lit(None).cast("long"))
    rng.shuffle(rows)
    for k in range(6):
        part = rows[100 * k : 100 * k + 100] + rng.sample(rows, 30)
        frame = spark.createDataFrame(part, schema).withColumn("total_tokens", F.lit(None).cast("long"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    want = usage.last_events(events, 20).collect()
    columns = ["run", "event_id", "ts", "type", "prompt_tokens", "completion_tokens", "total_tokens", "_rank"]
    for keep in (None, "1 hour"):
        got = recent_stream.recent_events(stream, 20, parts=3, keep=keep).collect()
        assert sorted([tuple(r[c] for c in columns) for r in got], key=str) == sorted([tuple(r[c] for c in columns) for r in want], key=str)
