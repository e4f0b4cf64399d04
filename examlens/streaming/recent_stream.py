"""The newest events of every run as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from examlens.operators.usage import last_events, token_statistics_of, total_tokens
from examlens.streaming.usage_stream import drain

#: Parts that a run's events are spread over.
PARTS = 8
LISTS = "ts array<bigint>, event_id array<bigint>, payload array<string>"


def recent_by_part(events: DataFrame, n: int, parts: int = PARTS, keep: str | None = None) -> DataFrame:
    """``run, part`` and the part's newest n events as three lists, emitted whenever they change.

    A part holds those of a run's events whose id hashes to it, so that one busy run is the work
    of several tasks. Its state is the list of its newest n events in (ts, event_id) order: an event
    that comes twice is known by its key or is older than the list, an event that comes late finds
    its place. State is bounded by n per part. With ``keep``, an interval, events that are later than
    that are left out, and a part whose newest event is older than that loses its state (what it
    emitted stays). All other columns travel as JSON.
    """
    events = events.withWatermark("ts", keep) if keep else events
    others = [c for c in events.columns if c not in ("run", "ts", "event_id")]
    keyed = events.select(
        "run",
        F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int").alias("part"),
        *(["ts"] if keep else []),
        F.unix_micros("ts").alias("micros"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.to_json(F.struct(*others)).alias("payload"),
    )

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[tuple[int, int], str] = {}
        if state.exists:
            times, ids, payloads = state.get
            known = dict(zip(zip(times, ids), payloads))
        before = set(known)
        for frame in frames:
            known.update(zip(zip(frame["micros"].tolist(), frame["event_id"].tolist()), frame["payload"].tolist()))
            if len(known) > n:
                known = {k: known[k] for k in sorted(known)[-n:]}
        if keep:
            state.setTimeoutTimestamp(max(max(known)[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if set(known) == before:
            return
        order = sorted(known)
        lists = [t for t, _ in order], [i for _, i in order], [known[k] for k in order]
        state.update(lists)
        yield pd.DataFrame({"run": [key[0]], "part": [key[1]], "ts": [lists[0]], "event_id": [lists[1]], "payload": [lists[2]]})

    return keyed.groupBy("run", "part").applyInPandasWithState(
        update,
        f"run string, part int, {LISTS}",
        LISTS,
        "update",
        GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout,
    )


def recent_events(events: DataFrame, n: int, parts: int = PARTS, keep: str | None = None) -> DataFrame:
    """The newest n events of each run of a stream, after everything available has been read.

    The parts' lists, at most n events each, are put together by the operator that also serves tables.
    """
    others = [f for f in events.schema if f.name not in ("run", "ts", "event_id")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def merged(table: DataFrame) -> DataFrame:
        rows = table.select("run", F.inline(F.arrays_zip("ts", "event_id", "payload")))
        once = rows.groupBy("run", "ts", "event_id").agg(F.max("payload").alias("payload"))
        opened = once.select(
            "run", "event_id", F.timestamp_micros("ts").alias("ts"), F.from_json("payload", kinds).alias("_others")
        ).select("run", "event_id", "ts", "_others.*")
        return last_events(opened, n)

    return drain(recent_by_part(events, n, parts, keep), "update", "recent", merged)


def recent_token_statistics(events: DataFrame, samples: int, parts: int = PARTS) -> DataFrame:
    """Token statistics of the newest events that used tokens, from the stream's state."""
    used = events.withColumn("_tokens", total_tokens()).filter(F.col("_tokens") > 0)
    return token_statistics_of(recent_events(used, samples, parts))
