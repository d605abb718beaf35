"""Streams of events and commits: what the batch operators compute, kept up as records arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sagekeep.functions.scores import DEFAULT, ScoreConfig


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, event_type, events: counts of each day, given once the watermark has passed it."""
    return (
        events.withWatermark("occurred_at", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("occurred_at", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("day"), "event_type", "events")
    )


def bursts(events: DataFrame, delay: str = "2 days", gap: str = "24 hours") -> DataFrame:
    """memory_id, first, last, events: runs of events of a memory with less than ``gap`` between them."""
    return (
        events.filter("memory_id IS NOT NULL")
        .withWatermark("occurred_at", delay)
        .groupBy("memory_id", F.session_window("occurred_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("memory_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "events")
    )


def new_contents(commits: DataFrame, time: str = "occurred_at", delay: str = "7 days") -> DataFrame:
    """Commits whose content hash wasn't seen within the watermark."""
    return commits.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def reinforcement_trace(
    events: DataFrame, delay: timedelta = timedelta(days=2), kept: timedelta | None = None, config: ScoreConfig = DEFAULT
) -> DataFrame:
    """memory_id, trace, at_ms, multiplier: the decayed sum of a memory's events, updated with each of them.

    The state is a sum, the moment that it holds for, and the moments of the last
    ``delay``: ``sum(t2) = (sum(t1) + weight) exp(-(t2 - t1) / tau)``. An event is
    discounted by the gap to the next newer one, so an event's weight is settled
    only when no other can come between: late ones within ``delay`` of the newest
    find their place, in whatever batch they come. Those that are later still are
    added too, discounted by the gap to the oldest moment that is kept, which
    differs from the batch operator only where a settled event lay closer.
    The state of a memory is two numbers and its last moments. With ``kept``, for
    streams that run on, a memory without events for so long is forgotten.
    """
    day, tau = 86_400_000.0, config.tau_days
    behind = int(delay.total_seconds() * 1000)

    def weight(at: int, newer: int) -> float:
        return config.burst_discount if (newer - at) / 3_600_000.0 < config.cooldown_hours else 1.0

    def decay(at: int, newer: int) -> float:
        return math.exp(-(newer - at) / day / tau)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        settled, recent = state.get if state.exists else (0.0, [])
        recent = list(recent)
        came = sorted(int(t.timestamp() * 1000) for pdf in frames for t in pdf["occurred_at"])
        if recent:
            for at in (at for at in came if at < recent[0]):
                settled += weight(at, recent[0]) * decay(at, recent[0])
        moments = sorted([*recent, *(at for at in came if not recent or at >= recent[0])])
        # One moment before the border stays, as its weight hangs on what may still come behind the border.
        border = moments[-1] - behind
        while len(moments) > 1 and moments[1] < border:
            settled = (settled + weight(moments[0], moments[1])) * decay(moments[0], moments[1])
            moments.pop(0)
        state.update((settled, moments))
        if kept is not None:
            state.setTimeoutDuration(int(kept.total_seconds() * 1000))
        trace = settled
        for at, newer in pairwise(moments):
            trace = (trace + weight(at, newer)) * decay(at, newer)
        trace += 1.0
        row = {"memory_id": [key[0]], "trace": [trace], "at_ms": [moments[-1]], "multiplier": [1 + config.k * math.log1p(trace)]}
        yield pd.DataFrame(row)

    return (
        events.filter("memory_id IS NOT NULL AND occurred_at IS NOT NULL")
        .groupBy("memory_id")
        .applyInPandasWithState(
            follow,
            "memory_id string, trace double, at_ms long, multiplier double",
            "settled double, recent array<long>",
            "update",
            GroupStateTimeout.NoTimeout if kept is None else GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
