"""Streaming forms: idempotent intake, continuation buffers and quota decisions.

State keeps the meaning of the batch operators; late rows are dropped past the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cardloom.operators.usage import POLICY, quota_step

DELAY = "10 minutes"


def unique_events(events: DataFrame, key: str = "event_id", time: str = "occurred_at", delay: str = DELAY) -> DataFrame:
    """Each event once: a replay within the watermark is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_usage(events: DataFrame, window: str = "1 day", delay: str = DELAY) -> DataFrame:
    """(window_start, user_sub, searches): successes of each user by tumbling window."""
    grouped = events.filter("status = 'success'").withWatermark("created_at", delay).groupBy(F.window("created_at", window), "user_sub")
    return grouped.agg(F.count("*").alias("searches")).select(F.col("window.start").alias("window_start"), "user_sub", "searches")


def sessions(searches: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """(session_start, user_sub, searches): runs of searches no further apart than `gap`."""
    grouped = searches.withWatermark("created_at", delay).groupBy(F.session_window("created_at", gap), "user_sub")
    return grouped.agg(F.count("*").alias("searches")).select(F.col("session_window.start").alias("session_start"), "user_sub", "searches")


def quota_decisions(calls: DataFrame, policy=POLICY) -> DataFrame:
    """(event_id, user_sub, allowed, retry_after) for calls (event_id, user_sub, at, cost), `at` in seconds; windows live in the state."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = list(state.get) if state.exists else [0.0] * (2 * len(policy))
        windows = [[flat[2 * i], flat[2 * i + 1]] for i in range(len(policy))]
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for row in rows.itertuples(index=False):
            allowed, wait, _ = quota_step(windows, row.at, int(row.cost), policy)
            out.append((row.event_id, key[0], allowed, float(wait)))
        state.update(tuple(float(v) for w in windows for v in w))
        yield pd.DataFrame(out, columns=["event_id", "user_sub", "allowed", "retry_after"])

    schema = ", ".join(f"used{i} double, ends{i} double" for i in range(len(policy)))
    return calls.groupBy("user_sub").applyInPandasWithState(decide, "event_id long, user_sub long, allowed boolean, retry_after double", schema, "append", GroupStateTimeout.NoTimeout)


def continuation_buffer(requests: DataFrame, batch: int, interval_ms: int) -> DataFrame:
    """(scope_id, n): releases of each scope's buffered requests once `batch` wait or the oldest is interval_ms old."""

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since = state.get if state.exists else (0, 0)
        now = state.getCurrentProcessingTimeMs()
        added = 0 if state.hasTimedOut else sum(len(b) for b in batches)
        since = since if held else now
        held += added
        if held >= batch or (held and now - since >= interval_ms):
            state.remove()
            yield pd.DataFrame({"scope_id": [key[0]], "n": [held]})
        elif held:
            state.update((held, since))
            state.setTimeoutDuration(max(1, interval_ms - (now - since)))

    return requests.groupBy("scope_id").applyInPandasWithState(hold, "scope_id long, n long", "held long, since long", "append", GroupStateTimeout.ProcessingTimeTimeout)
