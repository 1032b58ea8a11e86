"""Stateful processors: a fold of job events that fail and are tried again, and a continuation buffer with timers.

Both keep several state variables by key with transformWithState; a session needs the RocksDB state store
(`state_store`).  Outputs are logs: the last row of an event, or of a request, is what holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An event that was dealt with is remembered so long, so that its copies change nothing.
REMEMBERED_MS = 7 * 86_400_000
RETRY_MS = 60_000


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


FACTS = "kind string, job_id long, event_id long, event_type string, terminal_state string, result_status string"


class EventFold(StatefulProcessor):
    """Facts of one job: that it exists, what its result says, and its events.

    An event is judged when it comes; one that fails stays in state with its error and is judged again when the job or its
    result changes, and by a timer until it succeeds.  Jobs come as kind `job`, results as `result`, events as `event`, in any order.
    """

    def __init__(self, retry_ms: int = RETRY_MS, remembered_ms: int = REMEMBERED_MS):
        self._retry, self._ttl = retry_ms, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._known = handle.getValueState("known", "known boolean")
        self._result = handle.getValueState("result", "result_status string")
        self._pending = handle.getMapState("pending", "event_id long", "event_type string, terminal_state string, last_error string, tries int")
        self._done = handle.getMapState("done", "event_id long", "job_state string", self._ttl)

    def _problem(self, kind: str | None, ended: str | None) -> str | None:
        if not self._known.exists():
            return "job not found"
        if kind not in ("result.accepted", "job.terminal_non_accepted"):
            return "unsupported event type"
        if kind == "result.accepted" and (not self._result.exists() or self._result.get()[0] != "ready"):
            return "result not ready"
        if kind == "job.terminal_non_accepted" and ended is None:
            return "terminal state missing"
        return None

    def _judge(self, event: int, kind: str | None, ended: str | None, tries: int) -> tuple:
        error = self._problem(kind, ended)
        if error:
            self._pending.updateValue((event,), (kind, ended, error, tries))
            return event, "pending", None, error, tries
        state = "accepted" if kind == "result.accepted" else ended
        self._done.updateValue((event,), (state,))
        if self._pending.containsKey((event,)):
            self._pending.removeKey((event,))
        return event, "processed", state, None, tries

    def _again(self) -> list[tuple]:
        waiting = [(k[0], *v) for k, v in self._pending.iterator()]
        return [self._judge(event, kind, ended, tries + 1) for event, kind, ended, _, tries in sorted(waiting)]

    def _arm(self, now: int) -> None:
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at)
        if self._pending.exists() and any(True for _ in self._pending.keys()):
            self._handle.registerTimer(now + self._retry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, changed = [], False
        batch = pd.concat(list(rows))
        for r in batch[batch["kind"] != "event"].itertuples(index=False):
            changed = True
            if r.kind == "job":
                self._known.update((True,))
            else:
                self._result.update((None if pd.isna(r.result_status) else r.result_status,))
        if changed:
            out += self._again()
        for r in batch[batch["kind"] == "event"].sort_values("event_id").itertuples(index=False):
            event = int(r.event_id)
            if not self._done.containsKey((event,)) and not self._pending.containsKey((event,)):
                out.append(self._judge(event, None if pd.isna(r.event_type) else r.event_type, None if pd.isna(r.terminal_state) else r.terminal_state, 1))
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._again()
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["event_id", "state", "job_state", "last_error", "tries"])

    def close(self) -> None:
        pass


def folded(facts: DataFrame, retry_ms: int = RETRY_MS) -> DataFrame:
    """The log (event_id, state, job_state, last_error, tries) of a stream of facts (see FACTS)."""
    return facts.groupBy("job_id").transformWithStateInPandas(EventFold(retry_ms), "event_id long, state string, job_state string, last_error string, tries int", "Update", "ProcessingTime")


def facts_of(events: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The facts of events (event_id, job_id, event_type, terminal_state), jobs (job_id) and results (job_id, result_status)."""
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    e = events.select(F.lit("event").alias("kind"), "job_id", "event_id", "event_type", "terminal_state", none("result_status"))
    j = jobs.select(F.lit("job").alias("kind"), "job_id", none("event_id", "long"), none("event_type"), none("terminal_state"), none("result_status"))
    r = results.select(F.lit("result").alias("kind"), "job_id", none("event_id", "long"), none("event_type"), none("terminal_state"), "result_status")
    return e.unionByName(j).unionByName(r)


class Buffer(StatefulProcessor):
    """Continuation requests of one scope: released, oldest first, `batch` at a time, and all that wait once the oldest is interval_ms old."""

    def __init__(self, batch: int, interval_ms: int):
        self._batch, self._interval = batch, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getMapState("held", "request_id long", "node_id long, updated_at timestamp, came_ms long")
        self._released = handle.getValueState("released", "n long")

    def _release(self, now: int, due: bool) -> pd.DataFrame:
        held = sorted(((v[1], k[0], v[0], v[2]) for k, v in self._held.iterator()), key=lambda x: (x[0], x[1]))
        old = due or any(now - x[3] >= self._interval for x in held)
        n = len(held) if old else len(held) // self._batch * self._batch
        for x in held[:n]:
            self._held.removeKey((x[1],))
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at)
        if held[n:]:
            self._handle.registerTimer(min(x[3] for x in held[n:]) + self._interval)
        before = self._released.get()[0] if self._released.exists() else 0
        self._released.update((before + n,))
        return pd.DataFrame([(x[1], x[2], x[0], before + k + 1) for k, x in enumerate(held[:n])], columns=["request_id", "node_id", "updated_at", "turn"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for r in batch.itertuples(index=False):
                known = self._held.getValue((int(r.request_id),)) if self._held.containsKey((int(r.request_id),)) else None
                self._held.updateValue((int(r.request_id),), (int(r.node_id), r.updated_at.to_pydatetime(), known[2] if known else now))
        yield self._release(now, False).assign(scope_id=key[0])[["scope_id", "request_id", "node_id", "updated_at", "turn"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._release(timerValues.getCurrentProcessingTimeInMs(), True).assign(scope_id=key[0])[["scope_id", "request_id", "node_id", "updated_at", "turn"]]

    def close(self) -> None:
        pass


def released(requests: DataFrame, batch: int, interval_ms: int, assigned: DataFrame, children: DataFrame) -> DataFrame:
    """Requests (scope_id, request_id, node_id, updated_at, turn) as their scopes' buffers let them go, without those whose card has left the scope or whose scope has no child but Unclassified."""
    rows = requests.select("scope_id", "request_id", "node_id", "updated_at").groupBy("scope_id")
    out = rows.transformWithStateInPandas(Buffer(batch, interval_ms), "scope_id long, request_id long, node_id long, updated_at timestamp, turn long", "Append", "ProcessingTime")
    out = out.join(assigned.select("node_id", F.col("taxonomy_node_id").alias("scope_id")).distinct(), ["scope_id", "node_id"], "left_semi")
    return out.join(children.filter("name <> 'Unclassified'").select("scope_id").distinct(), "scope_id", "left_semi")
