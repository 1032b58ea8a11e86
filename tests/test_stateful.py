"""Processors with state against the batch operators, on input cut in several ways."""

from __future__ import annotations

import random
import time

import pytest

from cardloom.operators import state as K
from cardloom.streaming import stateful


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, frame, folder, parts, transform, name, mode, until=None):
    """Rows of a stream whose source is the frame in `parts` files, one a batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, frame).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    source = spark.readStream.schema(frame).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}")
    query = transform(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}-check").start()
    wait = time.monotonic() + 100
    while time.monotonic() < wait and query.exception() is None and not until(spark.table(name).collect()):
        time.sleep(0.5)
    query.stop()
    assert query.exception() is None
    return spark.table(name).collect()


@pytest.mark.parametrize("cuts", [1, 4])
def test_events_that_fail_are_tried_again(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    events = [(i, i % 14, rng.choice(["result.accepted", "job.terminal_non_accepted", "other"]), rng.choice([None, "FAILED"])) for i in range(60)]
    jobs, results = [(j,) for j in range(12)], [(j, "ready" if j % 3 else "not_ready") for j in range(9)]
    e = spark.createDataFrame(events, "event_id long, job_id long, event_type string, terminal_state string")
    j, r = spark.createDataFrame(jobs, "job_id long"), spark.createDataFrame(results, "job_id long, result_status string")
    want = {x["event_id"]: (x["state"], x["job_state"], x["last_error"]) for x in K.folded_events(e, j, r).collect()}
    facts = [tuple(x) for x in stateful.facts_of(e, j, r).collect()]
    facts += [f for f in facts if f[0] == "event"][:10]  # copies change nothing
    rng.shuffle(facts)
    parts = [facts[k::cuts] for k in range(cuts)]

    def last(rows):
        found = {}
        for x in rows:
            if x["event_id"] not in found or x["tries"] >= found[x["event_id"]]["tries"]:
                found[x["event_id"]] = x
        return {k: (x["state"], x["job_state"], x["last_error"]) for k, x in found.items()}

    rows = streamed(spark, stateful.FACTS, f"{tmp_path}/facts", parts, lambda s: stateful.folded(s, 2000), f"fold{cuts}", "update", lambda rows: last(rows) == want and any(x["tries"] > cuts + 1 for x in rows))
    assert last(rows) == want and {s for s, _, _ in want.values()} == {"pending", "processed"}
    assert any(x["tries"] > cuts + 1 for x in rows)  # by the timer


def test_buffer_releases_by_count_and_by_age(spark, tmp_path):
    import datetime as dt

    at = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k)
    requests = [(k, 1, 100 + k, at(50 - k)) for k in range(7)] + [(20, 2, 120, at(1)), (21, 3, 121, at(1)), (22, 1, 999, at(60))]
    assigned = spark.createDataFrame([(n, s) for _, s, n, _ in requests if n != 999], "node_id long, taxonomy_node_id long")
    children = spark.createDataFrame([(1, 10, "A"), (2, 11, "B"), (3, 12, "Unclassified")], "scope_id long, child_id long, name string")
    run = lambda s: stateful.released(s, 3, 8000, assigned, children)
    rows = streamed(spark, "request_id long, scope_id long, node_id long, updated_at timestamp", f"{tmp_path}/requests", [requests], run, "released", "append", lambda rows: len(rows) == 8)
    own = sorted((x["turn"], x["request_id"]) for x in rows if x["scope_id"] == 1)
    assert [r for _, r in own] == [6, 5, 4, 3, 2, 1, 0]  # oldest first; the request whose card has left is dropped when its turn comes
    assert [x["request_id"] for x in rows if x["scope_id"] != 1] == [20]
