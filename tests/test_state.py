"""State, decision and quota operators on small fixtures, against plain folds."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import decisions, layout, state, usage
from cardloom.sources import versioned


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reconcile_ticks_against_a_fold(spark):
    rng = random.Random(2)
    ticks = [(rng.choice("abc"), float(rng.randint(0, 500))) for _ in range(200)]
    got = rows(state.reconcile_ticks(spark.createDataFrame(ticks, "runner string, at double"), 40))
    want, armed = [], {}
    for who, at in sorted(ticks):
        due = who in armed and at - armed[who] >= 40
        if due or who not in armed:
            armed[who] = at
        want.append((who, at, due))
    assert got == sorted(want, key=repr)


def test_intake_and_guards_refuse(spark):
    units = spark.createDataFrame([("r1", "t", "c"), ("r2", "t", None)], "source_ref string, title string, content string")
    runs = spark.createDataFrame([(4,)], "run_id long")
    with pytest.raises(ValueError, match="every unit"):
        decisions.taken_in(units, runs, "page")
    run, taken = decisions.taken_in(units.filter("content IS NOT NULL"), runs.limit(0), "page")
    assert rows(run) == [(1, "page")] and [r["source_ref"] for r in taken.collect()] == ["r1"]
    old = spark.createDataFrame([("r2",)], "source_ref string")
    with pytest.raises(ValueError, match="r2"):
        state.guard_new(units, old, "source_ref")
    assert state.guard_new(units, old.limit(0), "source_ref") is units


def test_decisions_in_order(spark):
    proposals = spark.createDataFrame([(1, 7), (2, 8)], "proposal_id long, submitted_by long")
    actions = [(1, 1, 9, "withdraw"), (2, 1, 5, "accept"), (3, 1, 5, "reject"), (4, 1, 9, "accept"), (5, 2, 8, "withdraw"), (6, 3, 5, "accept"), (7, 3, 9, "accept"), (8, 2, 9, "reject")]
    got = decisions.decided(proposals, spark.createDataFrame(actions, "action_id long, proposal_id long, actor long, action string"), spark.createDataFrame([(5,)], "user_id long"))
    assert [x[2] for x in rows(got)] == ["not submitter", "done", "not pending", "no role", "done", "not found", "no role", "not pending"]


def test_rebuild_and_facts_are_written(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7)], "node_a_id long, node_b_id long, strength double")
    for _ in range(2):  # the second rebuild replaces the first
        state.replace_edges(edges, f"file://{tmp_path}")
    assert rows(versioned.read(spark, f"file://{tmp_path}", "adjacency").select("node_id", "edge_id")) == [(1, "1-2"), (1, "1-3"), (2, "1-2"), (3, "1-3")]
    assert rows(state.rebuild_report(edges, edges, edges.limit(1), False)) == [(2, 2, 0, 0, False)]
    calls = spark.createDataFrame([(1, 4, "success", [5, 6], "x"), (2, 4, "error", None, "x")], "event_id long, user_sub long, status string, matched array<long>, created_at string")
    for _ in range(2):
        state.append_facts(*state.search_sinks(calls), f"file://{tmp_path}/facts")
    assert spark.read.parquet(f"file://{tmp_path}/facts/usage").count() == 4 and spark.read.parquet(f"file://{tmp_path}/facts/analytics").count() == 2


def test_details_refuse_whole_requests(spark):
    asked = [(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 10), (3, 1, 99), (4, 1, None), (5, 1, 12)]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    problems, found = state.details(frame(asked, "request_id long, position long, node_id long"), frame([(10,), (11,), (12,)], "node_id long"), frame([(10, "a", 1), (11, "b", 2)], "node_id long, title string, version long"))
    assert rows(problems) == [(1, None), (2, "duplicate ids"), (3, "outside the graph"), (4, "no ids"), (5, "incomplete")]
    assert rows(found) == [(1, 1, 10, "a", 1), (1, 2, 11, "b", 2)]


def test_quota_snapshot_and_web_windows_against_folds(spark):
    rng, policy = random.Random(6), ((3, 100), (8, 1000))
    calls = [(i, rng.randint(1, 6), rng.randint(0, 3000), rng.randint(1, 2)) for i in range(300)]
    df = spark.createDataFrame(calls, "event_id long, user_sub long, s long, cost long").withColumn("created_at", F.timestamp_seconds("s"))
    states: dict = {}
    for _, user, at, cost in sorted(calls, key=lambda c: (c[2], c[0])):
        usage.quota_step(states.setdefault(user, [[0, 0.0], [0, 0.0]]), at, cost, policy)
    got = {r["user_sub"]: r for r in usage.quota_snapshot(usage.quota_replay(df, policy), 3000.0, policy).collect()}
    for user, windows in states.items():
        for name, (used, ends), (limit, seconds) in zip(("daily", "weekly"), windows, policy, strict=True):
            live = bool(used) and ends > 3000
            want = (used if live else 0, limit - (used if live else 0), ends - seconds if live else None, ends if live else None)
            assert tuple(got[user][f"{name}_{x}"] for x in ("used", "remaining", "started_at", "reset_at")) == want
    principal, address, limits = ((2, 50), (6, 500)), ((3, 50), (9, 500)), ("burst", "total")
    requests = df.select("event_id", F.col("user_sub").alias("principal"), (F.col("user_sub") % 2).alias("ip"), "created_at")
    replayed = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in usage.web_quota_replay(requests, *principal, address).collect()}
    held: dict = {}
    for i, user, at, _ in sorted(calls, key=lambda c: (c[2], c[0])):
        keys = [(("p", user, n), *w) for n, w in zip(limits, principal, strict=True)] + [(("ip", user % 2, n), *w) for n, w in zip(limits, address, strict=True)]
        assert replayed[i] == usage.web_quota_step(held, at, keys)


def test_simulation_against_pairwise_formulas():
    forces = layout.Forces(ticks=25, boundary_radius=150.0, boundary=0.3, radius=60.0)
    ids, edges = np.arange(3, 16), [(0, 1, 0.9), (1, 5, 0.2), (2, 12, 0.6)]
    at = []
    for k in range(len(ids)):
        r = 80 + 96 * math.sqrt(k + 1)
        at.append(np.array([math.cos(k * 2.399963229728653) * r, math.sin(k * 2.399963229728653) * r]))
    speed, alpha = [np.zeros(2) for _ in ids], 1.0
    pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))]
    for _ in range(25):
        alpha *= 0.001 ** (1 / 300)
        for i, j, s in edges:
            d = at[j] + speed[j] - at[i] - speed[i]
            move = d * (1 - (92 - 36 * s) / math.hypot(*d)) * alpha * (1.05 + s / 2) / 2
            speed[i], speed[j] = speed[i] + move, speed[j] - move
        for i, j in pairs:
            d = at[j] - at[i]
            move = d * -180 * alpha / max(1.0, float(d @ d))
            speed[i], speed[j] = speed[i] + move, speed[j] - move
        for i, j in pairs:
            d = at[j] + speed[j] - at[i] - speed[i]
            if math.hypot(*d) < 120:
                move = d * (120 / math.hypot(*d) - 1) * 0.92 * alpha / 2
                speed[i], speed[j] = speed[i] - move, speed[j] + move
        for i in range(len(ids)):
            speed[i] = speed[i] - at[i] * 0.1 * alpha
            if (far := math.hypot(*at[i])) > 150:
                speed[i] = speed[i] - at[i] * (1 - 150 / far) * 0.3 * alpha
            speed[i] = speed[i] * 0.55
        at = [a + v for a, v in zip(at, speed, strict=True)]
    assert layout.simulate(ids, edges, forces=forces) == pytest.approx(np.array(at), abs=2e-5)


@pytest.mark.parametrize("bad", [{"ticks": -1}, {"ticks": 1.5}, {"alpha_min": 1.0}, {"friction": 1.1}, {"charge": math.inf}, {"radius": -1.0}])
def test_force_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        layout.Forces(**bad)
