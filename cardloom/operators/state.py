"""Queues, freshness and rebuilds: what the polling services decide at each tick, as joins over their tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.workflow import TERMINAL
from cardloom.sources import versioned


def folded_events(events: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(event_id, state, job_state, last_error): pending events (event_id, job_id, event_type, terminal_state) after one pass.

    jobs are (job_id), results (job_id, result_status).  An event that fails stays pending with its error and holds up no other.
    """
    known, ready = jobs.select("job_id", F.lit(True).alias("_known")).distinct(), results.select("job_id", "result_status")
    rows = events.join(known, "job_id", "left").join(ready, "job_id", "left")
    accepted = F.col("event_type") == "result.accepted"
    error = (
        F.when(F.col("_known").isNull(), "job not found")
        .when(~F.col("event_type").isin("result.accepted", "job.terminal_non_accepted"), "unsupported event type")
        .when(accepted & ~F.col("result_status").eqNullSafe("ready"), "result not ready")
        .when(~accepted & F.col("terminal_state").isNull(), "terminal state missing")
    )
    done = F.when(error.isNull(), F.when(accepted, "accepted").otherwise(F.col("terminal_state")))
    return rows.select("event_id", F.when(error.isNull(), "processed").otherwise("pending").alias("state"), done.alias("job_state"), error.alias("last_error"))


def reconciled(jobs: DataFrame, items: DataFrame, batch: int) -> DataFrame:
    """(id, outcome, terminal_state): the oldest `batch` open jobs (id, job_id, terminal_state, processed_at) against what the queue says of them (job_id, status, state)."""
    open_ = jobs.filter("processed_at IS NULL AND terminal_state IS NULL AND job_id IS NOT NULL").orderBy("id").limit(batch).select("id", "job_id")
    rows = open_.join(items, "job_id", "left")
    ended = (F.col("status") == "not_ready") & F.col("state").isin(*TERMINAL)
    outcome = F.when(F.col("status") == "ready", "accepted").when(ended, "terminal").when(F.col("status") == "not_ready", "waiting").otherwise("not found")
    return rows.select("id", outcome.alias("outcome"), F.when(ended, F.col("state")).alias("terminal_state"))


def reconcile_ticks(ticks: DataFrame, interval_s: float) -> DataFrame:
    """(runner, at, runs): which ticks (runner, at in seconds) reconcile.  The first arms the timer; a run starts it anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner, armed = None, 0.0
        for batch in batches:
            out = []
            for who, at in zip(batch["runner"].tolist(), batch["at"].tolist(), strict=True):
                first = who != runner
                due = not first and at - armed >= interval_s
                if first or due:
                    runner, armed = who, at
                out.append(due)
            yield batch.assign(runs=out)

    return ticks.select("runner", "at").repartition("runner").sortWithinPartitions("runner", "at").mapInPandas(run, "runner string, at double, runs boolean")


def queued(state: DataFrame, dirty: DataFrame) -> DataFrame:
    """Refresh requests (scope_id, created_at, updated_at) after dirty scopes (scope_id, at): one a scope, its creation kept."""
    new = dirty.groupBy("scope_id").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    rows = state.join(new, "scope_id", "full_outer")
    return rows.select("scope_id", F.coalesce("created_at", "_first").alias("created_at"), F.greatest("updated_at", "_last").alias("updated_at"))


def oldest(requests: DataFrame, n: int, *order: str) -> DataFrame:
    """The n oldest requests: what one poll takes."""
    return requests.orderBy(*order).limit(n)


def claimed(requests: DataFrame, n: int) -> DataFrame:
    """requests (id, status, attempt_count, requested_at) after the n oldest pending ones are claimed."""
    taken = oldest(requests.filter("status = 'pending'"), n, "requested_at", "id").select("id", F.lit(1).alias("_taken"))
    rows = requests.join(taken, "id", "left")
    return rows.select("id", F.when(F.col("_taken") == 1, "running").otherwise(F.col("status")).alias("status"), (F.col("attempt_count") + F.coalesce("_taken", F.lit(0))).alias("attempt_count"), "requested_at")


def counted(rows: DataFrame, limit: int) -> DataFrame:
    """(n): how many rows a limited read would give."""
    return rows.limit(limit).groupBy().agg(F.count("*").alias("n"))


def without_active_job(assigned: DataFrame, jobs: DataFrame) -> DataFrame:
    """Cards (scope_id, node_id) with no open job (scope_id, node_id, terminal_state, processed_at) of their scope."""
    return assigned.join(jobs.filter("processed_at IS NULL AND terminal_state IS NULL"), ["scope_id", "node_id"], "left_anti")


def linked(assigned: DataFrame, jobs: DataFrame) -> DataFrame:
    """(scope_id, linked): cards whose open job is already sent, counted once each."""
    sent = jobs.filter("processed_at IS NULL AND terminal_state IS NULL AND job_id IS NOT NULL")
    return assigned.join(sent, ["scope_id", "node_id"], "left_semi").groupBy("scope_id").agg(F.count_distinct("node_id").alias("linked"))


def overlap(units: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys of units that exist already."""
    return units.select(key).distinct().join(existing, key, "left_semi")


def guard_new(units: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """units, or ValueError if some exist already."""
    some = [r[0] for r in overlap(units, existing, key).limit(3).collect()]
    if some:
        raise ValueError(f"already present: {some}")
    return units


def promoted(assigned: DataFrame, tree: DataFrame, name: str = "Unclassified") -> DataFrame:
    """Assignments (node_id, taxonomy_node_id) with those on a node of this name moved to its parent. tree: (id, parent_id, name)."""
    legacy = tree.filter((F.col("name") == name) & F.col("parent_id").isNotNull()).select(F.col("id").alias("taxonomy_node_id"), "parent_id")
    return assigned.join(legacy, "taxonomy_node_id", "left").select("node_id", F.coalesce("parent_id", "taxonomy_node_id").alias("taxonomy_node_id"))


def freshness(scopes: DataFrame, cached: DataFrame, stored: DataFrame) -> DataFrame:
    """(scope_id, status, requested): layouts against the fingerprints of their inputs; all three are (scope_id, fingerprint).

    A cached layout is looked at before a stored one; another fingerprint is shown while it is refreshed, none is not ready.
    """
    have = lambda df, name: df.select("scope_id", F.col("fingerprint").alias(name))
    rows = scopes.join(have(cached, "_c"), "scope_id", "left").join(have(stored, "_s"), "scope_id", "left")
    shown = F.coalesce("_c", "_s")
    status = F.when(shown.isNull(), "not_ready").when(shown == F.col("fingerprint"), "ready").otherwise("refreshing")
    return rows.select("scope_id", status.alias("status"), (status != "ready").alias("requested"))


def details(requests: DataFrame, graph: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, problem) of every request, and the rows (request_id, position, node_id, title, version) of those without one.

    requests are (request_id, position, node_id), a null node_id standing for an empty request; graph (node_id) is the
    active graph, cards (node_id, title, version) the active cards.  A request is refused whole: without ids, with an id twice, with
    one outside the graph, or with one that has no card.
    """
    inside, card = graph.select("node_id", F.lit(True).alias("_in")).distinct(), cards.select("node_id", "title", "version")
    rows = requests.join(inside, "node_id", "left").join(card, "node_id", "left")
    seen = rows.groupBy("request_id").agg(F.count("node_id").alias("n"), F.count_distinct("node_id").alias("d"), F.count("_in").alias("i"), F.count("version").alias("c"))
    problem = F.when(F.col("n") == 0, "no ids").when(F.col("d") < F.col("n"), "duplicate ids").when(F.col("i") < F.col("n"), "outside the graph").when(F.col("c") < F.col("n"), "incomplete")
    judged = seen.select("request_id", problem.alias("problem"))
    good = rows.join(judged.filter("problem IS NULL").select("request_id"), "request_id", "left_semi")
    return judged, good.select("request_id", "position", "node_id", "title", "version")


def rebuild_report(nodes: DataFrame, planned: DataFrame, existing: DataFrame, apply: bool) -> DataFrame:
    """One row of a rebuild: node_count, planned_edge_count, inserted_edge_count, removed_edge_count, applied.  A dry run inserts and removes nothing."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    joined = n(nodes, "node_count").join(n(planned, "planned_edge_count")).join(n(existing, "_old"))  # three rows of one number each
    some = F.lit(apply)
    return joined.select("node_count", "planned_edge_count", F.when(some, F.col("planned_edge_count")).otherwise(0).alias("inserted_edge_count"), F.when(some, F.col("_old")).otherwise(0).alias("removed_edge_count"), some.alias("applied"))


def replace_edges(planned: DataFrame, path: str) -> versioned.Version:
    """Publish planned edges (node_a_id, node_b_id, strength) as `edges` and their adjacency (node_id, edge_id) as `adjacency`, both in one version in place of the last."""
    named = planned.withColumn("edge_id", F.concat_ws("-", F.col("node_a_id").cast("string"), F.col("node_b_id").cast("string")))
    ends = planned.select(F.explode(F.array("node_a_id", "node_b_id")).alias("node_id"), F.concat_ws("-", F.col("node_a_id").cast("string"), F.col("node_b_id").cast("string")).alias("edge_id"))
    return versioned.publish(path, {"edges": named, "adjacency": ends})


def without_scopes(projection: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """A projection (scope_id, ...) after these scopes, or all, are deleted."""
    return projection.limit(0) if scopes is None else projection.join(scopes, "scope_id", "left_anti")


def search_sinks(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the usage ledger (every call) and of search analytics (successes only) of calls (event_id, user_sub, status, matched array, created_at)."""
    error = F.when(F.col("status") == "error", "search_failed").when(F.col("status") == "quota_rejected", "quota_exceeded")
    matched = F.when(F.col("status") == "success", F.size("matched")).otherwise(0)
    ledger = calls.select("event_id", "user_sub", "status", error.alias("error_code"), matched.cast("long").alias("matched_count"), F.lit(1).cast("long").alias("cost_units"), "created_at")
    shown = F.transform("matched", lambda x, i: F.struct(x.alias("node_id"), (i + 1).cast("long").alias("rank")))
    return ledger, calls.filter("status = 'success'").select("event_id", "user_sub", shown.alias("matched_results"), "created_at")


def append_facts(ledger: DataFrame, analytics: DataFrame, path: str) -> None:
    """Append both kinds of facts to path/usage and path/analytics."""
    ledger.write.mode("append").parquet(f"{path}/usage")
    analytics.write.mode("append").parquet(f"{path}/analytics")


def submission_totals(preflight: DataFrame, granted: DataFrame) -> DataFrame:
    """One row: submitted, already_active and skipped cards over all scopes. preflight: (scope_id, cards, active), granted: (scope_id, granted)."""
    rows = preflight.join(granted, "scope_id")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    return rows.agg(total(F.col("granted"), "submitted"), total(F.col("active"), "already_active"), total(F.col("cards") - F.col("active") - F.col("granted"), "skipped"))
