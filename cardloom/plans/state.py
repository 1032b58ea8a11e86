"""Queries over queues, freshness, rebuilds and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import state as Z
from cardloom.plans import graph, workflow
from cardloom.sources import tables as D

BATCH = 100


def event_fold(spark, sf):
    """Events against jobs of the customers; the 5th, 7th and 9th kinds of events fail in their ways."""
    e = D.table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "job.unknown").when(F.col("event_id") % 3 == 0, "job.terminal_non_accepted").otherwise("result.accepted")
    events = e.select("event_id", F.col("user_id").alias("job_id"), kind.alias("event_type"), F.when(F.col("event_id") % 9 != 0, "FAILED").alias("terminal_state"))
    jobs = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id")).filter("job_id % 5 <> 0")
    return Z.folded_events(events, jobs, jobs.select("job_id", F.when(F.col("job_id") % 4 == 0, "not_ready").otherwise("ready").alias("result_status")))


def _queue_jobs(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("job_id"), F.when(F.col("o_orderstatus") == "F", "DONE").alias("terminal_state"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("processed_at"))


def reconcile_jobs(spark, sf):
    k = F.col("c_custkey") % 5
    items = D.table(spark, sf, "customer").filter("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("job_id"), F.when(k == 0, "ready").when(k == 1, "not_found").otherwise("not_ready").alias("status"), F.when(k == 2, "EXPIRED").otherwise("RUNNING").alias("state"))
    return Z.reconciled(_queue_jobs(spark, sf), items, BATCH)


def reconcile_ticks(spark, sf):
    ticks = D.table(spark, sf, "events").select(F.col("event_type").alias("runner"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return Z.reconcile_ticks(ticks, 6 * 3600)


def dirty_scopes(spark, sf):
    """Orders' customers as scopes; those of an urgent order are queued already."""
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("scope_id"), F.col("o_orderdate").alias("at"), "o_orderpriority")
    old = o.filter("o_orderpriority = '1-URGENT'").groupBy("scope_id").agg(F.min("at").alias("created_at"), F.min("at").alias("updated_at"))
    return Z.oldest(Z.queued(old, o.select("scope_id", "at")), BATCH, "updated_at", "scope_id")


def claimed_requests(spark, sf):
    o = D.table(spark, sf, "orders")
    return Z.claimed(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("succeeded").alias("status"), (F.col("o_orderkey") % 3).alias("attempt_count"), F.col("o_orderdate").alias("requested_at")), BATCH)


def limited_job_count(spark, sf):
    return Z.counted(_queue_jobs(spark, sf).filter("processed_at IS NULL AND job_id IS NULL"), BATCH)


def _assigned(spark, sf):
    return D.assignments(spark, sf).withColumnRenamed("taxonomy_node_id", "scope_id")


def _scope_jobs(spark, sf):
    return workflow._jobs(spark, sf).join(_assigned(spark, sf), "node_id").withColumn("processed_at", F.when(F.col("node_id") % 8 == 0, F.lit("1998-01-01")))


def cards_without_job(spark, sf):
    return Z.without_active_job(_assigned(spark, sf), _scope_jobs(spark, sf)).select("scope_id", "node_id")


def linked_cards(spark, sf):
    return Z.linked(_assigned(spark, sf), _scope_jobs(spark, sf))


def existing_refs(spark, sf):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    return Z.overlap(docs.select("doc_id"), labels.select("doc_id"), "doc_id")


def legacy_promotion(spark, sf):
    """Every region gets a child called Unclassified that holds the cards of every tenth customer."""
    own = D.assignments(spark, sf)
    moved = own.select("node_id", F.when(F.col("taxonomy_node_id").between(2, 99), F.col("taxonomy_node_id") + 1000).otherwise(F.col("taxonomy_node_id")).alias("taxonomy_node_id"))
    tree = D.taxonomy_nodes(spark, sf).select("id", "parent_id", "name")
    legacy = tree.filter("id BETWEEN 2 AND 99").select((F.col("id") + 1000).alias("id"), F.col("id").alias("parent_id"), F.lit("Unclassified").alias("name"))
    return Z.promoted(moved, tree.union(legacy))


def layout_freshness(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("scope_id"), F.col("p_name").alias("fingerprint"))
    old = lambda step: F.when(F.col("scope_id") % step == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint")
    return Z.freshness(p, p.filter("scope_id % 3 = 0").select("scope_id", old(2)), p.filter("scope_id % 5 <> 0").select("scope_id", old(7)))


def _details(spark, sf):
    lines, parts = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    asked = lines.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("long").alias("position"), F.when(F.col("l_orderkey") % 19 != 0, F.col("l_partkey")).alias("node_id"))
    graph_nodes = parts.filter("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("node_id"))
    cards = parts.filter("p_size <> 7").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("version"))
    return Z.details(asked, graph_nodes, cards)


def detail_requests(spark, sf):
    return _details(spark, sf)[0]


def card_details(spark, sf):
    return _details(spark, sf)[1]


def edge_rebuild_report(spark, sf):
    edges = graph._edges(spark, sf)
    return Z.rebuild_report(D.card_vectors(spark, sf), edges, edges.filter("node_a_id % 2 = 0"), apply=True)


def projection_delete(spark, sf):
    own = _assigned(spark, sf)
    return Z.without_scopes(own, D.taxonomy_nodes(spark, sf).filter("parent_id = 2").select(F.col("id").alias("scope_id"))).select("scope_id", "node_id")


def _calls(spark, sf):
    matched = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.col("event_id") % 100 + i)
    return D.usage_events(spark, sf).select("event_id", "user_sub", "status", matched.alias("matched"), "created_at")


def usage_ledger(spark, sf):
    return Z.search_sinks(_calls(spark, sf))[0].drop("created_at")


def search_analytics(spark, sf):
    rows = Z.search_sinks(_calls(spark, sf))[1]
    return rows.select("event_id", F.explode("matched_results").alias("r")).select("event_id", "r.node_id", "r.rank")


def submission_summary(spark, sf):
    return Z.submission_totals(workflow._preflight(spark, sf), workflow.submission_allocation(spark, sf))


QUERIES = {f.__name__: f for f in (event_fold, reconcile_jobs, reconcile_ticks, dirty_scopes, claimed_requests, limited_job_count, cards_without_job, linked_cards, existing_refs, legacy_promotion, layout_freshness, detail_requests, card_details, edge_rebuild_report, projection_delete, usage_ledger, search_analytics, submission_summary)}

_JOBS = "jobs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'DONE' END AS terminal_state, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS processed_at FROM orders)"
_OPEN = f"""{D.with_views("assigned")}, jk AS (SELECT o_custkey + 1 AS node_id, max(o_orderkey) AS k FROM orders GROUP BY 1), open AS (SELECT node_id, k % 3 <> 0 AS sent FROM jk WHERE k % 4 <> 0 AND node_id % 8 <> 0)"""
_ASKED = """asked AS (SELECT l_orderkey AS request_id, l_linenumber::BIGINT AS position, CASE WHEN l_orderkey % 19 <> 0 THEN l_partkey END AS node_id FROM lineitem),
  j AS (SELECT asked.*, p_name AS title, CASE WHEN p_size <> 7 THEN p_size END AS version FROM asked LEFT JOIN part ON p_partkey = node_id),
  r AS (SELECT request_id, CASE WHEN count(node_id) = 0 THEN 'no ids' WHEN count(DISTINCT node_id) < count(node_id) THEN 'duplicate ids' WHEN count(*) FILTER (node_id % 17 = 0) > 0 THEN 'outside the graph' WHEN count(version) < count(node_id) THEN 'incomplete' END AS problem FROM j GROUP BY 1)"""
SQL = {
    "reconcile_ticks": """WITH RECURSIVE r AS (SELECT event_type AS runner, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
      f AS (SELECT runner, t, i, t AS armed, false AS runs FROM r WHERE i = 1
        UNION ALL SELECT r.runner, r.t, r.i, CASE WHEN r.t - armed >= 21600 THEN r.t ELSE armed END, r.t - armed >= 21600 FROM f JOIN r ON r.runner = f.runner AND r.i = f.i + 1)
      SELECT runner, t AS "at", runs FROM f""",
    "event_fold": """WITH e AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 3 = 0 THEN 'ended' ELSE 'accepted' END AS kind, user_id % 5 <> 0 AND user_id IN (SELECT c_custkey FROM customer) AS known FROM events),
      p AS (SELECT *, CASE WHEN NOT known THEN 'job not found' WHEN kind = 'x' THEN 'unsupported event type' WHEN kind = 'accepted' AND user_id % 4 = 0 THEN 'result not ready' WHEN kind = 'ended' AND event_id % 9 = 0 THEN 'terminal state missing' END AS last_error FROM e)
      SELECT event_id, CASE WHEN last_error IS NULL THEN 'processed' ELSE 'pending' END AS state, CASE WHEN last_error IS NULL THEN CASE kind WHEN 'accepted' THEN 'accepted' ELSE 'FAILED' END END AS job_state, last_error FROM p""",
    "reconcile_jobs": f"""WITH {_JOBS}, o AS (SELECT id, job_id FROM jobs WHERE terminal_state IS NULL AND processed_at IS NULL AND job_id IS NOT NULL ORDER BY id LIMIT {BATCH})
      SELECT id, CASE WHEN job_id % 6 = 0 OR job_id % 5 = 1 THEN 'not found' WHEN job_id % 5 = 0 THEN 'accepted' WHEN job_id % 5 = 2 THEN 'terminal' ELSE 'waiting' END AS outcome, CASE WHEN job_id % 6 <> 0 AND job_id % 5 = 2 THEN 'EXPIRED' END AS terminal_state FROM o""",
    "dirty_scopes": f"""SELECT o_custkey AS scope_id, coalesce(min(o_orderdate) FILTER (o_orderpriority = '1-URGENT'), min(o_orderdate)) AS created_at, max(o_orderdate) AS updated_at FROM orders GROUP BY 1 ORDER BY updated_at, scope_id LIMIT {BATCH}""",
    "claimed_requests": f"""WITH r AS (SELECT o_orderkey AS id, o_orderstatus = 'O' AS p, o_orderkey % 3 AS attempt_count, o_orderdate AS requested_at FROM orders), t AS (SELECT id FROM r WHERE p ORDER BY requested_at, id LIMIT {BATCH})
      SELECT id, CASE WHEN id IN (FROM t) THEN 'running' WHEN p THEN 'pending' ELSE 'succeeded' END AS status, attempt_count + (id IN (FROM t))::INT AS attempt_count, requested_at FROM r""",
    "limited_job_count": f"WITH {_JOBS} SELECT least({BATCH}, count(*)) AS n FROM jobs WHERE processed_at IS NULL AND job_id IS NULL",
    "cards_without_job": f"{_OPEN} SELECT taxonomy_node_id AS scope_id, node_id FROM assigned WHERE node_id NOT IN (SELECT node_id FROM open)",
    "linked_cards": f"{_OPEN} SELECT taxonomy_node_id AS scope_id, count(DISTINCT node_id) AS linked FROM assigned WHERE node_id IN (SELECT node_id FROM open WHERE sent) GROUP BY 1",
    "existing_refs": "SELECT DISTINCT doc_id FROM documents SEMI JOIN labels USING (doc_id)",
    "legacy_promotion": f"{D.with_views('assigned')} SELECT node_id, taxonomy_node_id FROM assigned",
    "layout_freshness": """WITH s AS (SELECT p_partkey AS scope_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 = 0 END AS same FROM part)
      SELECT scope_id, CASE WHEN same IS NULL THEN 'not_ready' WHEN same THEN 'ready' ELSE 'refreshing' END AS status, same IS NULL OR NOT same AS requested FROM s""",
    "detail_requests": f"WITH {_ASKED} SELECT request_id, problem FROM r",
    "card_details": f"WITH {_ASKED} SELECT request_id, position, node_id, title, version::BIGINT AS version FROM j SEMI JOIN (SELECT request_id FROM r WHERE problem IS NULL) USING (request_id)",
    "edge_rebuild_report": f"{D.with_views('cards', 'edges')} SELECT (SELECT count(*) FROM cards) AS node_count, count(*) AS planned_edge_count, count(*) AS inserted_edge_count, count(*) FILTER (node_a_id % 2 = 0) AS removed_edge_count, true AS applied FROM edges",
    "projection_delete": f"{D.with_views('tree', 'assigned')} SELECT taxonomy_node_id AS scope_id, node_id FROM assigned WHERE taxonomy_node_id NOT IN (SELECT id FROM tree WHERE parent_id = 2)",
    "usage_ledger": f"{D.with_views('usage')} SELECT event_id, user_sub, status, CASE status WHEN 'error' THEN 'search_failed' WHEN 'quota_rejected' THEN 'quota_exceeded' END AS error_code, CASE WHEN status = 'success' THEN 3 ELSE 0 END::BIGINT AS matched_count, 1::BIGINT AS cost_units FROM usage",
    "search_analytics": f"{D.with_views('usage')} SELECT event_id, event_id % 100 + i AS node_id, i AS rank FROM usage, (SELECT unnest([1, 2, 3]::BIGINT[]) AS i) WHERE status = 'success'",
    "submission_summary": f"""{workflow._PRE}, b AS (SELECT *, cards - active AS waiting, coalesce(sum(cards - active) OVER (ORDER BY path, scope_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pre), g AS (SELECT *, greatest(0, least(waiting, {workflow.LIMIT} - before)) AS granted FROM b)
      SELECT sum(granted)::BIGINT AS submitted, sum(active)::BIGINT AS already_active, sum(waiting - granted)::BIGINT AS skipped FROM g""",
}
