"""Queries over event folds, proposals and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import workflow as K
from cardloom.sources import tables as D

LIMIT = 400


def document_upsert(spark, sf):
    """Every third document arrives again, every sixth of these changed; some are new."""
    docs = D.table(spark, sf, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha"), "lang")
    again = docs.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.concat("sha", F.lit("+"))).otherwise(F.col("sha")).alias("sha"), "lang", F.lit(1).alias("seq"))
    new = docs.filter("doc_id % 5 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "sha", "lang", F.lit(2).alias("seq"))
    return K.upsert(docs, again.unionByName(new), "doc_id", ["sha", "lang"])


def latest_versions(spark, sf):
    orders = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("node_id"), "o_orderdate", "o_orderkey", "o_orderpriority")
    found = K.latest_versions(orders, "node_id", ["o_orderdate", "o_orderkey", "o_orderpriority"])
    return found.select("node_id", "current_version", F.col("latest.o_orderkey").alias("order_id"), F.col("latest.o_orderpriority").alias("priority"))


def idempotent_intake(spark, sf):
    events = D.table(spark, sf, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"))
    return K.intake(events, "key", "event_id")


def ingestion_conflicts(spark, sf):
    key = F.when(F.col("user_id") % 11 != 0, F.concat(F.lit(" k"), F.col("user_id").cast("string")))
    requests = D.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), key.alias("key"), T.sha256(F.col("event_type")).alias("payload_hash"))
    return K.intake_outcomes(requests)


def conditional_request_upsert(spark, sf):
    state = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("scope"),
        F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("fingerprint"),
        F.col("o_orderdate").cast("timestamp").alias("claimed_at"),
    )
    asked = D.table(spark, sf, "orders").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 0, 50_000_000).otherwise(0)).alias("scope"), F.lit("f0").alias("fingerprint"))
    return K.request_upsert(state, asked, F.lit("1995-06-17 00:00:00").cast("timestamp"))


def _proposals(spark, sf):
    """Proposals made of events: type by event, node by user, base version by hour."""
    e = D.table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "create").when(F.col("event_id") % 5 == 0, "delete").otherwise("edit")
    return e.select(
        F.col("event_id").alias("proposal_id"),
        kind.alias("proposal_type"),
        F.when(kind == "create", F.col("event_id") + 1_000_000).otherwise(F.col("user_id")).alias("node_id"),
        (F.col("event_id") % 4 + 1).alias("base_version"),
        F.when(F.col("event_id") % 6 != 0, F.col("event_type")).otherwise(" ").alias("reason"),
        F.when(F.col("event_id") % 3 == 0, F.lit("Same")).otherwise(F.concat(F.lit("New "), F.col("event_id").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("content"),
    )


def proposal_validation(spark, sf):
    users = D.table(spark, sf, "events").select(F.col("user_id").alias("node_id")).distinct()
    versions = users.select("node_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version"), F.lit("Same").alias("title"), F.lit("Body").alias("content"))
    return K.proposal_checks(_proposals(spark, sf), versions)


def proposal_apply(spark, sf):
    cards = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("title"), F.lit(1).cast("long").alias("current_version"), F.lit("active").alias("state"))
    accepted = _proposals(spark, sf).filter("trim(reason) <> ''").select("node_id", "proposal_type", F.col("title").alias("_new"), F.col("proposal_id").alias("reviewed_at"))
    return K.apply_proposals(cards, accepted.withColumnRenamed("_new", "new"))


def reviewer_roles(spark, sf):
    e = D.table(spark, sf, "events")
    roles = e.select("user_id", F.when(F.col("event_id") % 2 == 0, "reviewer").otherwise("author").alias("role"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("revoked_at"))
    return K.active_reviewers(roles)


def _jobs(spark, sf):
    o = D.table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("node_id")).agg(F.max("o_orderkey").alias("k"))
    return rows.select((F.col("node_id") + 1).alias("node_id"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("job_id"), F.when(F.col("k") % 4 == 0, "DONE").alias("terminal_state"))


def _preflight(spark, sf):
    own = D.assignments(spark, sf).withColumnRenamed("taxonomy_node_id", "scope_id")
    jobs = _jobs(spark, sf).join(own, "node_id")
    return K.preflight(D.taxonomy_nodes(spark, sf).select(F.col("id").alias("scope_id"), F.col("name").alias("path")), own, jobs)


def classification_preflight(spark, sf):
    return _preflight(spark, sf)


def submission_allocation(spark, sf):
    waiting = _preflight(spark, sf).join(D.taxonomy_nodes(spark, sf).select(F.col("id").alias("scope_id"), F.col("name").alias("path")), "scope_id")
    return K.allocate(waiting.select("scope_id", "path", (F.col("cards") - F.col("active")).alias("waiting")), LIMIT)


def classification_moves(spark, sf):
    customers, nations = D.table(spark, sf, "customer"), D.table(spark, sf, "nation")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    target = F.when(F.col("c_custkey") % 5 == 0, "UNCLASSIFIED").when(F.col("c_custkey") % 4 == 0, "Atlantis").otherwise(F.initcap("n_name"))
    results = rows.select((F.col("n_regionkey") + 2).cast("long").alias("scope_id"), (F.col("c_custkey") + 1).alias("node_id"), target.alias("target"))
    children = D.taxonomy_nodes(spark, sf).filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("scope_id"), F.col("id").alias("child_id"), "name")
    return K.classify(results, D.assignments(spark, sf), children)


def continuation_drain(spark, sf):
    e = D.table(spark, sf, "events")
    requests = e.select(F.col("user_id").alias("scope_id"), F.col("event_id").alias("node_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return K.drained(requests, F.lit("2024-01-31 00:00:00").cast("timestamp"), 70, 2_585_000).select("scope_id", "node_id")


def continuation_work(spark, sf):
    """One request a scope and card, renewed by each event; every fourth event names Root, whatever the card's scope."""
    own = D.assignments(spark, sf)
    e = D.table(spark, sf, "events").withColumn("node_id", F.col("user_id") * 10 + F.col("event_id") % 10 + 1).join(own, "node_id", "left")
    scope = F.when(F.col("event_id") % 4 == 0, F.lit(1)).otherwise(F.coalesce("taxonomy_node_id", F.lit(1))).cast("long")
    latest = D.table(spark, sf, "orders").groupBy((F.col("o_custkey") + 1).alias("node_id")).agg(F.max("o_orderkey").alias("id"))
    requests = e.groupBy(scope.alias("scope_id"), "node_id").agg(F.min("event_id").alias("request_id"), F.max(F.col("ts").cast("timestamp")).alias("updated_at"))
    requests = requests.join(latest, "node_id", "left").select("request_id", "scope_id", "node_id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("next_job_id"), "updated_at")
    sent, ended = F.when(F.col("id") % 3 != 0, F.col("id")).alias("job_id"), F.when(F.col("id") % 4 == 1, "DONE").alias("terminal_state")
    jobs = latest.join(own, "node_id").select("id", F.col("taxonomy_node_id").alias("scope_id"), "node_id", sent, ended, F.when(F.col("id") % 5 == 0, F.lit("1998-01-01")).alias("processed_at"))
    children = D.taxonomy_nodes(spark, sf).filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("scope_id"), F.col("id").alias("child_id"), "name")
    found = K.continuation_work(requests, F.lit("2024-01-31 00:00:00").cast("timestamp"), 64, 86_400, own, children, jobs)
    return found.select("request_id", "scope_id", "node_id", "next_job_id")


def card_pipeline_replay(spark, sf):
    """Documents as units; reviews follow the labels, repairs give two cards or none."""
    docs, labels = D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels").select("doc_id", "quality")
    none = F.lit(None).cast("string")
    page = docs.select(F.concat(F.lit("page:"), F.col("doc_id").cast("string")).alias("job"), F.when(F.col("doc_id") % 13 == 0, "FAILED").alias("terminal_state"), F.lit(None).cast("boolean").alias("passed"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("cards"))
    names = F.explode(F.array(F.lit("/0"), F.lit("/1"), F.lit("/0/0"), F.lit("/0/1"), F.lit("/1/0")))
    judged = labels.select("doc_id", "quality", names.alias("tail"))
    candidate = F.concat(F.col("doc_id").cast("string"), "tail")
    passed = (F.col("quality") == 1) & ((F.col("doc_id") + F.length("tail")) % 4 != 0)
    review = judged.select(F.concat(F.lit("review:"), candidate).alias("job"), F.when(F.col("doc_id") % 17 == 0, "EXPIRED").alias("terminal_state"), passed.alias("passed"), F.array().cast("array<string>").alias("cards"))
    repair = judged.filter("doc_id % 5 <> 0").select(F.concat(F.lit("repair:"), candidate).alias("job"), none.alias("terminal_state"), F.lit(None).cast("boolean").alias("passed"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"), F.lit("d"))).alias("cards"))
    return K.pipeline_replay(docs.withColumnRenamed("doc_id", "unit_id"), page.union(review).union(repair))


def search_cache_key(spark, sf):
    text = F.concat(F.lit('{"limit":3,"pool":64,"query":"'), T.normalised(F.col("raw_query")), F.lit('"}'))
    return D.search_events(spark, sf).select("session_id", "turn", T.sha256(text).alias("cache_key"))


QUERIES = {f.__name__: f for f in (document_upsert, latest_versions, idempotent_intake, ingestion_conflicts, conditional_request_upsert, proposal_validation, proposal_apply, reviewer_roles, classification_preflight, submission_allocation, classification_moves, continuation_drain, continuation_work, card_pipeline_replay, search_cache_key)}

_PROP = """prop AS (SELECT event_id AS proposal_id, CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 5 = 0 THEN 'delete' ELSE 'edit' END AS kind,
  CASE WHEN event_id % 7 = 0 THEN event_id + 1000000 ELSE user_id END AS node_id, event_id % 4 + 1 AS base_version, CASE WHEN event_id % 6 <> 0 THEN event_type ELSE ' ' END AS reason,
  CASE WHEN event_id % 3 = 0 THEN 'Same' ELSE 'New ' || event_id END AS title FROM events)"""
_PRE = f"""{D.with_views("tree", "assigned")}, jk AS (SELECT o_custkey + 1 AS node_id, max(o_orderkey) AS k FROM orders GROUP BY 1), live AS (SELECT node_id, k % 3 = 0 AS unsent FROM jk WHERE k % 4 <> 0),
pre AS (SELECT t.id AS scope_id, t.name AS path, count(a.node_id) AS cards, count(l.node_id) AS active, count(*) FILTER (l.unsent) AS pending FROM tree t LEFT JOIN assigned a ON a.taxonomy_node_id = t.id LEFT JOIN live l ON l.node_id = a.node_id GROUP BY 1, 2)"""
SQL = {
    "document_upsert": """WITH s AS (SELECT doc_id, sha256(text) AS sha, lang FROM documents),
      inc AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN sha || '+' ELSE sha END AS sha, lang FROM s WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 10000000, sha, lang FROM s WHERE doc_id % 5 = 0)
      SELECT coalesce(i.doc_id, s.doc_id) AS doc_id, coalesce(i.sha, s.sha) AS sha, coalesce(i.lang, s.lang) AS lang, CASE WHEN s.doc_id IS NULL THEN 'inserted' WHEN i.doc_id IS NULL THEN 'kept' WHEN s.sha = i.sha AND s.lang = i.lang THEN 'unchanged' ELSE 'updated' END AS action
      FROM s FULL JOIN inc i ON s.doc_id = i.doc_id""",
    "latest_versions": "SELECT o_custkey AS node_id, count(*) AS current_version, max((o_orderdate, o_orderkey, o_orderpriority))[2] AS order_id, max((o_orderdate, o_orderkey, o_orderpriority))[3] AS priority FROM orders GROUP BY 1",
    "idempotent_intake": "SELECT user_id || ':' || event_type AS key, min(event_id) AS event_id FROM events GROUP BY 1",
    "ingestion_conflicts": """WITH r AS (SELECT event_id AS request_id, CASE WHEN user_id % 11 <> 0 THEN user_id END AS key, event_type FROM events), f AS (SELECT key, min((request_id, event_type)) AS first FROM r WHERE key IS NOT NULL GROUP BY 1),
      j AS (SELECT request_id, CASE WHEN r.key IS NULL OR first[1] = request_id THEN 'new' WHEN first[2] = event_type THEN 'replay' ELSE 'conflict' END AS outcome, first[1] AS first_id FROM r LEFT JOIN f USING (key))
      SELECT request_id, outcome, CASE WHEN outcome = 'replay' THEN first_id END AS same_as FROM j""",
    "conditional_request_upsert": """WITH s AS (SELECT o_orderkey AS scope, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, 'f' || (o_orderkey % 3) AS fingerprint, o_orderdate AS claimed_at FROM orders),
      q AS (SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 50000000 ELSE 0 END AS scope, 'f0' AS wanted FROM orders),
      j AS (SELECT scope, status, fingerprint, wanted, coalesce(wanted IS NULL OR (status = 'running' AND claimed_at >= TIMESTAMP '1995-06-17') OR (status = 'pending' AND fingerprint = wanted), false) AS stay FROM s FULL JOIN q USING (scope))
      SELECT scope, CASE WHEN stay THEN status ELSE 'pending' END AS status, CASE WHEN stay THEN fingerprint ELSE wanted END AS fingerprint, CASE WHEN status IS NULL THEN 'inserted' WHEN stay THEN 'left' ELSE 'reset' END AS action FROM j""",
    "proposal_validation": f"""WITH {_PROP} SELECT proposal_id, CASE WHEN trim(reason) = '' THEN 'reason required' WHEN kind <> 'create' AND base_version > 2 THEN 'base version missing' WHEN kind = 'edit' AND title = 'Same' THEN 'nothing changed' END AS problem FROM prop""",
    "reviewer_roles": "SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0",
    "classification_preflight": f"{_PRE} SELECT scope_id, cards, active, pending FROM pre",
    "submission_allocation": f"""{_PRE}, w AS (SELECT scope_id, path, cards - active AS waiting FROM pre), b AS (SELECT *, coalesce(sum(waiting) OVER (ORDER BY path, scope_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM w)
      SELECT scope_id, waiting, greatest(0, least(waiting, {LIMIT} - before))::BIGINT AS granted FROM b""",
    "classification_moves": f"""{D.with_views("tree", "assigned")}, r AS (SELECT (n_regionkey + 2)::BIGINT AS scope_id, c_custkey + 1 AS node_id, CASE WHEN c_custkey % 5 = 0 THEN 'unclassified' WHEN c_custkey % 4 = 0 THEN 'atlantis' ELSE lower(n_name) END AS target FROM customer JOIN nation ON c_nationkey = n_nationkey),
      j AS (SELECT r.node_id, r.scope_id, t.id AS target_id, CASE WHEN a.taxonomy_node_id IS DISTINCT FROM r.scope_id THEN 'stale' WHEN target = 'unclassified' THEN 'stay' WHEN t.id IS NULL THEN 'unknown child' ELSE 'move' END AS outcome
        FROM r LEFT JOIN tree t ON t.parent_id = r.scope_id AND lower(t.name) = target LEFT JOIN assigned a ON a.node_id = r.node_id)
      SELECT node_id, outcome, CASE outcome WHEN 'move' THEN target_id WHEN 'stay' THEN scope_id END AS target_id FROM j""",
    "continuation_drain": """WITH q AS (SELECT user_id AS scope_id, event_id AS node_id, ts FROM events), d AS (SELECT scope_id FROM q GROUP BY 1 HAVING count(*) >= 70 OR date_diff('second', date_trunc('second', min(ts)), TIMESTAMP '2024-01-31') >= 2585000) SELECT scope_id, node_id FROM q SEMI JOIN d USING (scope_id)""",
    "continuation_work": f"""{D.with_views("tree", "assigned")}, jk AS (SELECT o_custkey + 1 AS node_id, max(o_orderkey) AS k FROM orders GROUP BY 1), ev AS (SELECT event_id, ts, user_id * 10 + event_id % 10 + 1 AS node_id FROM events),
      q AS (SELECT (CASE WHEN event_id % 4 = 0 THEN 1 ELSE coalesce(taxonomy_node_id, 1) END)::BIGINT AS scope_id, ev.node_id, min(event_id) AS request_id, max(ts) AS updated_at FROM ev LEFT JOIN assigned a ON a.node_id = ev.node_id GROUP BY 1, 2),
      o AS (SELECT *, row_number() OVER (ORDER BY updated_at, request_id) - 1 AS place, count(*) OVER () AS n FROM q), tick AS (SELECT *, count(*) OVER (PARTITION BY place // 64) AS size, min(updated_at) OVER (PARTITION BY place // 64) AS oldest FROM o)
      SELECT request_id, t.scope_id, t.node_id, CASE WHEN k % 2 = 0 THEN k END AS next_job_id FROM tick t LEFT JOIN jk ON jk.node_id = t.node_id JOIN assigned a ON a.node_id = t.node_id AND a.taxonomy_node_id = t.scope_id
      WHERE (size >= 64 OR TIMESTAMP '2024-01-31' - oldest >= INTERVAL 1 DAY) AND t.scope_id IN (SELECT parent_id FROM tree) AND (k IS NULL OR k % 4 = 1 OR k % 5 = 0 OR (k % 2 = 0 AND k % 3 = 0))""",
    "search_cache_key": D.with_views("searches") + r""" SELECT session_id, turn, sha256('{"limit":3,"pool":64,"query":"' || lower(trim(regexp_replace(raw_query, '\s+', ' ', 'g'))) || '"}') AS cache_key FROM searches""",
    "proposal_apply": f"""WITH {_PROP}, f AS (SELECT node_id, count(*) FILTER (kind = 'edit') AS edits, arg_max(title, proposal_id) FILTER (kind <> 'delete') AS new_title, bool_or(kind = 'delete') AS gone, bool_or(kind = 'create') AS made FROM prop WHERE trim(reason) <> '' GROUP BY 1)
      SELECT coalesce(c_custkey, node_id) AS node_id, coalesce(new_title, c_name) AS title, 1 + coalesce(edits, 0) AS current_version, CASE WHEN gone THEN 'archived' ELSE 'active' END AS state FROM customer FULL JOIN f ON c_custkey = node_id WHERE c_custkey IS NOT NULL OR made""",
    "card_pipeline_replay": """WITH RECURSIVE n AS (SELECT unnest([0, 1]) AS i), l AS (SELECT doc_id, quality, unnest(['/0', '/1', '/0/0', '/0/1', '/1/0']) AS known FROM labels),
      t AS (SELECT doc_id AS unit_id, '/' || i AS tail, NULL::VARCHAR AS parent FROM documents, n WHERE doc_id % 13 <> 0 AND (i = 0 OR doc_id % 2 = 0)
        UNION ALL SELECT unit_id, tail || '/' || i, unit_id || tail FROM t JOIN l ON doc_id = unit_id AND known = tail, n WHERE unit_id % 17 <> 0 AND unit_id % 5 <> 0 AND unit_id % 3 <> 0 AND NOT coalesce(quality = 1 AND (unit_id + length(tail)) % 4 <> 0, false))
      SELECT unit_id || tail AS candidate, unit_id, parent, CASE WHEN doc_id IS NULL THEN 'in review' WHEN unit_id % 17 = 0 THEN 'stopped' WHEN quality = 1 AND (unit_id + length(tail)) % 4 <> 0 THEN 'handed off' WHEN unit_id % 5 = 0 THEN 'in repair' WHEN unit_id % 3 = 0 THEN 'ended' ELSE 'repaired' END AS state
      FROM t LEFT JOIN l ON doc_id = unit_id AND known = tail""",
}
