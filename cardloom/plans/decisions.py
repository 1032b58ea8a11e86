"""Queries over proposals' decisions, contracts and intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import decisions as P
from cardloom.plans import workflow
from cardloom.sources import tables as D


def proposal_decisions(spark, sf):
    """Orders as proposals of ten users, their lines as actions; every eleventh line names an order that does not exist."""
    orders, lines = D.table(spark, sf, "orders"), D.table(spark, sf, "lineitem")
    proposals = orders.select(F.col("o_orderkey").alias("proposal_id"), (F.col("o_custkey") % 10 + 1).alias("submitted_by"))
    action = F.when(F.col("l_linenumber") % 3 == 0, "withdraw").when(F.col("l_linenumber") % 3 == 1, "reject").otherwise("accept")
    actions = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"), F.when(F.col("l_partkey") % 11 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("proposal_id"), F.col("l_suppkey").alias("actor"), action.alias("action"))
    return P.decided(proposals, actions, D.table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("user_id")))


def proposal_audit(spark, sf):
    accepted = workflow._proposals(spark, sf).filter("trim(reason) <> ''").withColumn("content", F.col("reason"))
    base = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), (F.col("c_nationkey") % 3 + 1).cast("long").alias("current_version"))
    return P.applied(accepted, base).withColumn("embedded", T.sha256(F.col("embedded")))


def proposals_by_user(spark, sf):
    orders = D.table(spark, sf, "orders")
    return P.listed(orders.select(F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("submitted_by"), F.col("o_orderdate").alias("created_at")))


def legacy_proposals(spark, sf):
    e = D.table(spark, sf, "events")
    payload = F.concat(F.lit('{"title": "T'), F.col("event_id").cast("string"), F.lit('", "reason": "'), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" "), F.lit('"}'))
    status = F.when(F.col("event_id") % 4 == 0, "accepted").when(F.col("event_id") % 4 == 1, "rejected").otherwise("open")
    return P.migrated(e.select(F.col("event_id").alias("id"), status.alias("status"), F.col("user_id").alias("node_id"), (F.col("event_id") % 3).alias("base_version"), payload.alias("payload"), F.when(F.col("event_id") % 5 == 0, F.lit(" seen ")).alias("review_note")))


def review_contracts(spark, sf):
    k = F.col("event_id") % 7
    raw = F.when(k == 0, "[1, 2]").when(k == 1, '{"passed": true}').when(k == 2, '{"passed": false, "reason": " "}').when(k == 3, '{"passed": true, "score": 1}').when(k == 4, '{"reason": "x"}').when(k == 5, "{broken").otherwise(F.concat(F.lit('{"passed": false, "reason": "'), "event_type", F.lit('"}')))
    return D.table(spark, sf, "events").select("event_id", P.review_problem(raw).alias("problem"))


def run_units(spark, sf):
    pages = D.table(spark, sf, "pages").select(F.concat(F.lit("wikipedia:"), F.col("page_id").cast("string")).alias("source_ref"), F.col("url").alias("title"), F.col("html").alias("content")).filter("title IS NOT NULL AND content IS NOT NULL")
    units = P.taken_in(pages, D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("run_id")), "page")[1]
    return units.select("run_id", "source_kind", "source_ref", F.get_json_object("payload", "$.title").alias("title"))


def classification_batch(spark, sf):
    """Customers' cards: without an assignment before if 4 divides them, without one after if 12 does, with a failed session if 14 does."""
    own = D.assignments(spark, sf)
    failures = own.filter("node_id % 14 = 0").select("node_id", F.lit("timeout").alias("detail"))
    return P.batch_outcomes(own.select("node_id"), own.filter("node_id % 4 <> 0"), own.filter("node_id % 12 <> 0"), failures)


QUERIES = {f.__name__: f for f in (proposal_decisions, proposal_audit, proposals_by_user, legacy_proposals, review_contracts, run_units, classification_batch)}

SQL = {
    "proposal_decisions": """WITH p AS (SELECT o_orderkey AS proposal_id, o_custkey % 10 + 1 AS submitted_by FROM orders),
      a AS (SELECT l_orderkey * 10 + l_linenumber AS action_id, CASE WHEN l_partkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS proposal_id, l_suppkey AS actor, ['withdraw', 'reject', 'accept'][l_linenumber % 3 + 1] AS action FROM lineitem),
      j AS (SELECT a.*, submitted_by, CASE WHEN action = 'withdraw' THEN coalesce(actor = submitted_by, false) ELSE actor IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) END AS may FROM a LEFT JOIN p USING (proposal_id)),
      f AS (SELECT *, min(action_id) FILTER (may AND submitted_by IS NOT NULL) OVER (PARTITION BY proposal_id) AS first FROM j)
      SELECT action_id, proposal_id, CASE WHEN action = 'accept' AND NOT may THEN 'no role' WHEN submitted_by IS NULL THEN 'not found' WHEN first < action_id THEN 'not pending' WHEN may THEN 'done' WHEN action = 'withdraw' THEN 'not submitter' ELSE 'no role' END AS outcome FROM f""",
    "proposal_audit": f"""WITH {workflow._PROP}, ok AS (SELECT * FROM prop WHERE trim(reason) <> '')
      SELECT proposal_id, kind AS proposal_type, ok.node_id, CASE kind WHEN 'create' THEN 1 WHEN 'edit' THEN coalesce(c_nationkey % 3 + 1, 1) + count(*) FILTER (kind = 'edit') OVER (PARTITION BY ok.node_id ORDER BY proposal_id) END::BIGINT AS version,
        CASE WHEN kind = 'delete' THEN ok.node_id END AS archived_node_id, CASE WHEN kind <> 'delete' THEN sha256(title || chr(10) || chr(10) || reason) END AS embedded FROM ok LEFT JOIN customer ON c_custkey = ok.node_id""",
    "proposals_by_user": "SELECT o_custkey AS submitted_by, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position, o_orderkey AS proposal_id FROM orders",
    "legacy_proposals": """SELECT event_id AS proposal_id, CASE event_id % 4 WHEN 0 THEN 'accepted_applied' WHEN 1 THEN 'rejected' ELSE 'pending_review' END AS status,
      CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 5 = 0 THEN 'seen' ELSE 'Legacy proposal imported before reason capture.' END AS reason,
      '{"target_node_id":' || user_id || ',"base_version":' || (event_id % 3) || ',"suggested_title":"T' || event_id || '"}' AS payload FROM events""",
    "review_contracts": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not an object' WHEN 2 THEN 'reason missing' WHEN 3 THEN 'unknown field' WHEN 4 THEN 'passed missing' WHEN 5 THEN 'not an object' END AS problem FROM events",
    "run_units": "SELECT (SELECT max(n_nationkey) + 1 FROM nation)::BIGINT AS run_id, 'page' AS source_kind, 'wikipedia:' || page_id AS source_ref, url AS title FROM pages WHERE url IS NOT NULL AND html IS NOT NULL",
    "classification_batch": f"""{D.with_views("assigned")}, s AS (SELECT *, CASE WHEN node_id % 14 = 0 OR node_id % 12 = 0 THEN 'error' WHEN node_id % 4 <> 0 THEN 'already_assigned' ELSE 'assigned' END AS status FROM assigned)
      SELECT node_id, status, CASE WHEN status <> 'error' THEN taxonomy_node_id END AS taxonomy_node_id, CASE WHEN node_id % 14 = 0 THEN 'timeout' WHEN node_id % 12 = 0 THEN 'assignment missing after session' END AS detail FROM s""",
}
