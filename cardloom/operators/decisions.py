"""Decisions on proposals, their audit, and the checks of what agents and imports hand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T


def decided(proposals: DataFrame, actions: DataFrame, reviewers: DataFrame) -> DataFrame:
    """(action_id, proposal_id, outcome): accept, reject and withdraw actions in the order of their ids.

    proposals are pending (proposal_id, submitted_by), actions (action_id, proposal_id, actor, action), reviewers
    (user_id).  The first action that is permitted decides a proposal.  An accept tests the role before it looks at the
    proposal, a reject after; only the submitter withdraws.  Outcomes: done, no role, not found, not pending, not submitter.
    """
    role = reviewers.select(F.col("user_id").alias("actor"), F.lit(True).alias("_role")).distinct()
    rows = actions.join(proposals.select("proposal_id", "submitted_by"), "proposal_id", "left").join(role, "actor", "left")
    may = F.when(F.col("action") == "withdraw", F.col("actor") == F.col("submitted_by")).otherwise(F.coalesce("_role", F.lit(False)))
    rows = rows.withColumn("_may", may)
    first = rows.filter("_may AND submitted_by IS NOT NULL").groupBy("proposal_id").agg(F.min("action_id").alias("_first"))
    outcome = (
        F.when((F.col("action") == "accept") & ~F.col("_may"), "no role")
        .when(F.col("submitted_by").isNull(), "not found")
        .when(F.col("_first") < F.col("action_id"), "not pending")
        .when(F.col("_may"), "done")
        .when(F.col("action") == "withdraw", "not submitter")
        .otherwise("no role")
    )
    return rows.join(first, "proposal_id", "left").select("action_id", "proposal_id", outcome.alias("outcome"))


def applied(accepted: DataFrame, base: DataFrame) -> DataFrame:
    """Audit rows (proposal_id, proposal_type, node_id, version, archived_node_id, embedded): what accepting each proposal did.

    accepted are (proposal_id, proposal_type, node_id, title, content), applied in the order of proposal_id; base holds
    (node_id, current_version).  Every edit makes the next version, whatever version it was written against; `embedded` is the text
    embedded anew.
    """
    edit = F.col("proposal_type") == "edit"
    order = W.partitionBy("node_id").orderBy("proposal_id").rowsBetween(W.unboundedPreceding, 0)
    rows = accepted.join(base, "node_id", "left")
    version = F.when(F.col("proposal_type") == "create", 1).when(edit, F.coalesce("current_version", F.lit(1)) + F.sum(edit.cast("long")).over(order))
    gone = F.when(F.col("proposal_type") == "delete", F.col("node_id"))
    text = F.when(F.col("proposal_type") != "delete", F.concat_ws("\n\n", "title", "content"))
    return rows.select("proposal_id", "proposal_type", "node_id", version.cast("long").alias("version"), gone.alias("archived_node_id"), text.alias("embedded"))


def listed(proposals: DataFrame) -> DataFrame:
    """(submitted_by, position, proposal_id): each user's proposals (proposal_id, submitted_by, created_at), newest first."""
    order = W.partitionBy("submitted_by").orderBy(F.desc("created_at"), F.desc("proposal_id"))
    return proposals.select("submitted_by", F.row_number().over(order).cast("long").alias("position"), "proposal_id")


def migrated(edits: DataFrame) -> DataFrame:
    """(proposal_id, status, reason, payload) of legacy edits (id, status, node_id, base_version, payload, review_note).

    Statuses are mapped to those of proposals; the reason is the payload's, else the note's, else a fixed sentence.
    """
    status = F.when(F.col("status") == "accepted", "accepted_applied").when(F.col("status") == "rejected", "rejected").otherwise("pending_review")
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    reason = F.coalesce(said(F.get_json_object("payload", "$.reason")), said(F.col("review_note")), F.lit("Legacy proposal imported before reason capture."))
    payload = F.to_json(F.struct(F.col("node_id").alias("target_node_id"), "base_version", F.get_json_object("payload", "$.title").alias("suggested_title")))
    return edits.select(F.col("id").alias("proposal_id"), status.alias("status"), reason.alias("reason"), payload.alias("payload"))


def review_problem(raw: Column) -> Column:
    """Why a review result (JSON) is refused, or null: only `passed` and `reason` may stand in it, and a failure needs a reason."""
    keys, passed = F.json_object_keys(raw), F.get_json_object(raw, "$.passed")
    return (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(F.lit("passed"), F.lit("reason")))) > 0, "unknown field")
        .when(passed.isNull() | ~passed.isin("true", "false"), "passed missing")
        .when((passed == "false") & (F.coalesce(F.trim(F.get_json_object(raw, "$.reason")), F.lit("")) == ""), "reason missing")
    )


def taken_in(units: DataFrame, runs: DataFrame, source_kind: str) -> tuple[DataFrame, DataFrame]:
    """A new run (run_id, source_kind) after `runs` (run_id) and its units (run_id, source_kind, source_ref, payload) from (source_ref, title, content).

    Raises ValueError if a unit lacks a field.
    """
    if not units.filter("source_ref IS NULL OR title IS NULL OR content IS NULL").isEmpty():
        raise ValueError("every unit needs source_ref, title and content")
    run_id = (runs.agg(F.max("run_id").alias("n")).first()["n"] or 0) + 1
    kind = F.lit(source_kind)
    run = units.sparkSession.createDataFrame([(run_id, source_kind)], "run_id long, source_kind string")
    payload = F.to_json(F.struct(kind.alias("source_kind"), "source_ref", "title", "content"))
    return run, units.select(F.lit(run_id).cast("long").alias("run_id"), kind.alias("source_kind"), "source_ref", payload.alias("payload"))


def batch_outcomes(selected: DataFrame, before: DataFrame, after: DataFrame, failures: DataFrame) -> DataFrame:
    """(node_id, status, taxonomy_node_id, detail) of a classification batch over the cards (node_id) it selected.

    before and after hold assignments (node_id, taxonomy_node_id), failures (node_id, detail) of sessions that ended in an error.
    """
    was, now = before.select("node_id", F.lit(True).alias("_was")), after.select("node_id", F.col("taxonomy_node_id").alias("_now"))
    rows = selected.select("node_id").join(was, "node_id", "left").join(now, "node_id", "left").join(failures, "node_id", "left")
    status = F.when(F.col("detail").isNotNull() | F.col("_now").isNull(), "error").when(F.col("_was"), "already_assigned").otherwise("assigned")
    detail = F.coalesce("detail", F.when(F.col("_now").isNull(), "assignment missing after session"))
    return rows.select("node_id", status.alias("status"), F.when(status != "error", F.col("_now")).alias("taxonomy_node_id"), detail.alias("detail"))


def review_requests(units: DataFrame) -> DataFrame:
    """units with the idempotency key of each source unit: (source_ref, idempotency_key)."""
    return units.select("source_ref", F.concat(F.lit("unit:"), F.substring(T.sha256(F.col("source_ref")), 1, 32)).alias("idempotency_key"))
