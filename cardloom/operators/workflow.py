"""Table-state and workflow operators: snapshots and event logs folded into new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.sources.versioned import cut

#: Job states that end a branch.
TERMINAL = ("CANCELLED", "DEAD_LETTER", "FAILED", "EXPIRED")


def upsert(state: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """state after incoming, with `action`: inserted, updated, unchanged or kept.  Of rows with one key in a batch the one of greatest `seq` counts."""
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("new"))
    both = state.select(key, F.struct(*columns).alias("old")).join(last, key, "full_outer")
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(key, F.coalesce("new", "old").alias("row"), action.alias("action")).select(key, "row.*", "action")


def latest_versions(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, current_version, latest): versions counted in order and the last row."""
    newest = F.max(F.struct(*order))
    return versions.groupBy(key).agg(F.count("*").alias("current_version"), newest.alias("latest"))


def intake(events: DataFrame, key: str, order: str) -> DataFrame:
    """First event of each key (null keys: all events)."""
    keyed = events.filter(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(order).alias(order))
    return keyed.join(first, [key, order], "left_semi").unionByName(events.filter(F.col(key).isNull()))


def intake_outcomes(requests: DataFrame) -> DataFrame:
    """(request_id, outcome, same_as): new, replay of an earlier request, or conflict; requests are (request_id, key, payload_hash)."""
    key = F.when(F.trim("key") != "", F.trim("key"))
    rows = requests.withColumn("key", key)
    first = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("request_id", "payload_hash")).alias("first"))
    joined = rows.join(first, "key", "left")
    own = F.col("key").isNull() | (F.col("first.request_id") == F.col("request_id"))
    outcome = F.when(own, "new").when(F.col("first.payload_hash") == F.col("payload_hash"), "replay").otherwise("conflict")
    return joined.select("request_id", outcome.alias("outcome"), F.when(outcome == "replay", F.col("first.request_id")).alias("same_as"))


def payload_hash(title, content):
    """sha256 of {"content":...,"title":...} in compact JSON with sorted keys."""
    return T.sha256(F.to_json(F.struct(content.alias("content"), title.alias("title"))))


def request_upsert(state: DataFrame, asked: DataFrame, stale_before) -> DataFrame:
    """Compute requests after new ones: (scope, status, fingerprint, action).

    A running request that is not stale and a pending one of the same fingerprint stay; anything else is set to pending anew.
    """
    both = state.join(asked.select("scope", F.col("fingerprint").alias("wanted")), "scope", "full_outer")
    stay = F.col("wanted").isNull() | ((F.col("status") == "running") & (F.col("claimed_at") >= stale_before)) | ((F.col("status") == "pending") & (F.col("fingerprint") == F.col("wanted")))
    stay = F.coalesce(stay, F.lit(False))
    action = F.when(F.col("status").isNull(), "inserted").when(stay, "left").otherwise("reset")
    return both.select("scope", F.when(stay, F.col("status")).otherwise("pending").alias("status"), F.when(stay, F.col("fingerprint")).otherwise(F.col("wanted")).alias("fingerprint"), action.alias("action"))


def proposal_checks(proposals: DataFrame, versions: DataFrame) -> DataFrame:
    """(proposal_id, problem): null if it may be submitted; versions are (node_id, version, title, content)."""
    base = versions.select("node_id", F.col("version").alias("base_version"), F.col("title").alias("_t"), F.col("content").alias("_c"))
    rows = proposals.join(base, ["node_id", "base_version"], "left")
    edits = F.col("proposal_type") == "edit"
    problem = (
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason required")
        .when((F.col("proposal_type") != "create") & F.col("_t").isNull(), "base version missing")
        .when(edits & (F.coalesce("title", "_t") == F.col("_t")) & (F.coalesce("content", "_c") == F.col("_c")), "nothing changed")
    )
    return rows.select("proposal_id", problem.alias("problem"))


def apply_proposals(cards: DataFrame, accepted: DataFrame) -> DataFrame:
    """(node_id, title, current_version, state) after accepted proposals (node_id, proposal_type, new title, reviewed_at) in review order.

    An edit counts a version and the last title given stands; a create adds a card of version 1; a delete archives and stays.
    """
    folded = accepted.groupBy("node_id").agg(
        F.count_if(F.col("proposal_type") == "edit").alias("edits"),
        F.max_by("new", F.when(F.col("new").isNotNull() & (F.col("proposal_type") != "delete"), F.col("reviewed_at"))).alias("new_title"),
        F.max((F.col("proposal_type") == "delete").cast("int")).alias("gone"),
        F.max((F.col("proposal_type") == "create").cast("int")).alias("made"),
    )
    rows = cards.join(folded, "node_id", "full_outer").filter("title IS NOT NULL OR made = 1")
    version = F.coalesce("current_version", F.lit(1)) + F.coalesce("edits", F.lit(0))
    state = F.when(F.col("gone") == 1, "archived").otherwise(F.coalesce("state", F.lit("active")))
    return rows.select("node_id", F.coalesce("new_title", "title").alias("title"), version.alias("current_version"), state.alias("state"))


def active_reviewers(roles: DataFrame) -> DataFrame:
    return roles.filter("role = 'reviewer' AND revoked_at IS NULL").select("user_id").distinct()


def preflight(scopes: DataFrame, assigned: DataFrame, jobs: DataFrame) -> DataFrame:
    """(scope_id, cards, active, pending): cards of a scope, those with an active job, and jobs not yet sent."""
    live = jobs.filter("terminal_state IS NULL").select("scope_id", "node_id", F.lit(True).alias("live"), F.col("job_id").alias("remote"))
    rows = scopes.join(assigned, "scope_id", "left").join(live, ["scope_id", "node_id"], "left")
    return rows.groupBy("scope_id").agg(F.count("node_id").alias("cards"), F.count_if("live").alias("active"), F.count_if(F.col("live") & F.col("remote").isNull()).alias("pending"))


def allocate(waiting: DataFrame, limit: int) -> DataFrame:
    """(scope_id, waiting, granted): a shared limit dealt over scopes (scope_id, path, waiting), a row each, in the order of their path.

    A scope that waits takes one at least, so none after the first `limit` of them gets any: only those meet in one task.
    """
    first = waiting.filter("waiting > 0").orderBy("path", "scope_id").limit(max(limit, 0))
    before = F.coalesce(F.sum("waiting").over(W.orderBy("path", "scope_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = first.select(F.col("scope_id").alias("_scope"), F.least(F.col("waiting"), F.lit(limit) - before).alias("_granted"))
    rows = waiting.join(dealt, F.col("scope_id").eqNullSafe(F.col("_scope")), "left")
    return rows.select("scope_id", "waiting", F.greatest(F.lit(0), F.coalesce("_granted", F.lit(0))).cast("long").alias("granted"))


def classify(results: DataFrame, assigned: DataFrame, children: DataFrame) -> DataFrame:
    """(node_id, outcome, target_id): results (scope_id, node_id, target) against assignments and the scope's children (scope_id, child_id, name)."""
    kids = children.select("scope_id", F.col("child_id").alias("target_id"), F.lower("name").alias("_name"))
    now = assigned.select("node_id", F.col("taxonomy_node_id").alias("_at"))
    rows = results.withColumn("_name", F.lower("target")).join(kids, ["scope_id", "_name"], "left").join(now, "node_id", "left")
    outcome = F.when(~F.col("_at").eqNullSafe(F.col("scope_id")), "stale").when(F.col("_name") == "unclassified", "stay").when(F.col("target_id").isNull(), "unknown child").otherwise("move")
    return rows.select("node_id", outcome.alias("outcome"), F.when(outcome == "move", F.col("target_id")).when(outcome == "stay", F.col("scope_id")).alias("target_id"))


def drained(requests: DataFrame, now, batch: int, interval_s: int) -> DataFrame:
    """Continuation requests (scope_id, node_id, created_at) of scopes with `batch` requests or one older than interval_s.

    Only the test of a buffer kept for each scope; `continuation_work` is the whole drain.
    """
    due = requests.groupBy("scope_id").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))
    due = due.filter((F.col("n") >= batch) | (F.unix_timestamp(now) - F.unix_timestamp("oldest") >= interval_s))
    return requests.join(due.select("scope_id"), "scope_id", "left_semi")


def continuation_work(requests: DataFrame, now, batch: int, interval_s: int, assigned: DataFrame, children: DataFrame, jobs: DataFrame) -> DataFrame:
    """The requests (request_id, scope_id, node_id, next_job_id, updated_at) that drains at `now` submit, repeated until none is due.

    A drain takes the `batch` oldest of all requests if there are as many or the oldest waits for interval_s, so at
    rest only the newest count % batch may be left.  Of those taken, requests go without work whose card is no longer assigned to the
    scope, whose scope has no children (scope_id, child_id, name) but Unclassified, or whose first active job (id, scope_id,
    node_id, job_id, terminal_state, processed_at) is not their own next job or is already sent.
    """
    rest = requests.orderBy(F.desc("updated_at"), F.desc("request_id")).limit(requests.count() % batch)
    held = rest.crossJoin(rest.agg(F.min("updated_at").alias("_oldest"))).filter(F.col("_oldest") > now - F.expr(f"INTERVAL {interval_s} SECOND"))
    taken = requests.join(held.select("request_id"), "request_id", "left_anti")
    first = jobs.filter("terminal_state IS NULL AND processed_at IS NULL").groupBy("scope_id", "node_id").agg(F.min(F.struct("id", "job_id")).alias("_first"))
    other = taken.join(first, ["scope_id", "node_id"]).filter(~F.col("_first.id").eqNullSafe(F.col("next_job_id")) | F.col("_first.job_id").isNotNull())
    kept = taken.join(assigned.select("node_id", F.col("taxonomy_node_id").alias("scope_id")), ["scope_id", "node_id"], "left_semi")
    kept = kept.join(children.filter("name <> 'Unclassified'").select("scope_id"), "scope_id", "left_semi")
    return kept.join(other.select("request_id"), "request_id", "left_anti")


def pipeline_replay(units: DataFrame, results: DataFrame) -> DataFrame:
    """(candidate, unit_id, parent, state): the card pipeline at rest.

    units are (unit_id); results are (job, terminal_state, passed, cards array<string>), a job being `page:<unit>`,
    `review:<candidate>` or `repair:<candidate>`.  A page's cards become candidates `<unit>/<ordinal>`, a failed
    one's repair gives `<candidate>/<ordinal>`.  A line ends when handed off, when a terminal state stops it, when a repair is
    empty, or it waits for a job.  Rounds go on while repairs give new candidates; every name is longer than its parent's, so
    they end with the results.
    """
    job = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    stop = F.col("terminal_state").isin(*TERMINAL)
    made = units.withColumn("job", job("page", "unit_id")).join(results.filter(~F.coalesce(stop, F.lit(False))), "job")
    level = made.select("unit_id", F.posexplode("cards").alias("ordinal", "title")).select(F.concat_ws("/", F.col("unit_id").cast("string"), F.col("ordinal").cast("string")).alias("candidate"), "unit_id", F.lit(None).cast("string").alias("parent"))
    done = []
    review = results.select(F.col("job").alias("r_job"), F.col("terminal_state").alias("r_end"), "passed")
    repair = results.select(F.col("job").alias("f_job"), F.col("terminal_state").alias("f_end"), "cards")
    while not level.isEmpty():
        seen = level.join(review, job("review", "candidate") == F.col("r_job"), "left").join(repair, job("repair", "candidate") == F.col("f_job"), "left")
        state = (
            F.when(F.col("r_job").isNull(), "in review")
            .when(F.col("r_end").isin(*TERMINAL), "stopped")
            .when(F.col("passed"), "handed off")
            .when(F.col("f_job").isNull(), "in repair")
            .when(F.col("f_end").isin(*TERMINAL), "stopped")
            .when(F.size("cards") <= 0, "ended")
            .otherwise("repaired")
        )
        seen = cut(seen.select("candidate", "unit_id", "parent", state.alias("state"), "cards"))
        done.append(seen.select("candidate", "unit_id", "parent", "state"))
        level = seen.filter("state = 'repaired'").select("unit_id", F.col("candidate").alias("parent"), F.posexplode("cards").alias("ordinal", "title")).select(F.concat_ws("/", "parent", F.col("ordinal").cast("string")).alias("candidate"), "unit_id", "parent")
    return reduce(DataFrame.union, done or [level.select("candidate", "unit_id", "parent", F.lit(None).cast("string").alias("state"))])
