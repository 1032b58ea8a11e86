"""Usage ledgers, search analytics and quota replays."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T

#: Fixed values: (limit, window in seconds) of the daily and the weekly quota.
POLICY = ((1000, 86_400), (5000, 604_800))


def summary(keys: DataFrame, events: DataFrame) -> DataFrame:
    """(user_sub, searches, last_used_at) for every requested key: successes only, 0 and null where there are none."""
    used = events.filter("status = 'success'").groupBy("user_sub").agg(F.count("*").alias("n"), F.max("created_at").alias("last_used_at"))
    return keys.select("user_sub").distinct().join(used, "user_sub", "left").select("user_sub", F.coalesce("n", F.lit(0)).alias("searches"), "last_used_at")


def status_histogram(events: DataFrame) -> DataFrame:
    """One row a user with a count for each status."""
    names = ("success", "error", "quota_rejected")
    return events.groupBy("user_sub").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])


def query_hashes(searches: DataFrame) -> DataFrame:
    """searches with the hashes of the ledger (stripped text), of analytics (normalised text) and of the log (16 digits)."""
    raw, same = F.trim("raw_query"), T.normalised(F.col("raw_query"))
    return searches.withColumns({"ledger_hash": T.sha256(raw), "query_hash": T.sha256(same), "log_hash": F.substring(T.sha256(raw), 1, 16)})


def exposures(searches: DataFrame) -> DataFrame:
    """(session_id, turn, node_id, rank): one row a shown result of the array `matched`."""
    return searches.select("session_id", "turn", F.posexplode("matched").alias("pos", "node_id")).select("session_id", "turn", "node_id", (F.col("pos") + 1).cast("long").alias("rank"))


def session_paths(searches: DataFrame) -> DataFrame:
    """Each search of a session with its step and the query before it."""
    order = W.partitionBy("session_id").orderBy("turn")
    hashed = query_hashes(searches)
    return hashed.select("session_id", "turn", F.row_number().over(order).cast("long").alias("step"), "query_hash", F.lag("query_hash").over(order).alias("previous_hash"))


def fingerprinter(secret: str) -> Callable[[str], str]:
    return lambda token: "pat_" + hmac.new(secret.encode(), token.encode(), hashlib.sha256).hexdigest()


def with_fingerprints(tokens: DataFrame, secret: str) -> DataFrame:
    """tokens (position, token) with the HMAC fingerprint in place of the token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = fingerprinter(secret)
        for batch in batches:
            yield pd.DataFrame({"position": batch["position"], "fingerprint": batch["token"].map(of)})

    return tokens.select("position", "token").mapInPandas(run, "position long, fingerprint string")


def token_rows(tokens: DataFrame, usage: DataFrame | None) -> DataFrame:
    """(position, fingerprint, searches, last_used_at) in the tokens' order; without a usage table all unknown."""
    if usage is None:
        return tokens.select("position", "fingerprint", F.lit(None).cast("long").alias("searches"), F.lit(None).cast("timestamp").alias("last_used_at"))
    own = usage.withColumnRenamed("user_sub", "fingerprint")
    return tokens.join(own, "fingerprint", "left").select("position", "fingerprint", F.coalesce("searches", F.lit(0)).alias("searches"), "last_used_at")


def quota_step(state: list[list[float]], now: float, cost: int, policy=POLICY) -> tuple[bool, float, list[int]]:
    """One call against windows that open at first use; all or nothing. state is [[used, ends], ...] and changes in place."""
    for window in state:
        if window[0] and now >= window[1]:
            window[0] = window[1] = 0
    over = [i for i, (limit, _) in enumerate(policy) if state[i][0] + cost > limit]
    if over:
        wait = min(state[i][1] - now if state[i][0] else policy[i][1] for i in over)
        return False, wait, [max(limit - int(w[0]), 0) for w, (limit, _) in zip(state, policy, strict=True)]
    for window, (_, seconds) in zip(state, policy, strict=True):
        if not window[0]:
            window[1] = now + seconds
        window[0] += cost
    return True, 0.0, [max(limit - int(w[0]), 0) for w, (limit, _) in zip(state, policy, strict=True)]


def web_quota_step(state: dict, now: float, keys: list[tuple], cost: int = 1) -> tuple[bool, float]:
    """One request against windows (key, limit, seconds), each counted before it is tested; the first refusal ends the request and what was counted stays."""
    for key, limit, seconds in keys:
        used, ends = state.get(key, (0, 0.0))
        if not used or now >= ends:
            used, ends = 0, now + seconds
        state[key] = (used + cost, ends)
        if used + cost > limit:
            return False, ends - now
    return True, 0.0


def _folded(events: DataFrame, key: str, order: list[str], fold, schema: str) -> DataFrame:
    """Events of a key in order through `fold(state, row) -> output row`; a key's state is carried across batches, its events are never gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != last:
                    last, state = getattr(row, key), {}
                out.append(fold(state, row))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def quota_replay(events: DataFrame, policy=POLICY) -> DataFrame:
    """Decision on each call (event_id, user_sub, created_at, cost) of a user, in time order."""

    def fold(state: dict, row) -> tuple:
        windows = state.setdefault("w", [[0, 0.0] for _ in policy])
        allowed, wait, left = quota_step(windows, row.at, int(row.cost), policy)
        return row.event_id, row.user_sub, allowed, wait, left[0], left[1], *(w[1] if w[0] else None for w in windows), row.at

    timed = events.select("event_id", "user_sub", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"), "cost").withColumn("at", F.col("us") / 1e6).drop("us")
    return _folded(timed, "user_sub", ["at", "event_id"], fold, "event_id long, user_sub long, allowed boolean, retry_after double, daily_remaining long, weekly_remaining long, daily_reset double, weekly_reset double, at double")


def quota_snapshot(decisions: DataFrame, now: float, policy=POLICY) -> DataFrame:
    """For both windows of each user of `quota_replay` at `now` (seconds): used, remaining, started_at and reset_at.

    The last call by time (then event_id) tells; a window that has ended by then, or never began, is unused and has no times.
    """
    last = decisions.groupBy("user_sub").agg(F.max_by(F.struct("daily_remaining", "weekly_remaining", "daily_reset", "weekly_reset"), F.struct("at", "event_id")).alias("r"))
    columns = []
    for name, (limit, seconds) in zip(("daily", "weekly"), policy, strict=True):
        live, reset = F.coalesce(F.col(f"r.{name}_reset") > now, F.lit(False)), F.col(f"r.{name}_reset")
        left = F.when(live, F.col(f"r.{name}_remaining")).otherwise(limit)
        columns += [(limit - left).cast("long").alias(f"{name}_used"), left.cast("long").alias(f"{name}_remaining")]
        columns += [F.when(live, reset - seconds).alias(f"{name}_started_at"), F.when(live, reset).alias(f"{name}_reset_at")]
    return last.select("user_sub", *columns)


def web_quota_replay(requests: DataFrame, burst: tuple[int, int] = (20, 3600), total: tuple[int, int] = (200, 86_400), ip: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """Decision on each request (event_id, principal, created_at, with `ip` windows also ip): (event_id, principal, allowed, retry_after).

    Windows count before they are tested, in the order principal's burst and total, address's burst and total; the
    first refusal ends a request, and what was counted stays.  An address thus counts just what its principals let pass, so
    principals are replayed first and addresses after them.
    """

    def fold_by(key: str, limits) -> Callable:
        def fold(state: dict, row) -> tuple:
            allowed, wait = web_quota_step(state, row.at, [((key, name), *limit) for name, limit in zip(("burst", "total"), limits, strict=True)])
            return row.event_id, getattr(row, key), row.other, row.at, allowed, wait

        return fold

    kept = "event_id long, {} long, other long, at double, allowed boolean, retry_after double"
    other = F.col("ip").cast("long") if ip else F.lit(None).cast("long")
    timed = requests.select("event_id", "principal", other.alias("other"), (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("at"))
    own = _folded(timed, "principal", ["at", "event_id"], fold_by("principal", (burst, total)), kept.format("principal"))
    if ip:
        passed = own.filter("allowed").select("event_id", F.col("other").alias("ip"), F.col("principal").alias("other"), "at")
        second = _folded(passed, "ip", ["at", "event_id"], fold_by("ip", ip), kept.format("ip"))
        own = own.filter("NOT allowed").select("event_id", "principal", "allowed", "retry_after").union(second.select("event_id", "other", "allowed", "retry_after"))
    return own.select("event_id", "principal", "allowed", "retry_after")
