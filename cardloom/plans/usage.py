"""Queries over usage events and agent searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import usage as U
from cardloom.sources import tables as D

SMALL = ((6, 86_400), (20, 604_800))  # a policy that the test events exceed
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _keys(spark, sf):
    return D.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_sub"))


def usage_summary(spark, sf):
    return U.summary(_keys(spark, sf), D.usage_events(spark, sf)).select("user_sub", "searches", _stamp("last_used_at"))


def status_histogram(spark, sf):
    return U.status_histogram(D.usage_events(spark, sf))


def query_hash_groups(spark, sf):
    return U.query_hashes(D.search_events(spark, sf)).groupBy("query_hash").agg(F.count("*").alias("searches"), F.countDistinct("session_id").alias("sessions"), F.min("log_hash").alias("log_hash"))


def exposure_explode(spark, sf):
    return U.exposures(D.search_events(spark, sf).withColumn("matched", F.slice(T.tokens(F.col("raw_query")), 1, 5)))


def session_paths(spark, sf):
    return U.session_paths(D.search_events(spark, sf))


def token_usage_rows(spark, sf):
    tokens = _keys(spark, sf).select((F.col("user_sub") * 10).alias("position"), F.col("user_sub").alias("fingerprint"))
    return U.token_rows(tokens, U.summary(_keys(spark, sf), D.usage_events(spark, sf))).select("position", "fingerprint", "searches", _stamp("last_used_at"))


def quota_replay(spark, sf):
    return U.quota_replay(D.usage_events(spark, sf), SMALL)


def quota_snapshot(spark, sf):
    return U.quota_snapshot(U.quota_replay(D.usage_events(spark, sf), SMALL), 1_706_659_200.0, SMALL)


def web_quota_replay(spark, sf):
    calls = D.usage_events(spark, sf).withColumnRenamed("user_sub", "principal")
    return U.web_quota_replay(calls.withColumn("ip", F.col("principal") % 40), (4, 86_400), (12, 604_800), ((10, 86_400), (40, 604_800)))


QUERIES = {f.__name__: f for f in (usage_summary, status_histogram, query_hash_groups, exposure_explode, session_paths, token_usage_rows, quota_replay, quota_snapshot, web_quota_replay)}

_U, _S = D.with_views("usage"), D.with_views("searches")
_SUM = "ok AS (SELECT user_sub, count(*) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM usage WHERE status = 'success' GROUP BY 1)"
_NORM = r"lower(trim(regexp_replace(raw_query, '\s+', ' ', 'g')))"
SQL = {
    "usage_summary": f"{_U}, {_SUM} SELECT c_custkey AS user_sub, coalesce(n, 0) AS searches, last_used_at FROM customer LEFT JOIN ok ON user_sub = c_custkey",
    "status_histogram": f"{_U} SELECT user_sub, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'quota_rejected') AS quota_rejected FROM usage GROUP BY 1",
    "query_hash_groups": f"{_S} SELECT sha256({_NORM}) AS query_hash, count(*) AS searches, count(DISTINCT session_id) AS sessions, min(substr(sha256(trim(raw_query)), 1, 16)) AS log_hash FROM searches GROUP BY 1",
    "exposure_explode": f"{_S}, m AS (SELECT session_id, turn, regexp_extract_all(lower(raw_query), '[a-z0-9]+')[1:5] AS t FROM searches) SELECT session_id, turn, unnest(t) AS node_id, generate_subscripts(t, 1) AS rank FROM m",
    "session_paths": f"{_S}, h AS (SELECT session_id, turn, sha256({_NORM}) AS query_hash FROM searches) SELECT session_id, turn, row_number() OVER w AS step, query_hash, lag(query_hash) OVER w AS previous_hash FROM h WINDOW w AS (PARTITION BY session_id ORDER BY turn)",
    "token_usage_rows": f"{_U}, {_SUM} SELECT c_custkey * 10 AS position, c_custkey AS fingerprint, coalesce(n, 0) AS searches, last_used_at FROM customer LEFT JOIN ok ON user_sub = c_custkey",
}

#: A user's calls one after the other through two windows: du and wu are used, de and we end; d0, e0, w0 and x0 the same once ended windows are cleared.
_LIMITS = "SELECT {0}::BIGINT AS ld, {1}::DOUBLE AS sd, {2}::BIGINT AS lw, {3}::DOUBLE AS sw".format(*(v for window in SMALL for v in window))
_QUOTA = f"""{_U.replace("WITH ", "WITH RECURSIVE ", 1)}, limits AS ({_LIMITS}),
  r AS (SELECT event_id, user_sub, cost, epoch_us(created_at) / 1000000.0::DOUBLE AS tt, row_number() OVER (PARTITION BY user_sub ORDER BY created_at, event_id) AS i FROM usage),
  f AS (SELECT DISTINCT user_sub, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS tt, true AS allowed, 0.0::DOUBLE AS wait, 0::BIGINT AS du, 0.0::DOUBLE AS de, 0::BIGINT AS wu, 0.0::DOUBLE AS we FROM r
    UNION ALL SELECT user_sub, i, event_id, tt, NOT (od OR ow),
      CASE WHEN od AND ow THEN least(CASE WHEN d0 > 0 THEN e0 - tt ELSE sd END, CASE WHEN w0 > 0 THEN x0 - tt ELSE sw END) WHEN od THEN CASE WHEN d0 > 0 THEN e0 - tt ELSE sd END WHEN ow THEN CASE WHEN w0 > 0 THEN x0 - tt ELSE sw END ELSE 0 END,
      CASE WHEN od OR ow THEN d0 ELSE d0 + cost END, CASE WHEN od OR ow OR d0 > 0 THEN e0 ELSE tt + sd END, CASE WHEN od OR ow THEN w0 ELSE w0 + cost END, CASE WHEN od OR ow OR w0 > 0 THEN x0 ELSE tt + sw END
    FROM (SELECT *, d0 + cost > ld AS od, w0 + cost > lw AS ow FROM (SELECT r.*, limits.*, CASE WHEN du > 0 AND r.tt >= de THEN 0 ELSE du END AS d0, CASE WHEN du > 0 AND r.tt >= de THEN 0 ELSE de END AS e0, CASE WHEN wu > 0 AND r.tt >= we THEN 0 ELSE wu END AS w0, CASE WHEN wu > 0 AND r.tt >= we THEN 0 ELSE we END AS x0
      FROM f JOIN r ON r.user_sub = f.user_sub AND r.i = f.i + 1, limits))),
  decisions AS (SELECT event_id, user_sub, allowed, wait AS retry_after, greatest(ld - du, 0) AS daily_remaining, greatest(lw - wu, 0) AS weekly_remaining, CASE WHEN du > 0 THEN de END AS daily_reset, CASE WHEN wu > 0 THEN we END AS weekly_reset, tt, i FROM f, limits WHERE i > 0)"""
_AT = 1_706_659_200.0
SQL["quota_replay"] = f"{_QUOTA} SELECT * EXCLUDE (i, tt), tt AS \"at\" FROM decisions"
SQL["quota_snapshot"] = f"""{_QUOTA}, last AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY user_sub ORDER BY i DESC) = 1),
  live AS (SELECT user_sub, coalesce(daily_reset > {_AT}, false) AS d, coalesce(weekly_reset > {_AT}, false) AS w, daily_remaining, weekly_remaining, daily_reset, weekly_reset, ld, sd, lw, sw FROM last, limits)
  SELECT user_sub, CASE WHEN d THEN ld - daily_remaining ELSE 0 END AS daily_used, CASE WHEN d THEN daily_remaining ELSE ld END AS daily_remaining, CASE WHEN d THEN daily_reset - sd END AS daily_started_at, CASE WHEN d THEN daily_reset END AS daily_reset_at,
    CASE WHEN w THEN lw - weekly_remaining ELSE 0 END AS weekly_used, CASE WHEN w THEN weekly_remaining ELSE lw END AS weekly_remaining, CASE WHEN w THEN weekly_reset - sw END AS weekly_started_at, CASE WHEN w THEN weekly_reset END AS weekly_reset_at FROM live"""
#: Requests of one key one after the other: the first window counts, and the second only if the first lets the request pass.
_WEB = lambda rows, name, burst, total: f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tt, event_id) AS i FROM ({rows})),
  {name}_f AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS other, NULL::DOUBLE AS tt, true AS allowed, 0.0::DOUBLE AS wait, 0::BIGINT AS bu, 0.0::DOUBLE AS be, 0::BIGINT AS tu, 0.0::DOUBLE AS te FROM {name}_r
    UNION ALL SELECT key, i, event_id, other, tt, NOT (ob OR ot), CASE WHEN ob THEN b1 - tt WHEN ot THEN t1 - tt ELSE 0 END, b0 + 1, b1, CASE WHEN ob THEN tu ELSE t0 + 1 END, CASE WHEN ob THEN te ELSE t1 END
    FROM (SELECT *, b0 + 1 > {burst[0]} AS ob, b0 + 1 <= {burst[0]} AND t0 + 1 > {total[0]} AS ot FROM (SELECT r.*, f.tu, f.te, CASE WHEN bu = 0 OR r.tt >= be THEN 0 ELSE bu END AS b0, CASE WHEN bu = 0 OR r.tt >= be THEN r.tt + {burst[1]} ELSE be END AS b1,
      CASE WHEN tu = 0 OR r.tt >= te THEN 0 ELSE tu END AS t0, CASE WHEN tu = 0 OR r.tt >= te THEN r.tt + {total[1]} ELSE te END AS t1 FROM {name}_f f JOIN {name}_r r ON r.key = f.key AND r.i = f.i + 1)))"""  # noqa: E731
_FIRST = "SELECT event_id, user_sub AS key, user_sub % 40 AS other, epoch_us(created_at) / 1000000.0::DOUBLE AS tt FROM usage"
SQL["web_quota_replay"] = f"""{_U.replace("WITH ", "WITH RECURSIVE ", 1)}, {_WEB(_FIRST, "own", (4, 86_400), (12, 604_800))}, {_WEB("SELECT event_id, other AS key, key AS other, tt FROM own_f WHERE i > 0 AND allowed", "ip", (10, 86_400), (40, 604_800))}
  SELECT event_id, key AS principal, allowed, wait AS retry_after FROM own_f WHERE i > 0 AND NOT allowed UNION ALL SELECT event_id, other, allowed, wait FROM ip_f WHERE i > 0"""
