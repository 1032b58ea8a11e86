from __future__ import annotations

import json
import time

import zstandard
from pyspark.sql import functions as F

from cardloom.operators.usage import quota_replay
from cardloom.streaming import events as S


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, rows, schema, folder):
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(2).write.parquet(str(folder))
    return spark.readStream.schema(batch.schema).parquet(str(folder))


def test_replayed_events_are_dropped(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:00:01"), (2, "2026-01-01 00:00:02")]
    stream = source(spark, rows, "event_id long, t string", tmp_path / "e").withColumn("occurred_at", F.to_timestamp("t"))
    assert sorted(r["event_id"] for r in drained(S.unique_events(stream), "unique_events").collect()) == [1, 2]


def test_windows_and_sessions(spark, tmp_path):
    rows = [(1, "success", 0), (1, "success", 60), (1, "success", 7200), (1, "error", 90), (2, "success", 400_000)]
    stream = source(spark, rows, "user_sub long, status string, s long", tmp_path / "e").withColumn("created_at", F.timestamp_seconds("s"))
    usage = drained(S.windowed_usage(stream), "windowed", "append").collect()
    assert [(r["user_sub"], r["searches"]) for r in usage] == [(1, 3)]
    found = drained(S.sessions(stream.filter("status = 'success'")), "sessions", "append").collect()
    assert sorted((r["user_sub"], r["searches"]) for r in found) == [(1, 1), (1, 2)]


def test_quota_stream_equals_replay(spark, tmp_path):
    policy = ((3, 100), (7, 1000))
    rows = [(i, i % 3, float(i * 17), 1 + i % 2) for i in range(90)]
    stream = source(spark, rows, "event_id long, user_sub long, at double, cost long", tmp_path / "q")
    got = {r["event_id"]: r["allowed"] for r in drained(S.quota_decisions(stream, policy), "quota").collect()}
    batch = spark.createDataFrame(rows, "event_id long, user_sub long, at double, cost long").withColumn("created_at", F.timestamp_seconds("at"))
    assert got == {r["event_id"]: r["allowed"] for r in quota_replay(batch, policy).collect()}


def test_continuations_flush_by_count(spark, tmp_path):
    stream = source(spark, [(1, i) for i in range(5)] + [(2, 0)], "scope_id long, node_id long", tmp_path / "c")
    query = S.continuation_buffer(stream, 5, 3_600_000).writeStream.format("memory").queryName("flushed").outputMode("append").start()
    until = time.monotonic() + 90  # a query with timeouts always has another batch, so processAllAvailable() would not return
    while spark.table("flushed").isEmpty() and time.monotonic() < until and query.exception() is None:
        time.sleep(0.5)
    query.stop()
    assert [tuple(r) for r in spark.table("flushed").collect()] == [(1, 5)]
