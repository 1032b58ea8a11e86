"""Shard import with states: each line of a shard is imported once or kept in quarantine, whatever stops the run.

A stream finds the shards of a folder and hands them over in batches.  A batch first claims its shards; then its documents, its bad lines
and the shards' new states become visible together, as one version (`sources.versioned`).  A run that is stopped before that
leaves claims and nothing else, one that is stopped after it finds its shards completed when the batch is played again.

States: a shard without one is pending; `running` names a worker and since when; `completed` and `failed` end a try.  Failed shards,
and running ones whose claim is older than `stale`, are taken by the next run; a younger claim of another worker stops the run.

A line is bad if it is no JSON object of the shard's columns or has no page_id; blank lines are nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cardloom.sources import versioned
from cardloom.sources.files import SHARD

STALE = dt.timedelta(minutes=30)
GLOB = "*.jsonl*"
_STATES = "shard string, state string, worker string, at timestamp, documents long, bad_lines long, error string"
_BAD = "_bad"


class ClaimedElsewhere(RuntimeError):
    """Another worker holds a shard of the batch."""


def shards_in(spark: SparkSession, folder: str, glob: str = GLOB) -> DataFrame:
    """(shard): the files of a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("shard"))


def states(spark: SparkSession, root: str) -> DataFrame:
    """The last state of each shard that has one."""
    found = versioned.current(spark, root)
    if found is None:
        return spark.createDataFrame([], _STATES)
    rows = versioned.read(spark, root, "shards", found).withColumn("order", F.col("version"))
    last = F.row_number().over(W.partitionBy("shard").orderBy(F.desc("order")))
    return rows.withColumn("n", last).filter("n = 1").select(*[c.split()[0] for c in _STATES.split(", ")])


def import_plan(spark: SparkSession, folder: str, root: str, now: dt.datetime, stale: dt.timedelta = STALE) -> DataFrame:
    """One row: shards, completed, failed, running, stale, pending, documents, bad_lines, and those a run would take (todo)."""
    rows = shards_in(spark, folder).join(states(spark, root), "shard", "left")
    old = F.coalesce(F.col("at") < F.lit(now - stale), F.lit(False))
    state = F.when(F.col("state").isNull(), "pending").when((F.col("state") == "running") & old, "stale").otherwise(F.col("state"))
    n = lambda *names: F.count(F.when(state.isin(*names), 1))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col(c))), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("shards"), *[n(s).alias(s) for s in ("completed", "failed", "running", "stale", "pending")], total("documents"), total("bad_lines"), n("pending", "failed", "stale").alias("todo"))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value, shard) with the shard's columns, and whether each is bad; blank lines are left out."""
    shape = T.StructType([*SHARD.fields, T.StructField(_BAD, T.StringType())])
    rows = lines.filter(F.trim("value") != "").withColumn("_r", F.from_json("value", shape, {"columnNameOfCorruptRecord": _BAD}))
    bad = F.col("_r").isNull() | F.col(f"_r.{_BAD}").isNotNull() | F.col("_r.page_id").isNull()
    return rows.select("shard", "value", "_r.page_id", "_r.title", F.col("_r.source_url").alias("url"), "_r.clean_text", bad.alias("bad"))


def import_batch(lines: DataFrame, root: str, worker: str, now: dt.datetime, stale: dt.timedelta = STALE) -> dict:
    """Import the shards of lines (value, shard) that are not completed; documents, bad lines and seconds of this batch."""
    spark = lines.sparkSession
    names = [r["shard"] for r in lines.select("shard").distinct().collect()]  # a batch's shards: the stream bounds them
    known = {r["shard"]: r for r in states(spark, root).filter(F.col("shard").isin(names)).collect()}
    todo = [n for n in names if n not in known or known[n]["state"] != "completed"]
    held = [n for n in todo if n in known and known[n]["state"] == "running" and known[n]["worker"] != worker and known[n]["at"] >= now - stale]
    if held:
        raise ClaimedElsewhere(f"{known[held[0]]['worker']} holds {held[0]}")
    if not todo:
        return {"documents": 0, "bad_lines": 0, "seconds": 0.0}
    _publish(spark, root, {"shards": spark.createDataFrame([(n, "running", worker, now, None, None, None) for n in todo], _STATES)})
    rows = parsed(lines.filter(F.col("shard").isin(todo)))
    seen = Observation()
    began = dt.datetime.now()
    try:
        counted = rows.groupBy("shard").agg(F.count(F.when(~F.col("bad"), 1)).alias("documents"), F.count(F.when(F.col("bad"), 1)).alias("bad_lines"))
        ended = counted.select("shard", F.lit("completed").alias("state"), F.lit(worker).alias("worker"), F.lit(now).alias("at"), "documents", "bad_lines", F.lit(None).cast("string").alias("error"))
        blank = spark.createDataFrame([(n,) for n in todo], "shard string").join(counted, "shard", "left_anti")
        ended = ended.unionByName(blank.select("shard", F.lit("completed").alias("state"), F.lit(worker).alias("worker"), F.lit(now).alias("at"), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("bad_lines"), F.lit(None).cast("string").alias("error")))
        good = rows.filter("NOT bad").select("page_id", "title", "url", "clean_text", "shard").observe(seen, F.count("*").alias("documents"))
        _publish(spark, root, {"documents": good, "quarantine": rows.filter("bad").select("shard", F.col("value").alias("line")), "shards": ended})
    except Exception as error:
        _publish(spark, root, {"shards": spark.createDataFrame([(n, "failed", worker, now, None, None, str(error)[:500]) for n in todo], _STATES)})
        raise
    seconds = (dt.datetime.now() - began).total_seconds()
    bad = versioned.current(spark, root).tables["quarantine"][-1]
    return {"documents": seen.get["documents"], "bad_lines": spark.read.parquet(bad).count(), "seconds": seconds}


def _publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Add the rows as one version, each with its number: of a shard's states, or of a page's copies, the last counts."""
    last = versioned.current(spark, root)
    number = 0 if last is None else last.number + 1
    versioned.publish(root, {name: rows.withColumn("version", F.lit(number)) for name, rows in tables.items()}, add=True)


def import_shards(spark: SparkSession, folder: str, root: str, checkpoint: str, worker: str = "import", files: int = 8, now=dt.datetime.now, stale: dt.timedelta = STALE, report: list | None = None, glob: str = GLOB) -> StreamingQuery:
    """Import every shard of a folder that is not completed and stop; `files` shards a batch.  Each batch's counts are added to report."""
    lines = spark.readStream.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("shard"))

    def take(batch: DataFrame, _: int) -> None:
        done = import_batch(batch, root, worker, now(), stale)
        if report is not None:
            report.append(done)

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry(spark: SparkSession, folder: str, root: str, worker: str = "import", now=dt.datetime.now, stale: dt.timedelta = STALE) -> dict | None:
    """Import once more what a finished stream left failed or stale; None if there is nothing."""
    rows = shards_in(spark, folder).join(states(spark, root), "shard").filter((F.col("state") == "failed") | ((F.col("state") == "running") & (F.col("at") < F.lit(now() - stale))))
    names = [r["shard"] for r in rows.select("shard").collect()]  # file names alone
    if not names:
        return None
    lines = spark.read.text(names).select("value", F.col("_metadata.file_path").alias("shard"))
    return import_batch(lines, root, worker, now(), stale)


def imported(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, title, url, clean_text): the last import of each page; within a version the last shard by name."""
    rows = versioned.read(spark, root, "documents")
    last = rows.groupBy("page_id").agg(F.max_by(F.struct("title", "url", "clean_text"), F.struct("version", "shard", "clean_text")).alias("m"))
    return last.select("page_id", "m.*")


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """(shard, line): the bad lines of the shards' last imports."""
    return versioned.read(spark, root, "quarantine").select("shard", "line")


def import_rate(report: list[dict]) -> dict:
    """Documents, bad lines, seconds and documents a second of a run's batches."""
    total = {k: sum(r[k] for r in report) for k in ("documents", "bad_lines", "seconds")}
    return total | {"documents_per_second": total["documents"] / max(0.001, total["seconds"])}
