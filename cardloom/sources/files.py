"""Readers and writers of the corpus files; everything is read by Spark, so any file system it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("clean_text", T.StringType())])
CANDIDATE = T.StructType([T.StructField(n, t) for n, t in (("selection_rank", T.LongType()), ("page_id", T.LongType()), ("title", T.StringType()), ("url", T.StringType()), ("total_views", T.LongType()), ("months_seen", T.LongType()), ("best_rank", T.LongType()), ("score", T.LongType()), ("text_length", T.LongType()))])


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, title, url, clean_text, shard) of split-*/shard-*.jsonl.zst below folder; blank lines are skipped."""
    rows = spark.read.schema(SHARD).option("mode", "FAILFAST").json(f"{folder}/split-*/shard-*.jsonl.zst")
    return rows.select("page_id", "title", F.col("source_url").alias("url"), "clean_text", F.input_file_name().alias("shard"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, plain or compressed, of one file or of all below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows with their file; a line of the wrong shape fails the read."""
    return spark.read.schema(CANDIDATE).option("mode", "FAILFAST").json(path).withColumn("path", F.input_file_name())


def monthly_views(spark: SparkSession, folder: str) -> DataFrame:
    """(month, article, views, rank) of landed monthly payloads month=YYYY-MM/*.json, each an array of {article, views, rank}."""
    row = T.StructType([T.StructField("article", T.StringType()), T.StructField("views", T.LongType()), T.StructField("rank", T.LongType())])
    return spark.read.schema(row).option("multiLine", "true").option("basePath", folder).json(f"{folder}/month=*").select(F.regexp_extract(F.input_file_name(), "month=([0-9]{4}-[0-9]{2})", 1).alias("month"), "article", "views", "rank")


def taxonomy_rows(text: str, reserved: str = "unclassified") -> list[tuple[int, int | None, str, int]]:
    """(id, parent_id, name, depth) of a YAML tree, Root first and the rest in reading order.

    A tree is a mapping of names to subtrees, a list of names and mappings, a name, or nothing.
    """
    import yaml

    tree = yaml.safe_load(text)
    if not isinstance(tree, dict):
        raise ValueError("the top of a taxonomy must be a mapping")
    rows: list[tuple[int, int | None, str, int]] = [(1, None, "Root", 0)]

    def add(name: object, parent: int, depth: int) -> int:
        name = str(name).strip()
        if not name or name.lower() == reserved:
            raise ValueError(f"not a usable name: {name!r}")
        rows.append((len(rows) + 1, parent, name, depth))
        return len(rows)

    def walk(node: object, parent: int, depth: int) -> None:
        if node is None:
            return
        if isinstance(node, dict):
            for name, below in node.items():
                walk(below, add(name, parent, depth), depth + 1)
        elif isinstance(node, list):
            for item in node:
                walk(item, parent, depth)
        else:
            add(node, parent, depth)

    walk(tree, 1, 1)
    return rows


def taxonomy(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(taxonomy_rows(text), "id long, parent_id long, name string, depth long")


def batch_config(text: str) -> list[dict]:
    """Batches {name, query, limit} of a YAML file."""
    import yaml

    found = yaml.safe_load(text).get("batches") or []
    for batch in found:
        if set(batch) != {"name", "query", "limit"} or int(batch["limit"]) < 1:
            raise ValueError(f"a batch has a name, a query and a limit of at least 1: {batch}")
    return found


def write_selection(rows: DataFrame, folder: str) -> None:
    """Selected rows as JSON lines and as CSV with a header, and the counts by reason as JSON."""
    rows.write.mode("overwrite").json(f"{folder}/candidates.jsonl")
    rows.write.mode("overwrite").option("header", "true").csv(f"{folder}/candidates.csv")
    if "reason" in rows.columns:
        rows.groupBy("reason").count().write.mode("overwrite").json(f"{folder}/summary.json")


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder a table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
