"""Domain views over the driver tables, with the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, title, content, embedding, state): documents that have a vector."""
    # Titles are taken before the join, so that who needs no contents moves none.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^[^.\n]{1,80}", 0).alias("title"), F.col("text").alias("content"))
    vectors = table(spark, sf_dir, "embeddings")
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select(
        (F.col("doc_id") + 1).alias("node_id"),
        "title",
        "content",
        "embedding",
        F.when(F.col("doc_id") % 17 == 0, "archived").otherwise("active").alias("state"),
    )


def card_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, embedding) of the cards, without their texts."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return vectors.join(docs.select("doc_id"), docs["doc_id"] == vectors["vec_id"], "left_semi").select((F.col("vec_id") + 1).alias("node_id"), "embedding")


def taxonomy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id, name, depth): Root, regions, nations."""
    root = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("Root").alias("name"), F.lit(0).cast("long").alias("depth"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 2).cast("long"), F.lit(1).cast("long"), "r_name", F.lit(1).cast("long"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long"), (F.col("n_regionkey") + 2).cast("long"), "n_name", F.lit(2).cast("long"))
    return root.union(regions).union(nations)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, taxonomy_node_id): one a card; some lie on regions and some on Root."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    place = F.when(F.col("c_custkey") % 97 == 0, F.lit(1)).when(F.col("c_custkey") % 10 == 0, F.col("n_regionkey") + 2).otherwise(F.col("c_nationkey") + 100)
    return customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 1).alias("node_id"), place.cast("long").alias("taxonomy_node_id"))


def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, article, views, rank): daily view lists by event type and user, ranked within the day."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    day = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("month"), F.concat("event_type", F.lit("_user_"), F.col("user_id").cast("string")).alias("article")).agg(F.count("*").alias("views"))
    return day.withColumn("rank", F.row_number().over(W.partitionBy("month").orderBy(F.desc("views"), "article")).cast("long"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_sub, status, query_hash, created_at, cost)."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "quota_rejected").otherwise("success")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user_sub"), status.alias("status"), F.col("ts").alias("created_at"), (F.floor(F.abs("value")).cast("long") % 3 + 1).alias("cost"))


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, raw_query): user turns."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("raw_query"))


#: The views above in DuckDB's SQL, to be put behind WITH.
SQL = {
    "cards": r"""cards AS (SELECT d.doc_id + 1 AS node_id, regexp_extract(d.text, '^[^.\n]{1,80}') AS title, d.text AS content, e.embedding::DOUBLE[] AS embedding,
      CASE WHEN d.doc_id % 17 = 0 THEN 'archived' ELSE 'active' END AS state FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)""",
    "edges": """pairs AS (SELECT a.node_id AS s, b.node_id AS r, greatest(0.0, least(1.0, (list_dot_product(a.embedding, b.embedding) + 1) / 2)) AS strength FROM cards a JOIN cards b ON b.node_id < a.node_id),
      edges AS (SELECT r AS node_a_id, s AS node_b_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY strength DESC, r) AS k FROM pairs WHERE strength >= 0.5) WHERE k <= 4)""",
    "tree": """tree AS (SELECT 1::BIGINT AS id, NULL::BIGINT AS parent_id, 'Root' AS name, 0::BIGINT AS depth
      UNION ALL SELECT (r_regionkey + 2)::BIGINT, 1, r_name, 1 FROM region
      UNION ALL SELECT (n_nationkey + 100)::BIGINT, (n_regionkey + 2)::BIGINT, n_name, 2 FROM nation)""",
    "assigned": """assigned AS (SELECT c_custkey + 1 AS node_id, (CASE WHEN c_custkey % 97 = 0 THEN 1 WHEN c_custkey % 10 = 0 THEN n_regionkey + 2 ELSE c_nationkey + 100 END)::BIGINT AS taxonomy_node_id
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "pageviews": """daily AS (SELECT strftime(ts, '%Y-%m-%d') AS month, event_type || '_user_' || user_id::VARCHAR AS article, count(*) AS views FROM events GROUP BY 1, 2),
      pageviews AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY views DESC, article) AS rank FROM daily)""",
    "usage": """usage AS (SELECT event_id, user_id AS user_sub, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'quota_rejected' ELSE 'success' END AS status,
      ts AS created_at, floor(abs(value))::BIGINT % 3 + 1 AS cost FROM events)""",
    "searches": "searches AS (SELECT conv_id AS session_id, turn, text AS raw_query FROM conversations WHERE role = 'user')",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
