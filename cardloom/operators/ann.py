"""Approximate nearest neighbours over an inverted file of cells.

Vectors lie in the cell of their nearest centroid and are stored sorted by cell, so a search reads the cells near its
queries and no others; inside them products are exact.  Centroids are fitted on a bounded sample, every vector is indexed.
How many cells a query looks into is chosen when the index is built: on a probe set, against exact search, the fewest
whose neighbours reach the recall asked for; a search can ask for more, and with all cells it is exact.

Vectors of length one are meant, so the product is the cosine.  A cell may hold any share of the vectors: its vectors, and the
queries that look into it, meet in parts of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.operators.graph import blocked_topk
from cardloom.sources import versioned

#: Vectors that centroids are fitted on, and vectors of the probe set, at most.
SAMPLE, PROBES = 65_536, 256
#: Cells: the root of the vectors, at most this many; with more vectors cells grow.
MOST_CELLS = 4096
ROUNDS = 12
#: Vectors of a cell that meet queries in one task, and queries that meet them.
PART = 8192
RECALL = 0.95


def _flat(column: pa.Array) -> np.ndarray:
    """A list column of vectors as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def centroids_of(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of the vectors: k-means by products, with the same start every time."""
    rng = np.random.default_rng(7)
    centres = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        cell = nearest(vectors, centres, 1)[:, 0]
        order = np.argsort(cell, kind="stable")
        own, first = np.unique(cell[order], return_index=True)
        centres[own] = np.add.reduceat(vectors[order], first)
        lost = np.setdiff1d(np.arange(len(centres)), own)
        centres[lost] = vectors[rng.choice(len(vectors), len(lost))]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first."""
    n, out = min(n, len(centres)), []
    for lo in range(0, len(vectors), 1024):
        s = vectors[lo : lo + 1024] @ centres.T
        some = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(n), s.shape)
        out.append(np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def _celled(df: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    """(key, v, cell, place): a row for each of the n nearest cells of a vector."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = nearest(_flat(batch.column("v")), shared.value, n)
            row = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(row), batch.column("v").take(row), pa.array(found.ravel().astype(np.int32)), pa.array(np.tile(np.arange(found.shape[1], dtype=np.int32), batch.num_rows))], names=[key, "v", "cell", "place"])

    return df.mapInArrow(place, f"{key} long, v {df.schema['v'].dataType.simpleString()}, cell int, place int")


class VectorIndex:
    """The index below a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, k: int = 10, recall: float = RECALL, cells: int | None = None) -> VectorIndex:
        """Index vectors (node_id, embedding), none null, in place of what the folder holds; k and recall are what probes are chosen for."""
        own = vectors.select(F.col("node_id").cast("long").alias("node_id"), F.col("embedding").alias("v"))
        by_hash = own.orderBy(F.xxhash64("node_id"), "node_id")
        n = own.count()
        sample = _flat(by_hash.limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()) if n else np.zeros((0, 1))
        centres = centroids_of(sample, cells or max(1, min(MOST_CELLS, round(n**0.5)))) if n else np.zeros((0, 1))
        rows = _celled(own, "node_id", centres, 1).drop("place") if n else own.select("node_id", "v", F.lit(0).alias("cell")).limit(0)
        stored = rows.repartitionByRange("cell", "node_id").sortWithinPartitions("cell", "node_id")
        listed = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
        settings = lambda probes, reached: self.spark.createDataFrame([(json.dumps({"probes": probes, "recall": reached}),)], "settings string")
        versioned.publish(self.root, {"vectors": stored, "centroids": listed, "settings": settings(len(centres), 1.0)}, **{"parquet.block.size": str(1 << 20)})
        if n:
            chosen, reached = self._chosen(by_hash.limit(PROBES), own, centres, k, recall)
            versioned.publish(self.root, {"settings": settings(chosen, reached)})
        return self

    def _chosen(self, probes: DataFrame, own: DataFrame, centres: np.ndarray, k: int, recall: float) -> tuple[int, float]:
        """The fewest cells in which probes find that share of their k exact neighbours."""
        probes = probes.select(F.col("node_id").alias("id"), "v")
        exact = blocked_topk(probes, own.select(F.col("node_id").alias("id"), "v"), k).select("src", "dst")
        held = versioned.read(self.spark, self.root, "vectors").select(F.col("node_id").alias("dst"), "cell")
        order = _celled(probes, "id", centres, len(centres)).select(F.col("id").alias("src"), "cell", "place")
        places = exact.join(held, "dst").join(order, ["src", "cell"]).groupBy("place").count().orderBy("place").toPandas()  # a row a place
        share = places["count"].cumsum() / places["count"].sum()
        at = int((share >= recall).to_numpy().argmax())
        return int(places["place"].iloc[at]) + 1, float(share.iloc[at])

    def settings(self) -> dict:
        """probes: cells that a search looks into; recall: what they reached on the probe set."""
        return json.loads(versioned.read(self.spark, self.root, "settings").first()["settings"])

    def _centres(self) -> np.ndarray:
        rows = versioned.read(self.spark, self.root, "centroids").orderBy("cell").toArrow()  # at most MOST_CELLS
        return _flat(rows["centroid"].combine_chunks()) if len(rows) else np.zeros((0, 1))

    def _sizes(self) -> DataFrame:
        return versioned.read(self.spark, self.root, "vectors").groupBy("cell").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, node_id, similarity, rank): the k best vectors in the nearest cells of each query (query_id, embedding), ties by id."""
        centres = self._centres()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("v"))
        if not len(centres):
            return asked.select("query_id", F.lit(0).cast("long").alias("node_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("rank")).limit(0)
        looks = _celled(asked, "query_id", centres, probes or self.settings()["probes"]).drop("place")
        cells = [r["cell"] for r in looks.select("cell").distinct().collect()]  # at most MOST_CELLS
        vectors = versioned.read(self.spark, self.root, "vectors").filter(F.col("cell").isin(cells))
        parts = self._sizes().select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        counts = looks.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("q_parts"))
        grid = F.broadcast(parts.join(counts, "cell"))  # at most MOST_CELLS rows
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = looks.join(grid, "cell").select("cell", "query_id", "v", own("query_id", "q_parts").alias("i"), every("parts").alias("j"))
        right = vectors.join(grid, "cell").select(F.col("cell").alias("c2"), "node_id", F.col("v").alias("w"), every("q_parts").alias("i2"), own("node_id", "parts").alias("j2"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return pa.table({"query_id": pa.array([], pa.int64()), "node_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
            ids = b["node_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, w = ids[order], _flat(b["w"].combine_chunks())[order]
            q, v = a["query_id"].to_numpy(), _flat(a["v"].combine_chunks())
            out = []
            for lo in range(0, len(v), 256):
                s = v[lo : lo + 256] @ w.T
                if k < s.shape[1]:  # all that reach the k-th product, so that ties are settled by id
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    r, c = np.nonzero(s >= least[:, None])
                else:
                    r, c = (x.ravel() for x in np.indices(s.shape))
                out.append((q[lo + r], ids[c], s[r, c]))
            found = [np.concatenate(x) for x in zip(*out, strict=True)]
            by = np.lexsort((found[1], -found[2], found[0]))
            src = found[0][by]
            first = np.flatnonzero(np.diff(src, prepend=src[0] - 1))
            keep = by[np.arange(len(by)) - np.repeat(first, np.diff(first, append=len(by))) < k]
            return pa.table({"query_id": found[0][keep], "node_id": found[1][keep], "similarity": found[2][keep]})

        part = left.groupBy("cell", "i", "j").cogroup(right.groupBy("c2", "i2", "j2")).applyInArrow(meet, "query_id long, node_id long, similarity double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id")).cast("long")
        return part.withColumn("rank", rank).filter(F.col("rank") <= k)

    def share(self, queries: DataFrame, probes: int | None = None) -> float:
        """The share of all query-vector pairs that a search of these queries takes products of."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("v"))
        looks = _celled(asked, "query_id", self._centres(), probes or self.settings()["probes"])
        sizes = self._sizes()
        met = looks.groupBy("cell").agg(F.count("*").alias("q")).join(sizes, "cell").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0
        total = asked.count() * (sizes.agg(F.sum("n")).first()[0] or 0)
        return met / total if total else 0.0


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs of the exact result (query_id, node_id), those of them found, and their share."""
    both = exact.select("query_id", "node_id").join(found.select("query_id", "node_id", F.lit(1).alias("hit")), ["query_id", "node_id"], "left")
    rows = both.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return rows.withColumn("recall", F.when(F.col("n_exact") > 0, F.col("n_found") / F.col("n_exact")).otherwise(1.0))
