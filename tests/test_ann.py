"""Approximate search against exact search."""

from __future__ import annotations

import numpy as np
import pytest

from cardloom.operators import ann
from cardloom.operators import search as S


def vectors_of(spark, n=1500, dim=16, seed=2):
    """Unit vectors around some directions, a third of them at one of these."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    own = centres[np.where(rng.random(n) < 0.33, 0, rng.integers(0, 12, n))] + rng.normal(0, 0.35, (n, dim))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    return spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(own)], "node_id long, embedding array<double>").repartition(4)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return ann.VectorIndex(spark, f"file://{tmp_path_factory.mktemp('ann')}/index").build(vectors_of(spark), k=5)


def asked(vectors):
    return vectors.filter("node_id % 10 = 0").withColumnRenamed("node_id", "query_id")


def test_recall_and_share(spark, index, monkeypatch):
    monkeypatch.setattr(ann, "PART", 100)
    vectors = vectors_of(spark)
    exact = S.vector_topk(asked(vectors), vectors, 5)
    got = ann.recall(index.search(asked(vectors), 5), exact).first()
    assert index.settings()["recall"] >= 0.95 and got["n_exact"] == 5 * asked(vectors).count() and got["recall"] >= 0.93
    assert 0 < index.share(asked(vectors)) < 0.6 and index.settings()["probes"] < len(index._centres())
    everywhere = index.search(asked(vectors), 5, probes=10**6)
    rows = lambda df, rank: sorted((r["query_id"], r[rank], r["node_id"], round(r["similarity"], 9)) for r in df.collect())
    assert rows(everywhere, "rank") == rows(exact, "vector_rank") and ann.recall(everywhere, exact).first()["recall"] == 1


def test_equal_vectors_are_ranked_by_id(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)] + [(1000, [0.0, 1.0])], "node_id long, embedding array<double>")
    index = ann.VectorIndex(spark, f"file://{tmp_path}/same").build(same, k=3)
    query = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["node_id"], r["rank"]) for r in index.search(query, 3).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "node_id long, embedding array<double>")
    index = ann.VectorIndex(spark, f"file://{tmp_path}/none").build(none)
    query = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert index.search(query, 3).count() == 0
