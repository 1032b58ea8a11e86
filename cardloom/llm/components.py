"""Connected components of link tables too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed, lean


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, least node of its component) with the same components as the links a-b."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        label = np.minimum(label, new[label])
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = spanning(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joined(links: DataFrame) -> DataFrame:
    """Each link with the least neighbour of its `a`; the hot side is one that Spark can split."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(low, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node with a link the least node it can reach.

    Alternates the large-star and small-star steps until the links no longer change; every
    step keeps components whole, never holds more links than it was given, and reads what
    the last one wrote to the shared folder.  Links with a null end or from a node to itself say nothing.
    """
    links = links.toDF("a", "b").filter("a <> b").mapInArrow(lean(_contract), "a long, b long")
    links = checkpointed(links.distinct())
    mark = None
    while True:
        both = links.union(links.select("b", "a"))
        large = _joined(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _joined(large)
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(large.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        links = checkpointed(small)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return links.toDF("node", "component")
        mark = now
