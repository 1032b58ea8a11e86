"""Taxonomy trees: paths, counts, views, scopes and their graphs.

Trees are (id, parent_id, name, depth) and small beside the cards; they are read by level, one
join a level, until a level is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T

_PRINTS = pa.schema([("scope_id", pa.int64()), ("fingerprint", pa.string())])

def paths(tree: DataFrame) -> DataFrame:
    """tree with route_slug, route_path (Root: "") and breadcrumb ("A / B / C")."""
    tree = tree.withColumn("route_slug", T.slug(F.col("name")))
    level = tree.filter("parent_id IS NULL").withColumns({"route_path": F.lit(""), "breadcrumb": F.col("name")})
    levels = [level]
    depth = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range(depth):
        above = level.select(F.col("id").alias("_up"), F.col("route_path").alias("_path"), F.col("breadcrumb").alias("_crumb"))
        level = tree.join(above, tree["parent_id"] == above["_up"])
        path = F.array_join(F.filter(F.array("_path", "route_slug"), lambda x: x != ""), "/")
        level = level.select(*tree.columns, path.alias("route_path"), F.concat_ws(" / ", "_crumb", "name").alias("breadcrumb"))
        levels.append(level)
    return reduce(DataFrame.union, levels)


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, ancestor_id): every node with itself and all above it."""
    step = tree.select("id", F.col("id").alias("ancestor_id"))
    found, up = [step], tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"))
    for _ in range(tree.agg(F.max("depth")).first()[0] or 0):
        step = step.join(up, step["ancestor_id"] == up["_id"]).select("id", F.col("_parent").alias("ancestor_id"))
        found.append(step)
    return reduce(DataFrame.union, found)


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes below Root that have no child."""
    return tree.filter("parent_id IS NOT NULL").join(tree.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def direct_counts(tree: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, direct, visible): cards on a node; visible only on leaves below Root."""
    n = assignments.groupBy(F.col("taxonomy_node_id").alias("id")).agg(F.count("*").alias("direct"))
    leaf = leaves(tree).select("id", F.lit(True).alias("leaf"))
    counted = tree.select("id").join(n, "id", "left").join(leaf, "id", "left")
    direct = F.coalesce("direct", F.lit(0))
    return counted.select("id", direct.alias("direct"), F.when(F.col("leaf"), direct).otherwise(0).alias("visible"))


def descendant_counts(tree: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, descendants): visible cards at or below a node."""
    return ancestors(tree).join(direct_counts(tree, assignments), "id").groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("visible").alias("descendants"))


def node_view(tree: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, view, child_id, child_count): how a node shows.

    A node with children is a branch of its visible children; Root and a leaf without cards are empty branches; any other leaf is a card scope.
    """
    counts, direct = descendant_counts(tree, assignments), direct_counts(tree, assignments)
    kids = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("up"), F.col("id").alias("child_id"))
    shown = kids.join(counts.withColumnRenamed("id", "child_id"), "child_id").filter("descendants > 0")
    has = kids.select(F.col("up").alias("id"), F.lit(True).alias("has")).distinct()
    own = tree.select("id", "parent_id").join(has, "id", "left").join(direct.select("id", "direct"), "id")
    view = F.when(F.col("has") | F.col("parent_id").isNull() | (F.col("direct") == 0), "branch").otherwise("card_scope")
    view = F.coalesce(view, F.lit("card_scope"))
    return own.join(shown, own["id"] == shown["up"], "left").select("id", view.alias("view"), "child_id", F.col("descendants").alias("child_count"))


def root_view(tree: DataFrame, assignments: DataFrame) -> DataFrame:
    """(position, id, name, descendants, node_kind): Root's visible children by name and id."""
    from pyspark.sql import Window as W

    kids = tree.filter("depth = 1").join(descendant_counts(tree, assignments), "id").filter("descendants > 0")
    has = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.lit("branch").alias("k")).distinct()
    kids = kids.join(has, "id", "left")
    position = F.row_number().over(W.partitionBy("parent_id").orderBy("name", "id")).cast("long")
    return kids.select(position.alias("position"), "id", "name", "descendants", F.coalesce("k", F.lit("card_scope")).alias("node_kind"))


def precompute_targets(tree: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, route_path, descendants): nodes with cards and no visible child."""
    counts = descendant_counts(tree, assignments).filter("descendants > 0")
    above = tree.join(counts, "id").select(F.col("parent_id").alias("id")).distinct()
    return paths(tree).select("id", "route_path").join(counts, "id").join(above, "id", "left_anti")


def scope_of_card(tree: DataFrame, assignments: DataFrame) -> DataFrame:
    """(node_id, scope_id): the leaf below Root that a card lies on."""
    leaf = leaves(tree).select(F.col("id").alias("scope_id"))
    return assignments.join(leaf, assignments["taxonomy_node_id"] == leaf["scope_id"]).select("node_id", "scope_id")


def scope_projection(scopes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scope_id, node_a_id, node_b_id, strength): edges with an end in the scope, each once a scope."""
    touched = scopes.join(adjacency, "node_id")
    return touched.select("scope_id", F.least("node_id", "neighbour_id").alias("node_a_id"), F.greatest("node_id", "neighbour_id").alias("node_b_id"), "strength").distinct()


def scope_graph(scopes: DataFrame, projection: DataFrame) -> DataFrame:
    """(scope_id, node_id, side): assigned cards are inner, other ends of the scope's edges outer."""
    ends = projection.select("scope_id", F.explode(F.array("node_a_id", "node_b_id")).alias("node_id"))
    inner = scopes.select("scope_id", "node_id")
    outer = ends.join(inner, ["scope_id", "node_id"], "left_anti").distinct()
    return inner.withColumn("side", F.lit("inner")).union(outer.withColumn("side", F.lit("outer")))


def unassigned(cards: DataFrame, assignments: DataFrame) -> DataFrame:
    return cards.select("node_id").join(assignments, "node_id", "left_anti")


def backfilled(cards: DataFrame, assignments: DataFrame, root_id: int = 1) -> DataFrame:
    """Assignments after every unassigned card is put on Root; a second run adds nothing."""
    return assignments.union(unassigned(cards, assignments).withColumn("taxonomy_node_id", F.lit(root_id).cast("long")))


def fingerprints(graph: DataFrame, projection: DataFrame, version: str = "taxonomy-card-scope-layout-v2") -> DataFrame:
    """(scope_id, fingerprint): sha256 of the scope graph's canonical JSON, for scopes with nodes.

    The text is never put together: a scope's pieces come sorted, batch after batch, and run through one digest, so a
    scope of any size takes a batch's memory.
    """
    none = F.lit(None).cast("string")
    node = F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit(',"'), F.col("side"), F.lit('"]'))
    edge = F.concat(F.lit("["), F.col("node_a_id").cast("string"), F.lit(","), F.col("node_b_id").cast("string"), F.lit(","), F.col("strength").cast("string"), F.lit("]"))
    nodes = graph.select("scope_id", F.lit(1).alias("kind"), F.col("node_id").alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(None).cast("double").alias("k3"), F.col("side").alias("k4"), node.alias("piece"))
    edges = projection.select("scope_id", F.lit(0).alias("kind"), F.col("node_a_id").alias("k1"), F.col("node_b_id").alias("k2"), F.col("strength").cast("double").alias("k3"), none.alias("k4"), edge.alias("piece"))
    order = ["scope_id", "kind", "k1", "k2", "k3", "k4"]
    rows = nodes.unionByName(edges).repartition("scope_id").sortWithinPartitions(*order).select("scope_id", "kind", "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, kind, running, out = None, 0, None, []

        def close() -> None:
            if kind == 1:  # a scope without nodes has no fingerprint
                running.update(b"]}")
                out.append((scope, running.hexdigest()))

        for batch in batches:
            for own, k, piece in zip(*(batch.column(c).to_pylist() for c in ("scope_id", "kind", "piece")), strict=True):
                if running is None or own != scope:
                    if running is not None:
                        close()
                    scope, kind, first, running = own, 0, True, hashlib.sha256(b'{"edges":[')
                if k != kind:
                    running.update(f'],"layout_version":"{version}","nodes":['.encode())
                    kind, first = k, True
                if piece is not None:
                    running.update((piece if first else "," + piece).encode())
                    first = False
            if out:
                yield pa.RecordBatch.from_pydict({"scope_id": [x[0] for x in out], "fingerprint": [x[1] for x in out]}, schema=_PRINTS)
                out = []
        if running is not None:
            close()
        yield pa.RecordBatch.from_pydict({"scope_id": [x[0] for x in out], "fingerprint": [x[1] for x in out]}, schema=_PRINTS)

    return rows.mapInArrow(digest, "scope_id long, fingerprint string")


def slug_collisions(tree: DataFrame) -> DataFrame:
    """(parent_id, route_slug, n): siblings whose names give one slug."""
    return tree.groupBy("parent_id", T.slug(F.col("name")).alias("route_slug")).agg(F.count("*").alias("n")).filter("n > 1")


def violations(tree: DataFrame, reserved: str = "unclassified") -> DataFrame:
    """(id, problem): empty slugs, reserved names, colliding slugs, and roots beyond the first."""
    slug = T.slug(F.col("name"))
    bad = tree.select("id", F.when(slug == "", "empty slug").when(F.lower("name") == reserved, "reserved name").alias("problem")).filter("problem IS NOT NULL")
    same = slug_collisions(tree).select(F.col("parent_id").alias("_p"), F.col("route_slug").alias("_s"))
    clash = tree.join(same, F.col("parent_id").eqNullSafe(F.col("_p")) & (slug == F.col("_s"))).select("id", F.lit("slug collision"))
    roots = tree.filter("parent_id IS NULL")
    first = roots.agg(F.min("id").alias("_f"))
    return bad.union(clash).union(roots.join(first, roots["id"] > first["_f"]).select("id", F.lit("second root")))


def listing(tree: DataFrame) -> DataFrame:
    """(id, parent_id, depth, position, children): the tree as listed, siblings by name and id; nest it by parent_id."""
    order = W.partitionBy("parent_id").orderBy("name", "id")
    kids = tree.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("_up")).agg(F.count("*").alias("children"))
    rows = tree.withColumn("position", F.row_number().over(order).cast("long")).join(kids, F.col("id") == F.col("_up"), "left")
    return rows.select("id", "parent_id", "depth", "position", F.coalesce("children", F.lit(0)).alias("children")).orderBy("depth", F.asc_nulls_first("parent_id"), "position")
