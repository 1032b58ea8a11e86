"""Queries over the region and nation tree and the customers assigned to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import graph as G
from cardloom.operators import taxonomy as X
from cardloom.sources import tables as D

_at = lambda s, sf: (D.taxonomy_nodes(s, sf), D.assignments(s, sf))


def _scope_edges(spark, sf):
    tree, own = _at(spark, sf)
    edges = G.knn_edges(D.card_vectors(spark, sf)).withColumn("strength", F.floor(F.round("strength", 6) * 100).cast("long"))
    scopes = X.scope_of_card(tree, own)
    return scopes, X.scope_projection(scopes, G.adjacency(edges))


def taxonomy_paths(spark, sf):
    return X.paths(D.taxonomy_nodes(spark, sf)).select("id", "depth", "route_slug", "route_path")


def taxonomy_breadcrumbs(spark, sf):
    return X.paths(D.taxonomy_nodes(spark, sf)).select("id", "breadcrumb")


def taxonomy_direct_counts(spark, sf):
    return X.direct_counts(*_at(spark, sf))


def taxonomy_descendant_counts(spark, sf):
    return X.descendant_counts(*_at(spark, sf))


def taxonomy_root_view(spark, sf):
    return X.root_view(*_at(spark, sf))


def taxonomy_node_view(spark, sf):
    return X.node_view(*_at(spark, sf))


def route_path_lookup(spark, sf):
    """Paths asked for by name, resolved only if exactly one node has them."""
    known = X.paths(D.taxonomy_nodes(spark, sf)).groupBy("route_path").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    region, nation = D.table(spark, sf, "region"), D.table(spark, sf, "nation")
    asked = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", T.slug(F.col("r_name")), T.slug(F.col("n_name"))).alias("route_path"))
    return asked.join(known, "route_path", "left").select("route_path", "id")


def slug_collisions(spark, sf):
    """Part names under their brand."""
    parts = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent_id"), F.col("p_name").alias("name"))
    return X.slug_collisions(parts)


def scope_name_candidates(spark, sf):
    """Names that resolve, whatever their case, to exactly one node."""
    named = D.taxonomy_nodes(spark, sf).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return named.select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("outcome"))


def precompute_targets(spark, sf):
    return X.precompute_targets(*_at(spark, sf))


def scope_of_card(spark, sf):
    return X.scope_of_card(*_at(spark, sf))


def scope_projection_edges(spark, sf):
    return _scope_edges(spark, sf)[1]


def card_scope_graph(spark, sf):
    return X.scope_graph(*_scope_edges(spark, sf))


def fingerprint_by_scope(spark, sf):
    scopes, projection = _scope_edges(spark, sf)
    return X.fingerprints(X.scope_graph(scopes, projection), projection)


def unassigned_cards(spark, sf):
    cards = D.table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("node_id"))
    return X.unassigned(cards, D.assignments(spark, sf))


def root_backfill(spark, sf):
    cards = D.table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("node_id"))
    return X.backfilled(cards, D.assignments(spark, sf))


def backfill_metrics(spark, sf):
    cards = D.table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("node_id"))
    own = D.assignments(spark, sf)
    known = cards.join(own.select("node_id", F.lit(1).alias("has")), "node_id", "left")
    return known.agg(F.count("*").alias("cards"), F.count("has").alias("assigned_before"), F.count_if(F.col("has").isNull()).alias("inserted"), F.lit(0).cast("long").alias("missing_after"))


def tree_listing(spark, sf):
    return X.listing(D.taxonomy_nodes(spark, sf))


def tree_violations(spark, sf):
    """Parts as children of their brands: names that collide as slugs, and brands' own rows without a parent."""
    parts = D.table(spark, sf, "part")
    rows = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_size").cast("long")).alias("parent_id"), F.when(F.col("p_partkey") % 40 == 1, "--").when(F.col("p_partkey") % 40 == 2, "Unclassified").otherwise(F.col("p_type")).alias("name"))
    return X.violations(rows).select("id", "problem")


QUERIES = {f.__name__: f for f in (taxonomy_paths, taxonomy_breadcrumbs, taxonomy_direct_counts, taxonomy_descendant_counts, taxonomy_root_view, taxonomy_node_view, route_path_lookup, slug_collisions, scope_name_candidates, precompute_targets, scope_of_card, scope_projection_edges, card_scope_graph, fingerprint_by_scope, unassigned_cards, root_backfill, backfill_metrics, tree_listing, tree_violations)}

_SLUG = lambda c: f"regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_T = D.with_views("tree", recursive=True)
_TA = D.with_views("tree", "assigned", recursive=True)
_PATHS = f"""paths AS (SELECT id, depth, {_SLUG("name")} AS route_slug, '' AS route_path, name AS breadcrumb FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, t.depth, {_SLUG("t.name")}, CASE WHEN p.route_path = '' THEN {_SLUG("t.name")} ELSE p.route_path || '/' || {_SLUG("t.name")} END, p.breadcrumb || ' / ' || t.name
  FROM tree t JOIN paths p ON t.parent_id = p.id)"""
_LEAF = "leaf AS (SELECT id FROM tree t WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id))"
_DIRECT = f"""{_LEAF}, n AS (SELECT taxonomy_node_id AS id, count(*) AS c FROM assigned GROUP BY 1),
direct AS (SELECT t.id, coalesce(c, 0) AS direct, CASE WHEN t.id IN (SELECT id FROM leaf) THEN coalesce(c, 0) ELSE 0 END AS visible FROM tree t LEFT JOIN n USING (id))"""
_DESC = f"""{_DIRECT}, up AS (SELECT id, id AS a FROM tree UNION ALL SELECT up.id, t.parent_id FROM up JOIN tree t ON t.id = up.a WHERE t.parent_id IS NOT NULL),
counts AS (SELECT a AS id, sum(visible)::BIGINT AS descendants FROM up JOIN direct USING (id) GROUP BY 1)"""
_SCOPE = f"""{_LEAF}, scopes AS (SELECT node_id, taxonomy_node_id AS scope_id FROM assigned WHERE taxonomy_node_id IN (SELECT id FROM leaf)),
e AS (SELECT node_a_id, node_b_id, floor(round(strength, 6) * 100)::BIGINT AS strength FROM edges),
projection AS (SELECT DISTINCT s.scope_id, e.* FROM e JOIN scopes s ON s.node_id IN (e.node_a_id, e.node_b_id)),
ends AS (SELECT scope_id, node_a_id AS node_id FROM projection UNION SELECT scope_id, node_b_id FROM projection),
graph AS (SELECT scope_id, node_id, 'inner' AS side FROM scopes UNION ALL SELECT scope_id, node_id, 'outer' FROM ends WHERE (scope_id, node_id) NOT IN (SELECT scope_id, node_id FROM scopes))"""
_SC = D.with_views("tree", "assigned", "cards", "edges")
_CARDS2 = "c2 AS (SELECT doc_id * 2 AS node_id FROM documents)"
SQL = {
    "taxonomy_paths": f"{_T}, {_PATHS} SELECT id, depth, route_slug, route_path FROM paths",
    "taxonomy_breadcrumbs": f"{_T}, {_PATHS} SELECT id, breadcrumb FROM paths",
    "taxonomy_direct_counts": f"{_TA}, {_DIRECT} SELECT * FROM direct",
    "taxonomy_descendant_counts": f"{_TA}, {_DESC} SELECT * FROM counts",
    "taxonomy_root_view": f"""{_TA}, {_DESC} SELECT row_number() OVER (ORDER BY name, id) AS position, id, name, descendants,
      CASE WHEN EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id) THEN 'branch' ELSE 'card_scope' END AS node_kind FROM tree t JOIN counts USING (id) WHERE depth = 1 AND descendants > 0""",
    "taxonomy_node_view": f"""{_TA}, {_DESC}, kids AS (SELECT c.parent_id AS up, c.id AS child_id, descendants AS child_count FROM tree c JOIN counts USING (id) WHERE descendants > 0)
      SELECT t.id, CASE WHEN EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id) OR t.parent_id IS NULL OR d.direct = 0 THEN 'branch' ELSE 'card_scope' END AS view, child_id, child_count
      FROM tree t JOIN direct d USING (id) LEFT JOIN kids ON kids.up = t.id""",
    "route_path_lookup": f"""{_T}, {_PATHS}, known AS (SELECT route_path, min(id) AS id FROM paths GROUP BY 1 HAVING count(*) = 1),
      asked AS (SELECT {_SLUG("r_name")} || '/' || {_SLUG("n_name")} AS route_path FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT route_path, id FROM asked LEFT JOIN known USING (route_path)""",
    "slug_collisions": f"SELECT p_brand AS parent_id, {_SLUG('p_name')} AS route_slug, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "scope_name_candidates": f"{_T} SELECT lower(name) AS name, CASE WHEN count(*) = 1 THEN min(id) END AS id, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM tree GROUP BY 1",
    "precompute_targets": f"""{_TA}, {_DESC}, {_PATHS} SELECT id, route_path, descendants FROM paths JOIN counts c USING (id) WHERE descendants > 0
      AND NOT EXISTS (SELECT 1 FROM tree k JOIN counts kc ON kc.id = k.id WHERE k.parent_id = c.id AND kc.descendants > 0)""",
    "scope_of_card": f"{_TA}, {_LEAF} SELECT node_id, taxonomy_node_id AS scope_id FROM assigned WHERE taxonomy_node_id IN (SELECT id FROM leaf)",
    "scope_projection_edges": f"{_SC}, {_SCOPE} SELECT * FROM projection",
    "card_scope_graph": f"{_SC}, {_SCOPE} SELECT * FROM graph",
    "fingerprint_by_scope": f"""{_SC}, {_SCOPE}, ns AS (SELECT scope_id, string_agg('[' || node_id || ',"' || side || '"]', ',' ORDER BY node_id, side) AS n FROM graph GROUP BY 1),
      es AS (SELECT scope_id, string_agg('[' || node_a_id || ',' || node_b_id || ',' || strength || ']', ',' ORDER BY node_a_id, node_b_id) AS e FROM projection GROUP BY 1)
      SELECT scope_id, sha256('{{"edges":[' || coalesce(e, '') || '],"layout_version":"taxonomy-card-scope-layout-v2","nodes":[' || n || ']}}') AS fingerprint FROM ns LEFT JOIN es USING (scope_id)""",
    "unassigned_cards": f"{D.with_views('assigned')}, {_CARDS2} SELECT node_id FROM c2 WHERE node_id NOT IN (SELECT node_id FROM assigned)",
    "root_backfill": f"{D.with_views('assigned')}, {_CARDS2} SELECT * FROM assigned UNION ALL SELECT node_id, 1 FROM c2 WHERE node_id NOT IN (SELECT node_id FROM assigned)",
    "backfill_metrics": f"{D.with_views('assigned')}, {_CARDS2} SELECT count(*) AS cards, count(a.node_id) AS assigned_before, count(*) - count(a.node_id) AS inserted, 0::BIGINT AS missing_after FROM c2 LEFT JOIN assigned a USING (node_id)",
    "tree_listing": f"{_T} SELECT id, parent_id, depth, row_number() OVER (PARTITION BY parent_id ORDER BY name, id) AS position, (SELECT count(*) FROM tree k WHERE k.parent_id = t.id) AS children FROM tree t",
    "tree_violations": f"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN p_size END AS parent_id, CASE p_partkey % 40 WHEN 1 THEN '--' WHEN 2 THEN 'Unclassified' ELSE p_type END AS name FROM part),
      s AS (SELECT *, {_SLUG('name')} AS slug FROM t), c AS (SELECT *, count(*) OVER (PARTITION BY parent_id, slug) AS n FROM s)
      SELECT id, 'empty slug' AS problem FROM s WHERE slug = '' UNION ALL SELECT id, 'reserved name' FROM s WHERE lower(name) = 'unclassified' UNION ALL SELECT id, 'slug collision' FROM c WHERE n > 1
      UNION ALL SELECT id, 'second root' FROM s WHERE parent_id IS NULL AND id > (SELECT min(id) FROM s WHERE parent_id IS NULL)""",
}
