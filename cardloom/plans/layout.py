"""Queries over layouts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import layout as E
from cardloom.operators import cells
from cardloom.operators import graph as G
from cardloom.operators import labels
from cardloom.operators import layout as L
from cardloom.operators import taxonomy as X
from cardloom.plans.taxonomy import SQL as _TAXONOMY
from cardloom.plans.taxonomy import _scope_edges
from cardloom.sources import tables as D
from cardloom.sources import versioned


def _graph(spark, sf, kept=lambda rows: rows):
    scopes, projection = _scope_edges(spark, sf)
    projection = kept(projection)
    return X.scope_graph(scopes, projection), projection.withColumn("strength", F.col("strength") / 100)


def layout_seed(spark, sf):
    return L.seeded(_graph(spark, sf)[0])


def layout_slice(spark, sf):
    return L.sliced(L.seeded(_graph(spark, sf)[0]), -500.0, 500.0, -300.0, 300.0).select("scope_id", "node_id")


def layout_bounds(spark, sf):
    return L.bounds(L.seeded(_graph(spark, sf)[0]))


def force_layout(spark, sf):
    return L.force_layout(*_graph(spark, sf, versioned.cut))


def charge_forces(spark, sf):
    """What the nodes of each scope do to each other on the spiral, pair by pair."""
    found = cells.charges(L.seeded(_graph(spark, sf)[0]).select("scope_id", "node_id", "x", "y"), angle=0)
    return found.select("scope_id", "node_id", F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"))


def charge_error(spark, sf):
    """Whether the forces by cells, at an opening angle of 0.5, differ from those of all pairs by less than a fiftieth of these in the mean of squares, by scope."""
    placed = versioned.cut(L.seeded(_graph(spark, sf)[0]).select("scope_id", "node_id", "x", "y"))
    exact, near = cells.charges(placed, 0), cells.charges(placed, 0.5).withColumnsRenamed({"fx": "gx", "fy": "gy"})
    off = F.pow(F.col("fx") - F.col("gx"), 2) + F.pow(F.col("fy") - F.col("gy"), 2)
    rows = exact.join(near, ["scope_id", "node_id"]).groupBy("scope_id").agg(F.count("*").alias("n"), F.sum(off).alias("off"), F.sum(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")).alias("all"))
    return rows.select("scope_id", "n", (F.col("off") <= F.col("all") / 2500 + 1e-9).alias("close"))


def _viewports(spark, sf):
    c = D.table(spark, sf, "customer")
    return c.select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_acctbal") / 2).alias("y"), F.lit(1280.0).alias("w"), F.lit(800.0).alias("h"), (F.col("c_custkey") % 5 - 2).cast("double").alias("zoom"))


def viewport_tiles(spark, sf):
    v = _viewports(spark, sf)
    sides = E.world_bounds(*(F.col(c) for c in ("x", "y", "w", "h", "zoom")))
    return v.select("c_custkey", *[c.cast("double").alias(n) for n, c in sides.items()])


def bubble_metrics(spark, sf):
    s = D.table(spark, sf, "part")
    sizes = E.bubble(F.col("p_partkey") * 3, F.lit(390.0) + F.col("p_partkey") % 1200)
    return s.select("p_partkey", *[c.cast("double").alias(n) for n, c in sizes.items()])


def ring_slots(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in E.ring_slot(F.col("p_partkey")).items()])


def branch_layout(spark, sf):
    tree = D.taxonomy_nodes(spark, sf)
    counts = X.descendant_counts(tree, D.assignments(spark, sf)).filter("descendants > 0")
    return L.branch_layout(tree.filter("parent_id IS NOT NULL").join(counts, "id").select("parent_id", "id", "descendants"))


#: The canvas that labels are chosen for, and every so many-th node is selected or hovered.
CANVAS, ZOOM, MARKED = (1280.0, 800.0), -1.0, 40


def _labels(spark, sf):
    nodes, edges = _graph(spark, sf)
    degree = G.degree(edges)
    titles = D.cards(spark, sf).select("node_id", "title")
    placed = L.seeded(nodes).join(titles, "node_id").join(degree, "node_id", "left").fillna(0, ["degree"])
    return labels.boxes(placed.withColumn("first", F.col("node_id") % MARKED == 0), (0.0, 0.0), ZOOM, *CANVAS)


def label_selection(spark, sf):
    return labels.chosen(_labels(spark, sf))


def label_boxes(spark, sf):
    six = lambda c: F.round(c, 6).alias(c)
    return _labels(spark, sf).select("scope_id", "node_id", F.array_join("lines", "|").alias("lines"), *[six(c) for c in ("x0", "x1", "y0", "y1")])


def wrapped_titles(spark, sf):
    """The first words of every document, set in lines."""
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(labels.wrapped(F.substring("text", 1, 300)), "|").alias("lines"))


def byte_packing(spark, sf):
    docs = D.table(spark, sf, "documents")
    return L.packed_batches(docs.select(F.col("source").alias("queue"), F.col("doc_id").alias("item_id"), L.request_size(F.struct("doc_id", "text")).alias("bytes")), 50, 64 * 1024)


def request_bytes(spark, sf):
    docs = D.table(spark, sf, "documents")
    size = L.request_size(F.struct("doc_id", "lang", "source"))
    total = F.sum(size).over(W.partitionBy("source").orderBy("doc_id"))
    return docs.select("doc_id", size.alias("bytes"), total.alias("running_bytes"))


def layout_slice_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    kept = L.sliced(L.seeded(nodes), -500.0, 500.0, -300.0, 300.0)
    return L.sliced_edges(edges, kept).select("scope_id", "node_a_id", "node_b_id")


def focus_sets(spark, sf):
    nodes, edges = _graph(spark, sf)
    return L.focus(nodes.select("node_id").distinct(), edges)


def screen_points(spark, sf):
    x, y = E.screen(F.col("c_acctbal"), F.col("c_acctbal") / 3, (120.5, -40.0), 1.5, 1280.0, 800.0)
    return D.table(spark, sf, "customer").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


QUERIES = {f.__name__: f for f in (layout_seed, layout_slice, layout_bounds, force_layout, charge_forces, charge_error, viewport_tiles, bubble_metrics, ring_slots, branch_layout, label_selection, label_boxes, wrapped_titles, byte_packing, request_bytes, layout_slice_edges, focus_sets, screen_points)}

_GRAPH = _TAXONOMY["card_scope_graph"].replace("SELECT * FROM graph", "")
_SEED = f"""{_GRAPH}, placed AS (SELECT scope_id, node_id, side, round(cos(i * {E.GOLDEN_ANGLE}) * (80 + sqrt(i + 1) * 96), 6) AS x, round(sin(i * {E.GOLDEN_ANGLE}) * (80 + sqrt(i + 1) * 96), 6) AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY node_id) - 1 AS i FROM graph))"""
#: A title's words put in lines one after the other; a word that is too long is cut.
_WRAP = lambda t: rf"""list_reduce(list_prepend('', list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')), lambda text, w: CASE WHEN text = '' THEN CASE WHEN length(w) <= {labels.FIT} THEN w ELSE rtrim(regexp_replace(w, '(.{{{labels.FIT}}})', '\1' || chr(10), 'g'), chr(10)) END
  WHEN length(split_part(text, chr(10), -1)) + 1 + length(w) <= {labels.FIT} THEN text || ' ' || w ELSE text || chr(10) || CASE WHEN length(w) <= {labels.FIT} THEN w ELSE rtrim(regexp_replace(w, '(.{{{labels.FIT}}})', '\1' || chr(10), 'g'), chr(10)) END END)"""  # noqa: E731
_BOXES = f"""{_SEED}, both_ends AS (SELECT node_a_id AS node_id, node_b_id AS other FROM projection UNION SELECT node_b_id, node_a_id FROM projection), degrees AS (SELECT node_id, count(DISTINCT other) AS degree FROM both_ends GROUP BY 1),
  named AS (SELECT scope_id, node_id, x * 0.5 + 640 AS sx, y * 0.5 + 400 AS sy, coalesce(degree, 0) AS degree, node_id % {MARKED} = 0 AS first, string_split({_WRAP("title")}, chr(10)) AS lines FROM placed JOIN cards USING (node_id) LEFT JOIN degrees USING (node_id) WHERE title IS NOT NULL),
  sized AS (SELECT *, least(384, list_max(list_transform(lines, lambda t: length(t))) * 12.96::DOUBLE) AS w, 24 + (len(lines) - 1) * 30.0::DOUBLE AS h FROM named),
  boxes AS (SELECT scope_id, node_id, degree, first, lines, sx - w / 2 AS x0, sx + w / 2 AS x1, sy + 16 AS y0, sy + 16 + h AS y1 FROM sized WHERE sx + w / 2 >= 0 AND sx - w / 2 <= 1280 AND sy + 16 + h >= 0 AND sy + 16 <= 800)"""
SQL = {
    "wrapped_titles": f"SELECT doc_id, replace({_WRAP('substr(text, 1, 300)')}, chr(10), '|') AS lines FROM documents",
    "label_boxes": f"{_BOXES} SELECT scope_id, node_id, array_to_string(lines, '|') AS lines, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM boxes",
    "label_selection": f"""{_BOXES.replace("WITH ", "WITH RECURSIVE ", 1)}, ordered AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY first DESC, degree DESC, node_id) AS i FROM boxes),
      step AS (SELECT scope_id, i, [{{'n': node_id, 'a': x0, 'b': x1, 'c': y0, 'd': y1}}] AS shown FROM ordered WHERE i = 1
        UNION ALL SELECT s.scope_id, o.i, CASE WHEN len(list_filter(shown, lambda k: x0 <= k.b AND x1 >= k.a AND y0 <= k.d AND y1 >= k.c)) > 0 THEN shown ELSE list_append(shown, {{'n': node_id, 'a': x0, 'b': x1, 'c': y0, 'd': y1}}) END
        FROM step s JOIN ordered o ON o.scope_id = s.scope_id AND o.i = s.i + 1),
      last AS (SELECT scope_id, arg_max(shown, i) AS shown FROM step GROUP BY 1) SELECT scope_id, unnest(shown).n AS node_id FROM last""",
    "charge_forces": f"""{_SEED}, f AS (SELECT a.scope_id, a.node_id, (b.x - a.x) * -180 / greatest(pow(b.x - a.x, 2) + pow(b.y - a.y, 2), 1) AS fx, (b.y - a.y) * -180 / greatest(pow(b.x - a.x, 2) + pow(b.y - a.y, 2), 1) AS fy
      FROM placed a LEFT JOIN placed b ON a.scope_id = b.scope_id AND a.node_id <> b.node_id) SELECT scope_id, node_id, round(coalesce(sum(fx), 0), 4) AS fx, round(coalesce(sum(fy), 0), 4) AS fy FROM f GROUP BY 1, 2""",
    "charge_error": f"{_SEED} SELECT scope_id, count(*) AS n, true AS close FROM placed GROUP BY 1",
    "layout_seed": f"{_SEED} SELECT * FROM placed",
    "layout_slice": f"{_SEED} SELECT scope_id, node_id FROM placed WHERE x BETWEEN -500 AND 500 AND y BETWEEN -300 AND 300",
    "layout_bounds": f"{_SEED} SELECT coalesce(min(x), 0) AS min_x, coalesce(max(x), 0) AS max_x, coalesce(min(y), 0) AS min_y, coalesce(max(y), 0) AS max_y FROM placed",
    "viewport_tiles": """WITH v AS (SELECT c_custkey, c_acctbal AS x, c_acctbal / 2 AS y, 640 / 2.0::DOUBLE ** (c_custkey % 5 - 2) + 320 AS w, 400 / 2.0::DOUBLE ** (c_custkey % 5 - 2) + 320 AS h FROM customer)
      SELECT c_custkey, floor((x - w) / 2048) * 2048 AS x0, ceil((x + w) / 2048) * 2048 AS x1, floor((y - h) / 2048) * 2048 AS y0, ceil((y + h) / 2048) * 2048 AS y1 FROM v""",
    "bubble_metrics": """WITH a AS (SELECT p_partkey, pow(least(1, greatest(0, (log10(greatest(p_partkey * 3, 10)) - 1) / 2)), 1.8) AS d, least(1, greatest(0, (p_partkey % 1200) / 1050.0::DOUBLE)) AS w FROM part),
      b AS (SELECT p_partkey, floor((100 + 32 * d) + ((146 + 90 * d) - (100 + 32 * d)) * w + 0.5) AS diameter, floor(13 + 3 * w + 0.5) AS label_font_size FROM a)
      SELECT *, floor(label_font_size * 1.14::DOUBLE + 0.5) AS label_line_height, floor(diameter * 0.68::DOUBLE + 0.5) AS label_max_width FROM b""",
    "ring_slots": """WITH RECURSIVE rings AS (SELECT 0::BIGINT AS ring, 1::BIGINT AS capacity, 0::BIGINT AS first UNION ALL SELECT ring + 1, 6 * (ring + 1), first + capacity FROM rings WHERE first < 1000000)
      SELECT p_partkey, ring, p_partkey - first AS slot, capacity FROM part JOIN rings ON p_partkey >= first AND p_partkey < first + capacity""",
    "request_bytes": """WITH s AS (SELECT doc_id, source, strlen('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}')::BIGINT AS bytes FROM documents)
      SELECT doc_id, bytes, (sum(bytes) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS running_bytes FROM s""",
    "byte_packing": """WITH RECURSIVE r AS (SELECT source AS queue, doc_id AS item_id, strlen('{"doc_id":' || doc_id || ',"text":' || to_json(text) || '}')::BIGINT AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
      f AS (SELECT queue, item_id, i, 0::BIGINT AS batch, 1 AS n, bytes AS size FROM r WHERE i = 1
        UNION ALL SELECT r.queue, r.item_id, r.i, batch + CASE WHEN n >= 50 OR size + bytes > 65536 THEN 1 ELSE 0 END, CASE WHEN n >= 50 OR size + bytes > 65536 THEN 1 ELSE n + 1 END, CASE WHEN n >= 50 OR size + bytes > 65536 THEN bytes ELSE size + bytes END
        FROM f JOIN r ON r.queue = f.queue AND r.i = f.i + 1)
      SELECT queue, item_id, batch FROM f""",
    "layout_slice_edges": f"""{_SEED}, kept AS (SELECT scope_id, node_id FROM placed WHERE x BETWEEN -500 AND 500 AND y BETWEEN -300 AND 300)
      SELECT scope_id, node_a_id, node_b_id FROM projection WHERE (scope_id, node_a_id) IN (FROM kept) AND (scope_id, node_b_id) IN (FROM kept)""",
    "focus_sets": f"{_GRAPH} SELECT DISTINCT node_id, node_id AS focus_id, NULL::VARCHAR AS edge_id FROM graph UNION SELECT node_a_id, node_b_id, node_a_id || ':' || node_b_id FROM projection UNION SELECT node_b_id, node_a_id, node_a_id || ':' || node_b_id FROM projection",
    "screen_points": "SELECT c_custkey, round((c_acctbal - 120.5::DOUBLE) * pow(2, 1.5::DOUBLE) + 640, 6) AS x, round((c_acctbal / 3 + 40) * pow(2, 1.5::DOUBLE) + 400, 6) AS y FROM customer",
}
