"""Queries over the similarity graph and the searches."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import ann as A
from cardloom.operators import fulltext as X
from cardloom.operators import graph as G
from cardloom.operators import search as S
from cardloom.plans import fulltext
from cardloom.sources import tables as D
from cardloom.sources import versioned

EVERY = 50  # cards whose node_id it divides are the queries
LIMIT, POOL, CONNECTED = 3, 64, 7
_six = lambda c, name=None: F.round(F.col(c), 6).alias(name or c)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.knn_edges(D.card_vectors(spark, sf))


def _set(spark: SparkSession, sf: str) -> DataFrame:
    return D.card_vectors(spark, sf).select("node_id").filter("node_id % 3 = 0")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return D.cards(spark, sf).filter(F.col("node_id") % EVERY == 0).select(F.col("node_id").alias("query_id"), F.col("title").alias("query_text"), "embedding")


def knn_edges(spark, sf):
    return _edges(spark, sf).select("node_a_id", "node_b_id", _six("strength"))


def knn_strength_histogram(spark, sf):
    return _edges(spark, sf).groupBy(F.floor(F.round("strength", 6) * 20).cast("long").alias("bin")).agg(F.count("*").alias("n_edges"))


def edge_degree(spark, sf):
    return G.degree(_edges(spark, sf))


def adjacency_list(spark, sf):
    return G.adjacency(_edges(spark, sf)).select("node_id", "neighbour_id", _six("strength"))


def induced_subgraph(spark, sf):
    return G.induced(_edges(spark, sf), _set(spark, sf)).select("node_a_id", "node_b_id", _six("strength"))


def touching_edges(spark, sf):
    return G.touching(_edges(spark, sf), _set(spark, sf)).select("node_a_id", "node_b_id", _six("strength"))


def adjacent_edge_ids(spark, sf):
    return G.touching(_edges(spark, sf), _set(spark, sf)).select(F.concat_ws("-", F.col("node_a_id").cast("string"), F.col("node_b_id").cast("string")).alias("edge_id"))


def vector_topk_batch(spark, sf):
    active = D.cards(spark, sf).filter("state = 'active'").select("node_id", "embedding")
    return S.vector_topk(_queries(spark, sf), active, POOL).select("query_id", "node_id", _six("similarity"), "vector_rank")


def _ann(spark, sf) -> A.VectorIndex:
    index = A.VectorIndex(spark, versioned.own_folder(spark, f"vectors-{zlib.crc32(sf.encode()):08x}"))
    active = D.cards(spark, sf).filter("state = 'active'").select("node_id", "embedding")
    return index if versioned.current(spark, index.root) else index.build(active, k=POOL)


def vector_topk_ann(spark, sf):
    """The vector side of a search from the cells near its queries alone."""
    found = _ann(spark, sf).search(_queries(spark, sf), POOL)
    return found.select("query_id", "node_id", _six("similarity"), F.col("rank").alias("vector_rank"))


def vector_ann_recall(spark, sf):
    """Whether that search, over all queries, reaches the recall it was built for, and the exact pairs it is held against."""
    queries = _queries(spark, sf)
    active = D.cards(spark, sf).filter("state = 'active'").select("node_id", "embedding")
    rows = A.recall(_ann(spark, sf).search(queries, POOL), S.vector_topk(queries, active, POOL))
    return rows.select("n_exact", (F.col("recall") >= A.RECALL - 0.02).alias("reached"))


def vector_topk_all_cells(spark, sf):
    """With every cell looked into the search is exact."""
    index = _ann(spark, sf)
    found = index.search(_queries(spark, sf), POOL, probes=len(index._centres()))
    return found.select("query_id", "node_id", _six("similarity"), F.col("rank").alias("vector_rank"))


def similarity_topk_excluding(spark, sf):
    v = D.card_vectors(spark, sf)
    found = S.vector_topk(v.filter(F.col("node_id") % EVERY == 0).withColumnRenamed("node_id", "query_id"), v, 10).filter("node_id <> query_id")
    return S._rank(found, "k", F.desc("similarity"), F.col("node_id"), limit=9).select("query_id", "node_id", F.round((F.col("similarity") + 1) / 2, 6).alias("strength"), F.col("k").alias("rank"))


def lexical_simple_topk(spark, sf):
    found = S.lexical_topk(_queries(spark, sf), D.cards(spark, sf).filter("state = 'active'"), LIMIT)
    return found.select("query_id", "node_id", "exact", "phrase", "all_tokens", _six("score"), "lexical_rank")


def title_flags(spark, sf):
    """Flags of every card's title for a query that is the title itself, padded."""
    titles = D.cards(spark, sf).select("node_id", "title")
    asked = titles.select(F.col("node_id").alias("query_id"), F.concat(F.lit("  "), F.col("title"), F.lit(" ")).alias("raw"))
    both = titles.join(asked, F.col("node_id") == F.col("query_id")).withColumn("query", T.normalised(F.col("raw")))
    exact, phrase, every = S.title_flags(F.col("title"), F.col("query"))
    return both.select("node_id", exact.alias("exact"), phrase.alias("phrase"), every.alias("all_tokens"))


def _quoted(queries: DataFrame) -> DataFrame:
    """Full-text queries for all words of the queries' texts: each stands in quotes, so that none is taken for a sign."""
    words = F.array_join(F.transform(X.words(F.col("query_text")), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")
    return queries.select("query_id", F.col("query_text").alias("title_text"), words.alias("query_text"))


def _hybrid(spark, sf):
    queries = _queries(spark, sf)
    named = fulltext.cards_index(spark, sf, "simple").searcher().topk(_quoted(queries), LIMIT, fulltext.active(spark, sf))
    return S.hybrid(queries, D.cards(spark, sf), LIMIT, POOL, named=named)


def hybrid_rrf_search(spark, sf):
    found = _hybrid(spark, sf)
    return found.select("query_id", "rank", "node_id", _six("rrf"), "lexical_rank", "vector_rank")


def connected_titles(spark, sf):
    matched = _hybrid(spark, sf).select("query_id", "node_id")
    return S.connected_titles(matched, _edges(spark, sf), D.cards(spark, sf), CONNECTED)


def _dictionary(spark, sf):
    return D.table(spark, sf, "benchmark").select(F.col("item_id").alias("title_id"), F.regexp_extract("text", "^[^.,]{1,60}", 0).alias("title"))


def title_mention_pairs(spark, sf):
    contents = D.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), F.col("text").alias("content"))
    return G.mentions(contents, _dictionary(spark, sf))


def _mention_pairs(spark, sf):
    """Cards linked by a benchmark title that both mention: the later card mentions the earliest."""
    pairs = G.mentions(D.cards(spark, sf).select(F.col("node_id").alias("content_id"), "content"), _dictionary(spark, sf))
    first = pairs.groupBy("title_id").agg(F.min("content_id").alias("neighbour_id"))
    return pairs.join(first, "title_id").filter("content_id <> neighbour_id").select(F.col("content_id").alias("node_id"), "neighbour_id").distinct()


def edge_initialisation(spark, sf):
    return G.initial_edges(D.cards(spark, sf), _mention_pairs(spark, sf)).select("node_id", "neighbour_id", _six("strength"), "kind")


def card_materialisation(spark, sf):
    """Every card as its first version left it: read from the one version that was published."""
    root = versioned.own_folder(spark, f"cards-{uuid.uuid4().hex}")
    made = versioned.publish(root, G.materialised(D.cards(spark, sf), _mention_pairs(spark, sf)))
    nodes, versions, places, edges = (versioned.read(spark, root, t, made) for t in ("nodes", "versions", "assignments", "edges"))
    links = edges.groupBy("node_id").agg(F.count(F.when(F.col("kind") == "mention", 1)).alias("n_mentions"), F.count("*").alias("n_edges"))
    rows = nodes.join(versions, (nodes["node_id"] == versions["node_id"]) & (nodes["current_version"] == versions["version"])).drop(versions["node_id"]).join(places, "node_id").join(links, "node_id", "left")
    return rows.select("node_id", "version", T.sha256(F.col("title")).alias("title_sha256"), "taxonomy_node_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_mentions", "n_edges")])


QUERIES = {f.__name__: f for f in (knn_edges, knn_strength_histogram, edge_degree, adjacency_list, induced_subgraph, touching_edges, adjacent_edge_ids, vector_topk_batch, similarity_topk_excluding, lexical_simple_topk, title_flags, hybrid_rrf_search, connected_titles, title_mention_pairs, edge_initialisation, vector_topk_ann, vector_ann_recall, vector_topk_all_cells, card_materialisation)}

_E = D.with_views("cards", "edges")
_NORM = r"lower(trim(regexp_replace(query_text, '\s+', ' ', 'g')))"
_TOK = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
_ADJ = "adj AS (SELECT node_a_id AS node_id, node_b_id AS neighbour_id, strength FROM edges UNION ALL SELECT node_b_id, node_a_id, strength FROM edges)"
_ASKED = f"asked_ AS (SELECT node_id AS query_id, title AS query_text, embedding FROM cards WHERE node_id % {EVERY} = 0)"
_NEAR = f"""near AS (SELECT * FROM (SELECT query_id, node_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS vector_rank
  FROM (SELECT query_id, c.node_id, list_dot_product(a.embedding, c.embedding) AS similarity FROM asked_ a CROSS JOIN cards c WHERE c.state = 'active')) WHERE vector_rank <= {POOL})"""
_LEX = rf"""q AS (SELECT query_id, {_NORM} AS query FROM asked_),
qt AS (SELECT *, list_distinct({_TOK("query")}) AS terms FROM q),
ct AS (SELECT node_id, title, {_TOK("title")} AS tt, {_TOK("content")} AS ct FROM cards WHERE state = 'active'),
hits AS (SELECT query_id, node_id, (lower(title) = query)::INT AS exact, contains(lower(title), query)::INT AS phrase, list_has_all(tt, terms)::INT AS all_tokens,
    len(list_filter(tt, lambda x: list_contains(terms, x))) * 1.0::DOUBLE + len(list_filter(ct, lambda x: list_contains(terms, x))) * 0.4::DOUBLE AS score
  FROM qt JOIN ct ON len(terms) > 0 AND list_has_all(list_concat(tt, ct), terms)),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, phrase DESC, all_tokens DESC, score DESC, node_id) AS lexical_rank FROM hits) WHERE lexical_rank <= {LIMIT})"""
_FULL = rf"""texts AS (SELECT node_id AS id, title, content FROM cards WHERE state = 'active'),
q AS (SELECT node_id AS query_id, 0 AS grp, unnest(regexp_extract_all(lower(title), '[\pL\pN]+')) AS term FROM cards WHERE node_id % {EVERY} = 0),
{fulltext.WORDS_SQL}, {fulltext.COVERS_SQL},
fullq AS (SELECT query_id, {_NORM} AS query FROM asked_), words_ AS (SELECT query_id, list_distinct(list(term)) AS terms FROM q GROUP BY 1),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, phrase DESC, all_tokens DESC, score DESC, node_id) AS lexical_rank FROM
  (SELECT query_id, id AS node_id, (lower(title) = query)::INT AS exact, contains(lower(title), query)::INT AS phrase, list_has_all(tw, terms)::INT AS all_tokens, score
   FROM scores JOIN placed USING (id) JOIN fullq USING (query_id) JOIN words_ USING (query_id))) WHERE lexical_rank <= {LIMIT})"""
_FUSED = f"""fused AS (SELECT query_id, node_id, coalesce(exact, 0) AS exact, coalesce(phrase, 0) AS phrase, coalesce(all_tokens, 0) AS all_tokens, coalesce(score, 0) AS score,
    coalesce(1 / (60 + vector_rank), 0) + coalesce(1 / (60 + lexical_rank), 0) AS rrf, lexical_rank, vector_rank FROM near FULL JOIN lex USING (query_id, node_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, phrase DESC, all_tokens DESC, rrf DESC, score DESC, coalesce(lexical_rank, {LIMIT + 1}), coalesce(vector_rank, {LIMIT + 1}), node_id) AS rank FROM fused) WHERE rank <= {LIMIT})"""
_MENTION = r"""dictionary AS (SELECT item_id AS title_id, ' ' || array_to_string(regexp_extract_all(lower(regexp_extract(text, '^[^.,]{1,60}')), '[a-z0-9]+'), ' ') || ' ' AS phrase FROM benchmark)"""
_PAD = "' ' || array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ') || ' '"
SQL = {
    "knn_edges": f"{_E} SELECT node_a_id, node_b_id, round(strength, 6) AS strength FROM edges",
    "knn_strength_histogram": f"{_E} SELECT floor(round(strength, 6) * 20)::BIGINT AS bin, count(*) AS n_edges FROM edges GROUP BY 1",
    "edge_degree": f"{_E}, {_ADJ} SELECT node_id, count(DISTINCT neighbour_id) AS degree FROM adj GROUP BY 1",
    "adjacency_list": f"{_E}, {_ADJ} SELECT node_id, neighbour_id, round(strength, 6) AS strength FROM adj",
    "induced_subgraph": f"{_E} SELECT node_a_id, node_b_id, round(strength, 6) AS strength FROM edges WHERE node_a_id % 3 = 0 AND node_b_id % 3 = 0",
    "touching_edges": f"{_E} SELECT node_a_id, node_b_id, round(strength, 6) AS strength FROM edges WHERE node_a_id % 3 = 0 OR node_b_id % 3 = 0",
    "adjacent_edge_ids": f"{_E} SELECT node_a_id::VARCHAR || '-' || node_b_id::VARCHAR AS edge_id FROM edges WHERE node_a_id % 3 = 0 OR node_b_id % 3 = 0",
    "vector_topk_batch": f"{D.with_views('cards')}, {_ASKED}, {_NEAR} SELECT query_id, node_id, round(similarity, 6) AS similarity, vector_rank FROM near",
    "vector_topk_all_cells": f"{D.with_views('cards')}, {_ASKED}, {_NEAR} SELECT query_id, node_id, round(similarity, 6) AS similarity, vector_rank FROM near",
    "vector_ann_recall": f"{D.with_views('cards')}, {_ASKED}, {_NEAR} SELECT count(*) AS n_exact, true AS reached FROM near",
    "similarity_topk_excluding": f"""{D.with_views("cards")}, {_ASKED} SELECT query_id, node_id, round((dot + 1) / 2, 6) AS strength, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, node_id) AS rank
      FROM (SELECT query_id, c.node_id, list_dot_product(a.embedding, c.embedding) AS dot FROM asked_ a JOIN cards c ON c.node_id <> a.query_id)) WHERE rank <= 9""",
    "lexical_simple_topk": f"{D.with_views('cards')}, {_ASKED}, {_LEX} SELECT query_id, node_id, exact, phrase, all_tokens, round(score, 6) AS score, lexical_rank FROM lex",
    "title_flags": rf"""{D.with_views("cards")}, t AS (SELECT node_id, title, '  ' || title || ' ' AS query_text FROM cards), n AS (SELECT node_id, title, {_NORM} AS query FROM t)
      SELECT node_id, (lower(title) = query)::INT AS exact, contains(lower(title), query)::INT AS phrase, list_has_all({_TOK("title")}, {_TOK("query")})::INT AS all_tokens FROM n""",
    "hybrid_rrf_search": f"{D.with_views('cards')}, {_ASKED}, {_NEAR}, {_FULL}, {_FUSED} SELECT query_id, rank, node_id, round(rrf, 6) AS rrf, lexical_rank, vector_rank FROM best",
    "connected_titles": f"""{_E}, {_ADJ}, {_ASKED}, {_NEAR}, {_FULL}, {_FUSED}, mine AS (SELECT b.query_id, b.node_id, c.title FROM best b JOIN cards c USING (node_id)),
      c1 AS (SELECT o.query_id, o.node_id AS match_id, a.neighbour_id AS node_id, c.title FROM mine o JOIN adj a USING (node_id) JOIN cards c ON c.node_id = a.neighbour_id WHERE c.state = 'active'),
      c2 AS (SELECT query_id, title, min((match_id, node_id)) AS spot FROM c1 WHERE NOT EXISTS (SELECT 1 FROM mine o WHERE o.query_id = c1.query_id AND (o.node_id = c1.node_id OR o.title = c1.title)) GROUP BY 1, 2)
      SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, title) AS position, title FROM c2) WHERE position <= {CONNECTED}""",
    "title_mention_pairs": f"WITH {_MENTION}, padded AS (SELECT doc_id AS content_id, {_PAD.format('text')} AS p FROM documents) SELECT content_id, title_id FROM padded JOIN dictionary ON length(phrase) > 2 AND contains(p, phrase)",
    "edge_initialisation": f"""{D.with_views("cards")}, {_MENTION}, padded AS (SELECT node_id, {_PAD.format("content")} AS p FROM cards),
      m AS (SELECT node_id, title_id FROM padded JOIN dictionary ON length(phrase) > 2 AND contains(p, phrase)),
      f AS (SELECT title_id, min(node_id) AS neighbour_id FROM m GROUP BY 1),
      mp AS (SELECT DISTINCT m.node_id, f.neighbour_id FROM m JOIN f USING (title_id) WHERE m.node_id <> f.neighbour_id),
      dots AS (SELECT a.node_id, b.node_id AS neighbour_id, list_dot_product(a.embedding, b.embedding) AS dot FROM cards a JOIN cards b ON a.node_id <> b.node_id),
      named AS (SELECT * FROM (SELECT dots.*, row_number() OVER (PARTITION BY node_id ORDER BY dot DESC, neighbour_id) AS k FROM dots JOIN mp USING (node_id, neighbour_id)) WHERE k <= 2),
      rest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY dot DESC, neighbour_id) AS k FROM dots WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.node_id = dots.node_id AND n.neighbour_id = dots.neighbour_id)) WHERE k <= 9)
      SELECT node_id, neighbour_id, round(greatest(0, least(1, (dot + 1) / 2)), 6) AS strength, 'mention' AS kind FROM named
      UNION ALL SELECT node_id, neighbour_id, round(greatest(0, least(1, (dot + 1) / 2)), 6), 'semantic' FROM rest WHERE greatest(0, least(1, (dot + 1) / 2)) >= 0.61 AND k <= 4""",
}
SQL["card_materialisation"] = f"""WITH linked AS ({SQL["edge_initialisation"]}), {D.SQL["cards"]}, n AS (SELECT node_id, count(*) FILTER (kind = 'mention') AS n_mentions, count(*) AS n_edges FROM linked GROUP BY 1)
  SELECT node_id, 1::BIGINT AS version, sha256(title) AS title_sha256, 1::BIGINT AS taxonomy_node_id, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_edges, 0) AS n_edges FROM cards LEFT JOIN n USING (node_id)"""
