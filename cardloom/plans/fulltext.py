"""Full-text queries over cards and documents, answered from stored indexes."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from cardloom.operators import fulltext as X
from cardloom.operators.textindex import TextIndex, of_application
from cardloom.plans import corpus
from cardloom.sources import tables as D

LIMIT = 20
ASKED = ("spark tables", '"on the" with', "thing or which -the", "running connections", "", "the of", "with-the or ereheraren", "-the")
#: Words and alternatives of words, in the simple configuration.
SIMPLE = ("the", "queaux", "les OR with", "nowhere", "und or the or der", "the of", "in and the with", "de la or der die", "and and the")
#: Queries whose texts are asked for, not their ranks: (query, alternatives of phrases, a minus before those that exclude).
MATCHED = (('"of the"', ("of the",)), ('the -"of the"', ("the", "-of the")), ("-the -de", ("-the", "-de")), ("and-the or -und", ("and the",), ("-und",)), ('"in the" with -of', ("in the", "with", "-of")))
#: Every so many-th text changes or goes in the edited index.
CHANGED, GONE = 7, 11


def _queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def _name(kind: str, sf: str) -> str:
    return f"{kind}-{zlib.crc32(sf.encode()):08x}"


def cards_index(spark, sf, config="english") -> TextIndex:
    return of_application(spark, D.cards(spark, sf).select("node_id", "title", "content"), _name(f"cards-{config}", sf), config)


def _documents(spark, sf):
    return corpus._documents(spark, sf).select(F.col("page_id").alias("node_id"), "title", F.col("clean_text").alias("content"))


def documents_index(spark, sf, config="english") -> TextIndex:
    return of_application(spark, _documents(spark, sf), _name(f"documents-{config}", sf), config)


def active(spark, sf):
    """Leaves out cards that are not active."""
    own = D.cards(spark, sf).filter("state = 'active'").select("node_id")
    return lambda rows: rows.join(own, "node_id", "left_semi")


def fulltext_search(spark, sf):
    return cards_index(spark, sf).searcher().topk(_queries(spark, ASKED), LIMIT, active(spark, sf))


def fulltext_corpus_search(spark, sf):
    return X.corpus_search(_queries(spark, ASKED), documents_index(spark, sf).searcher(), LIMIT, corpus._processed(spark, sf))


def fulltext_simple(spark, sf):
    found = X.corpus_search(_queries(spark, SIMPLE), documents_index(spark, sf, "simple").searcher(), LIMIT, corpus._processed(spark, sf))
    return found.withColumn("score", F.round("score", 6))


def fulltext_matches(spark, sf):
    """Which documents answer queries with phrases, exclusions and alternatives that only exclude."""
    return documents_index(spark, sf, "simple").searcher().found(_queries(spark, [m[0] for m in MATCHED])).select("query_id", "node_id")


def _edited(spark, sf) -> TextIndex:
    """The documents' index after every CHANGED-th text was replaced and every GONE-th deleted, as a segment each."""
    docs, name = _documents(spark, sf), _name("documents-edited", sf)
    index = of_application(spark, docs, name, "simple")
    if index._next() == 1:
        new = docs.filter(F.col("node_id") % CHANGED == 0).select("node_id", F.lit("the edited").alias("title"), F.concat(F.lit("with the "), F.coalesce(F.col("title"), F.lit("")), F.lit(" and of")).alias("content"))
        index.upsert(new).delete(docs.filter(F.col("node_id") % GONE == 0))
    return index


def fulltext_after_edits(spark, sf):
    found = X.corpus_search(_queries(spark, SIMPLE), _edited(spark, sf).searcher(), LIMIT)
    return found.withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (fulltext_search, fulltext_corpus_search, fulltext_simple, fulltext_matches, fulltext_after_edits)}

#: Words of a text with their places, titles first.
WORDS_SQL = r"""placed AS (SELECT id, title, content, regexp_extract_all(lower(coalesce(title, '')), '[\pL\pN]+') AS tw, regexp_extract_all(lower(coalesce(content, '')), '[\pL\pN]+') AS cw FROM texts),
  every AS (SELECT id, unnest(list_concat(tw, cw)) AS term, generate_subscripts(list_concat(tw, cw), 1) AS pos, len(tw) AS n FROM placed),
  w AS (SELECT id, term, pos, CASE WHEN pos <= n THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM every)"""
#: Cover density of alternatives q(query_id, grp, term) of words: at each hit the latest stretch that ends there and holds an alternative's words; a new beginning is a new stretch.
COVERS_SQL = """asked AS (SELECT query_id, grp, count(DISTINCT term) AS n FROM q GROUP BY 1, 2),
  hits AS (SELECT query_id, id, term, pos, weight FROM w JOIN (SELECT DISTINCT query_id, term FROM q) USING (term)),
  answered AS (SELECT DISTINCT query_id, id FROM (SELECT h.query_id, h.id, q.grp, count(DISTINCT h.term) AS n FROM hits h JOIN q USING (query_id, term) GROUP BY 1, 2, 3) JOIN asked USING (query_id, grp, n)),
  own AS (SELECT query_id, id, term, pos, weight, row_number() OVER seen AS c, sum(1 / weight) OVER seen AS s FROM hits JOIN answered USING (query_id, id) WINDOW seen AS (PARTITION BY query_id, id ORDER BY pos)),
  latest AS (SELECT o.query_id, o.id, o.pos, q.grp, q.term, max(CASE WHEN o.term = q.term THEN o.pos END) OVER (PARTITION BY o.query_id, o.id, q.grp, q.term ORDER BY o.pos) AS p FROM own o JOIN (SELECT DISTINCT * FROM q) q USING (query_id)),
  alternatives AS (SELECT query_id, id, pos, grp, min(p) AS p FROM latest GROUP BY 1, 2, 3, 4 HAVING count(p) = count(*)),
  ends AS (SELECT query_id, id, pos, max(p) AS p FROM alternatives GROUP BY 1, 2, 3),
  covers AS (SELECT * FROM (SELECT *, lag(p) OVER (PARTITION BY query_id, id ORDER BY pos) AS before FROM ends) WHERE before IS DISTINCT FROM p),
  scores AS (SELECT v.query_id, v.id, round(sum((b.c - a.c + 1) / (b.s - a.s + 1 / a.weight) / (1 + (b.pos - a.pos) - (b.c - a.c))), 9) AS score
    FROM covers v JOIN own a ON a.query_id = v.query_id AND a.id = v.id AND a.pos = v.p JOIN own b ON b.query_id = v.query_id AND b.id = v.id AND b.pos = v.pos GROUP BY 1, 2)"""
_TERMS = "q(query_id, grp, term) AS (VALUES " + ", ".join(f"({i}::BIGINT, {g}, '{w}')" for i, q in enumerate(SIMPLE) for g, part in enumerate(q.lower().split(" or ")) for w in part.split()) + ")"
_BEST = f"SELECT query_id, id AS page_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= {LIMIT}"
_PADDED = r"' ' || array_to_string(list_concat(tw, cw), ' ') || ' '"
_MATCH = " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, id AS node_id FROM padded WHERE " + " OR ".join("(" + " AND ".join(("NOT " if p.startswith("-") else "") + f"contains(p, ' {p.lstrip('-')} ')" for p in g) + ")" for g in m[1:]) for i, m in enumerate(MATCHED))
_EDITS = f"""texts AS (SELECT page_id AS id, CASE WHEN page_id % {CHANGED} = 0 THEN 'the edited' ELSE title END AS title, CASE WHEN page_id % {CHANGED} = 0 THEN 'with the ' || coalesce(title, '') || ' and of' ELSE clean_text END AS content
      FROM docs WHERE page_id % {GONE} <> 0)"""
SQL = {
    "fulltext_simple": f"WITH {corpus._DOCS}, {_TERMS}, texts AS (SELECT page_id AS id, title, clean_text AS content FROM docs WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)), {WORDS_SQL}, {COVERS_SQL} {_BEST}",
    "fulltext_after_edits": f"WITH {corpus._DOCS}, {_TERMS}, {_EDITS}, {WORDS_SQL}, {COVERS_SQL} {_BEST}",
    "fulltext_matches": f"WITH {corpus._DOCS}, texts AS (SELECT page_id AS id, title, clean_text AS content FROM docs), {WORDS_SQL}, padded AS (SELECT id, {_PADDED} AS p FROM placed) {_MATCH}",
}
