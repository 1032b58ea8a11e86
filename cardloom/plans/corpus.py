"""Queries over the source corpus and the page-view lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import corpus as C
from cardloom.sources import tables as D
from cardloom.sources import versioned
from cardloom.streaming import imports as I

BATCHES = ("the and with", "queaux les", "the on")


def _documents(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.regexp_extract("text", r"^[^.\n]{1,80}", 0).alias("title"), F.col("text").alias("clean_text"))


def _processed(spark, sf):
    return D.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))


def _batches(spark):
    return spark.createDataFrame([(i, q) for i, q in enumerate(BATCHES)], "query_id long, query_text string")


def unprocessed_documents(spark, sf):
    return C.unprocessed(_documents(spark, sf).select("page_id"), _processed(spark, sf))


def corpus_search_simple(spark, sf):
    found = C.search(_batches(spark), _documents(spark, sf), 50, _processed(spark, sf))
    return found.select("query_id", "page_id", F.round("score", 6).alias("score"), "rank")


def science_batches_dedup(spark, sf):
    found = C.search(_batches(spark), _documents(spark, sf), 50).select(F.col("query_id").alias("batch"), "rank", "page_id")
    return C.merged_batches(found)


def pageview_aggregate(spark, sf):
    return C.pageview_totals(D.pageviews(spark, sf))


def _redirects(spark, sf):
    """Users 1 to 49 of an event type are aliases of user 1."""
    titles = C.pageview_totals(D.pageviews(spark, sf)).select("title")
    user = F.regexp_extract("title", "([0-9]+)$", 1).cast("long")
    return titles.filter(user.between(2, 49)).select(F.col("title").alias("redirect_title"), F.regexp_replace("title", "[0-9]+$", "1").alias("canonical_title"))


def pageview_canonical(spark, sf):
    return C.canonical(C.pageview_totals(D.pageviews(spark, sf)), _redirects(spark, sf))


#: What every n-th document's title and lead say, so that each rule meets some.
MARKS = {37: ("List of ", ""), 41: ("", " (2019 film)"), 43: ("Timeline of ", ""), 47: ("Talk:", ""), 53: ("2024 ", ""), 59: ("", " season 3"), 61: ("Deaths in ", ""), 67: ("Outline of ", "")}
LEADS = {12: "It is a former tennis player and ", 14: "These are an old sports club ", 16: "A pornographic film of ", 18: "It is a village in "}


def _judged(spark, sf):
    """Titles are documents' titles, their views the documents' length; every 29th is a disambiguation, every 31st has no article."""
    docs = _documents(spark, sf)
    marked = F.when(F.lit(False), "")
    for step, (before, after) in MARKS.items():
        marked = marked.when(F.col("page_id") % step == 0, F.concat(F.lit(before), "title", F.lit(after)))
    titles = docs.withColumn("title", marked.otherwise(F.col("title")))
    lead = F.when(F.lit(False), "")
    for step, text in LEADS.items():
        lead = lead.when(F.col("page_id") % step == 1, F.concat(F.lit(text), "clean_text"))
    titles = titles.withColumn("clean_text", lead.otherwise(F.col("clean_text")))
    titles = titles.groupBy("title").agg(F.min("page_id").alias("page_id"), F.min_by("clean_text", "page_id").alias("clean_text"))
    length = F.length("clean_text").cast("long")
    totals = C.scored(titles.select("title", length.alias("total_views"), (F.col("page_id") % 24 + 1).alias("months_seen"), (F.col("page_id") % 1000 + 1).alias("best_rank")))
    articles = titles.filter("page_id % 31 <> 0").select("title", "page_id", F.substring("clean_text", 1, 800).alias("lead"), length.alias("text_length"))
    return C.judged(totals, articles, titles.filter("page_id % 29 = 0").select("title"), _processed(spark, sf).filter("page_id % 3 = 0"))


def reject_reasons(spark, sf):
    return _judged(spark, sf).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def pageview_candidates(spark, sf):
    return C.selected(_judged(spark, sf), 200).select("selection_rank", "page_id", "title", "total_views", "months_seen", "best_rank", "score", "text_length")


#: The selection stops at so many pages, before the last row.
STOP_AT = 60


def selection_summary(spark, sf):
    """Counters of a selection that ends early: rows after the last page taken are not looked at."""
    return C.selection_summary(_judged(spark, sf), STOP_AT)


def submission_plan(spark, sf):
    candidates = _documents(spark, sf).select((F.col("page_id") + 5).alias("page_id"))
    units = D.table(spark, sf, "labels").filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("page_id"))
    return C.submission_plan(candidates, _documents(spark, sf), _processed(spark, sf), units)


def source_units(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "url", F.lit(0.75).alias("rank"))
    return C.source_units(pages).select("source_ref", "title", F.col("metadata")["url"].alias("url"), F.col("metadata")["rank"].alias("rank"))


def page_classification(spark, sf):
    pages = D.table(spark, sf, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    body = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(" #REDIRECT [["), title, F.lit("]]"))).when(F.col("page_id") % 11 == 0, F.lit("{{Disambig}}")).otherwise(F.col("html"))
    return pages.select("page_id", C.page_kind(F.when(F.col("page_id") % 13 == 0, 4).otherwise(0), title, body).alias("kind"))


def html_clean_text(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", C.clean_html(F.col("html")).alias("clean_text"))
    return pages.select("page_id", T.sha256(F.col("clean_text")).alias("text_sha256"), F.length("clean_text").cast("long").alias("text_length"))


def tokens_top(spark, sf):
    words = D.table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(100)


def month_windows(spark, sf):
    """The six months up to the last complete month before each order's day, and how many orders look at them."""
    end = T.latest_complete_month(F.col("o_orderdate"))
    return D.table(spark, sf, "orders").select(F.explode(T.month_window(end, 6)).alias("month")).groupBy("month").agg(F.count("*").alias("n"))


def wikitext_clean(spark, sf):
    """Pages' titles set in wikitext."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    raw = F.concat(F.lit("== Head ==\n'''"), title, F.lit("''' is {{Info|a={{b}}}}a [[Link|page]] of [[Plain]]<ref name=x>note</ref>.<!-- c -->\n\n\n\n[[File:a.png]]end"))
    return D.table(spark, sf, "pages").select("page_id", C.clean_wikitext(raw).alias("text"))


#: Every so many-th line of the written shards is cut off.
CUT = 97
#: Shards that are written at least, characters of one beyond that, and batches in which they are imported.
SHARDS, SHARD_CHARS, SHARD_BATCHES = 5, 1 << 26, 3


def _shards(docs) -> int:
    """Into how many shards documents go, so that none grows with the table."""
    return max(SHARDS, -(-(docs.agg(F.sum(F.length("clean_text"))).first()[0] or 0) // SHARD_CHARS))


def shard_import(spark, sf):
    """The documents written as shards, some lines broken, and imported again: each page, and each bad line as a page without an id."""
    root = versioned.own_folder(spark, f"import-{uuid.uuid4().hex}")
    number = _shards(_documents(spark, sf))
    docs = _documents(spark, sf).select(F.to_json(F.struct("page_id", "title", F.lit("u").alias("source_url"), "clean_text")).alias("value"), "page_id")
    docs.select(F.when(F.col("page_id") % CUT == 5, F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value")).repartition(number).write.text(f"{root}/shards")
    I.import_shards(spark, f"{root}/shards", f"{root}/corpus", f"{root}/stream", files=-(-number // SHARD_BATCHES), glob="part-*").awaitTermination()
    good = I.imported(spark, f"{root}/corpus").select("page_id", T.sha256(F.col("clean_text")).alias("text_sha256"), F.lit(0).alias("bad"))
    return good.unionByName(I.quarantined(spark, f"{root}/corpus").select(F.lit(None).cast("long").alias("page_id"), T.sha256(F.col("line")).alias("text_sha256"), F.lit(1).alias("bad")))


QUERIES = {f.__name__: f for f in (unprocessed_documents, corpus_search_simple, science_batches_dedup, pageview_aggregate, pageview_canonical, reject_reasons, pageview_candidates, submission_plan, source_units, page_classification, html_clean_text, tokens_top, month_windows, wikitext_clean, shard_import, selection_summary)}

_DOCS = r"docs AS (SELECT doc_id AS page_id, regexp_extract(text, '^[^.\n]{1,80}') AS title, text AS clean_text FROM documents)"
_DONE = "done AS (SELECT doc_id AS page_id FROM labels WHERE quality = 1)"
_ASK = "q(query_id, terms) AS (VALUES " + ", ".join(f"({i}::BIGINT, {[*dict.fromkeys(q.split())]})" for i, q in enumerate(BATCHES)) + ")"
_HITS = lambda where: f"""tok AS (SELECT page_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS tt, regexp_extract_all(lower(clean_text), '[a-z0-9]+') AS ct FROM docs {where}),
hits AS (SELECT query_id, page_id, len(list_filter(tt, lambda x: list_contains(terms, x))) * 1.0::DOUBLE + len(list_filter(ct, lambda x: list_contains(terms, x))) * 0.4::DOUBLE AS score FROM q JOIN tok ON list_has_all(list_concat(tt, ct), terms)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM hits) WHERE rank <= 50)"""  # noqa: E731
_TOTALS = f"""{D.with_views("pageviews")}, first AS (SELECT month, replace(article, '_', ' ') AS title, min((rank, views)) AS r FROM pageviews GROUP BY 1, 2),
totals AS (SELECT title, sum(r[2])::BIGINT AS total_views, count(*) AS months_seen, min(r[1]) AS best_rank FROM first GROUP BY 1)"""
_RX = lambda p: p.replace("'", "''")
_TITLE_CASE = r"""WHEN t.title = 'Main Page' THEN 'main_page' WHEN starts_with(t.title, '.') THEN 'low_signal_title'
  WHEN contains(t.title, ':') AND split_part(t.title, ':', 1) IN ('Category', 'File', 'Help', 'Portal', 'Special', 'Talk', 'Template', 'User', 'Wikipedia') THEN 'namespace'
  WHEN starts_with(t.title, 'Deaths in ') THEN 'deaths' WHEN list_bool_or([starts_with(t.title, x) FOR x IN ['Index of ', 'List of ', 'Lists of ', 'Timeline of ']]) THEN 'list'
  WHEN left(t.title, 4) BETWEEN '2020' AND '2026' AND regexp_matches(t.title, '^[0-9]{4}([_ ].+)?$') THEN 'current_event_year'
  WHEN regexp_matches(t.title, '(?i)\([^)]*\b(film|film series|TV series|album|song|video game)\)$') OR regexp_matches(t.title, '(?i)\bseason [0-9]+\b') OR regexp_matches(t.title, '(?i)^[0-9]{4} in film$') THEN 'entertainment'"""
_LEAD_CASE = " ".join(f"WHEN regexp_matches(lead, '{_RX(p)}') THEN '{n}'" for n, p in C.LEAD_RULES)
_JUDGED = rf"""WITH {_DOCS}, named AS (SELECT page_id, CASE {" ".join(f"WHEN page_id % {k} = 0 THEN '{a}' || title || '{b}'" for k, (a, b) in MARKS.items())} ELSE title END AS title,
  CASE {" ".join(f"WHEN page_id % {k} = 1 THEN '{a}' || clean_text" for k, a in LEADS.items())} ELSE clean_text END AS clean_text FROM docs),
titles AS (SELECT title, min(page_id) AS page_id, arg_min(clean_text, page_id) AS clean_text FROM named GROUP BY 1),
t AS (SELECT title, page_id AS own, length(clean_text) AS total_views, own % 24 + 1 AS months_seen, own % 1000 + 1 AS best_rank, length(clean_text) + 100000 * (own % 24 + 1) AS score, substr(clean_text, 1, 800) AS lead,
  CASE WHEN own % 31 <> 0 THEN own END AS page_id, CASE WHEN own % 31 <> 0 THEN length(clean_text) END AS text_length FROM titles),
judged AS (SELECT t.*, CASE {_TITLE_CASE} WHEN own % 29 = 0 THEN 'disambiguation' WHEN page_id IS NULL THEN 'missing_article'
  WHEN page_id % 3 = 0 AND page_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'processed' WHEN text_length < {C.SHORT} THEN 'short_text' {_LEAD_CASE}
  WHEN regexp_matches(lead, '{C.LOCALITY}') AND text_length < {C.LOCALITY_LENGTH} THEN 'lead_low_signal_locality' END AS reason FROM t)"""
SQL = {
    "shard_import": f"""SELECT CASE WHEN doc_id % {CUT} <> 5 THEN doc_id END AS page_id, CASE WHEN doc_id % {CUT} <> 5 THEN sha256(text) ELSE sha256(substr('{{"page_id":' || doc_id || ',"title":"' || coalesce(regexp_extract(text, '^[^.\\n]{{1,80}}'), ''), 1, 20)) END AS text_sha256,
      (doc_id % {CUT} = 5)::INT AS bad FROM documents""",
    "unprocessed_documents": "SELECT doc_id AS page_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)",
    "corpus_search_simple": f"WITH {_DOCS}, {_DONE}, {_ASK}, {_HITS('WHERE page_id NOT IN (SELECT page_id FROM done)')} SELECT query_id, page_id, round(score, 6) AS score, rank FROM ranked",
    "science_batches_dedup": f"WITH {_DOCS}, {_ASK}, {_HITS('')} SELECT page_id, min((query_id, rank))[1] AS first_batch, min((query_id, rank))[2] AS first_rank, max(query_id) AS batch FROM ranked GROUP BY 1",
    "pageview_aggregate": f"{_TOTALS} SELECT *, total_views + {C.MONTH_BONUS} * months_seen AS score FROM totals",
    "pageview_canonical": rf"""{_TOTALS}, named AS (SELECT CASE WHEN regexp_extract(title, '([0-9]+)$', 1)::BIGINT BETWEEN 2 AND 49 THEN regexp_replace(title, '[0-9]+$', '1') ELSE title END AS title, total_views, months_seen, best_rank FROM totals),
      c AS (SELECT title, sum(total_views)::BIGINT AS total_views, max(months_seen) AS months_seen, min(best_rank) AS best_rank FROM named GROUP BY 1) SELECT *, total_views + {C.MONTH_BONUS} * months_seen AS score FROM c""",
    "reject_reasons": f"{_JUDGED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "pageview_candidates": f"""{_JUDGED} SELECT row_number() OVER (ORDER BY score DESC, months_seen DESC, total_views DESC, best_rank, title) AS selection_rank, page_id, title, total_views, months_seen, best_rank, score, text_length
      FROM judged WHERE reason IS NULL QUALIFY selection_rank <= 200""",
    "selection_summary": f"""{_JUDGED}, o AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (ORDER BY score DESC, months_seen DESC, total_views DESC, best_rank, title ROWS UNBOUNDED PRECEDING) AS taken FROM judged),
      seen AS (SELECT * FROM o WHERE taken < {STOP_AT} OR (taken = {STOP_AT} AND reason IS NULL))
      SELECT 'total_input' AS counter, count(*) AS n FROM o UNION ALL SELECT 'selected', count(*) FILTER (reason IS NULL) FROM seen UNION ALL SELECT 'rejected_' || reason, count(*) FROM seen WHERE reason IS NOT NULL GROUP BY 1""",
    "submission_plan": """WITH c AS (SELECT doc_id + 5 AS page_id FROM documents) SELECT page_id, CASE WHEN page_id NOT IN (SELECT doc_id FROM documents) THEN 'missing' WHEN p AND u THEN 'skip_processed' WHEN u THEN 'mark_processed' WHEN p THEN 'skip_existing' ELSE 'insert' END AS action
      FROM (SELECT page_id, page_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS p, page_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) AS u FROM c)""",
    "source_units": "SELECT 'wikipedia:' || page_id AS source_ref, 'Page ' || page_id AS title, url, '0.75' AS rank FROM pages",
    "page_classification": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 4 ELSE 0 END AS ns, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages),
      b AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN ' #REDIRECT [[' || title || ']]' WHEN page_id % 11 = 0 THEN '{{Disambig}}' ELSE html END AS body FROM p)
      SELECT page_id, CASE WHEN ns <> 0 THEN 'ignored' WHEN regexp_matches(body, '(?i)^\s*#redirect') THEN 'redirect' WHEN regexp_matches(title, '\(disambiguation\)$') OR regexp_matches(body, '(?i)\{\{\s*disambig') THEN 'disambiguation' ELSE 'article' END AS kind FROM b""",
    "html_clean_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
      b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM a),
      c AS (SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM b) SELECT page_id, sha256(t) AS text_sha256, length(t) AS text_length FROM c""",
    "tokens_top": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 100",
    "month_windows": "SELECT strftime(date_trunc('month', o_orderdate) - to_months(k::INT + 1), '%Y-%m') AS month, count(*) AS n FROM orders, range(6) r(k) GROUP BY 1",
    "wikitext_clean": r"SELECT page_id, 'Head' || chr(10) || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' is a page of Plain.' || chr(10) || chr(10) || 'end' AS text FROM pages",
}
