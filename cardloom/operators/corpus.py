"""Source corpus: search, batches, page-view selection, submission and page preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import search as S
from cardloom.sources.versioned import cut

MONTH_BONUS = 100_000


def unprocessed(documents: DataFrame, processed: DataFrame) -> DataFrame:
    return documents.join(processed.select("page_id"), "page_id", "left_anti")


def search(queries: DataFrame, documents: DataFrame, limit: int, processed: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, score, rank): best documents (page_id, title, clean_text) first; a blank query lists documents by id with score 0."""
    if processed is not None:
        documents = unprocessed(documents, processed)
    cards = documents.select(F.col("page_id").alias("node_id"), "title", F.col("clean_text").alias("content"))
    hits = S.lexical_matches(queries, cards).select("query_id", "node_id", "score")
    blank = queries.filter(F.trim("query_text") == "").select("query_id")
    first = documents.select(F.col("page_id").alias("node_id")).orderBy("page_id").limit(limit)  # every blank query gets the same few rows
    hits = hits.union(blank.join(F.broadcast(first)).select("query_id", "node_id", F.lit(0.0)))
    return S._rank(hits, "rank", F.desc("score"), F.col("node_id"), limit=limit).select("query_id", F.col("node_id").alias("page_id"), "score", "rank")


def merged_batches(found: DataFrame) -> DataFrame:
    """(page_id, position, batch): hits of several batches (batch, rank, page_id); a page keeps its first position and its last batch."""
    placed = found.withColumn("place", F.struct("batch", "rank"))
    kept = placed.groupBy("page_id").agg(F.min("place").alias("first"), F.max_by("batch", "place").alias("batch"))
    # Positions count over all pages, so the order is by numbers of a batch: ranks below come from batches before.
    return kept.select("page_id", F.col("first.batch").alias("first_batch"), F.col("first.rank").alias("first_rank"), "batch")


def pageview_totals(views: DataFrame) -> DataFrame:
    """(title, total_views, months_seen, best_rank, score) of (month, article, views, rank); of a month's rows with one title the first by rank counts."""
    named = views.withColumn("title", T.url_title(F.col("article")))
    first = named.groupBy("month", "title").agg(F.min(F.struct("rank", "views")).alias("r"))
    total = first.groupBy("title").agg(F.sum("r.views").alias("total_views"), F.count("*").alias("months_seen"), F.min("r.rank").alias("best_rank"))
    return scored(total)


def scored(total: DataFrame) -> DataFrame:
    return total.withColumn("score", F.col("total_views") + MONTH_BONUS * F.col("months_seen"))


def canonical(totals: DataFrame, redirects: DataFrame) -> DataFrame:
    """Totals under canonical titles: views add up, months seen is the most of any alias, rank the best. redirects: (redirect_title, canonical_title)."""
    named = totals.join(redirects, totals["title"] == redirects["redirect_title"], "left").withColumn("title", F.coalesce("canonical_title", "title"))
    return scored(named.groupBy("title").agg(F.sum("total_views").alias("total_views"), F.max("months_seen").alias("months_seen"), F.min("best_rank").alias("best_rank")))


#: Title rules in the order in which the first match decides.
TITLE_RULES = (
    ("main_page", r"^Main Page$"),
    ("low_signal_title", r"^\."),
    ("namespace", r"^(Category|File|Help|Portal|Special|Talk|Template|User|Wikipedia):"),
    ("deaths", r"^Deaths in "),
    ("list", r"^(Index of|List of|Lists of|Timeline of) "),
    ("current_event_year", r"^20(?:2[0-6])_.+|^20(?:2[0-6]) .+|^20(?:2[0-6])$"),
    ("entertainment", r"(?i)\([^)]*\b(?:film|film series|TV series|album|song|video game)\)$|\bseason [0-9]+\b|^[0-9]{4} in film$"),
)
#: What a lead says of people, works and companies that are not taken.
BIOGRAPHY = (
    "actor|actress|singer|rapper|musician|songwriter|television personality|media personality|youtuber|streamer|model|politician|businessman|"
    "businesswoman|political activist|professional wrestler|mixed martial artist|film director|filmmaker|murderer|serial killer|sex offender|footballer|"
    "basketball player|baseball player|baseball outfielder|baseball shortstop|baseball infielder|baseball pitcher|baseball catcher|cricketer|"
    "tennis player|golfer|boxer|quarterback|linebacker|wide receiver|running back|ice hockey player|racing driver"
)
ENTERTAINMENT = "film|television series|tv series|album|song|professional football club|sports club|sports competition|wrestling event"
ADULT = (
    "pornography website|pornographic website|pornographic video sharing website|adult entertainment website|adult entertainment company|"
    "pornographic film|adult film|anime and manga pornography"
)
LOCALITIES = "unincorporated community|census-designated place|village|township"
#: Lead rules, the text length below which a place's article is taken for a stub, and the least text length.
LEAD_RULES = (
    ("lead_biography_noise", rf"(?i)\b(?:is|was|are|were) an? [^.]{{0,100}}\b({BIOGRAPHY})\b"),
    ("lead_entertainment_noise", rf"(?i)\b(?:is|was|are|were) an? [^.]{{0,120}}\b({ENTERTAINMENT})\b"),
    ("lead_adult_entertainment_noise", rf"(?i)\b({ADULT})\b"),
)
LOCALITY, LOCALITY_LENGTH, SHORT = rf"(?i)\b(?:is|was) an? (?:{LOCALITIES})\b", 5000, 1500


def title_reason(title: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in TITLE_RULES:
        out = out.when(title.rlike(pattern), name)
    return out


def lead_reason(lead: Column, length: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in LEAD_RULES:
        out = out.when(lead.rlike(pattern), name)
    return out.when(lead.rlike(LOCALITY) & (length < LOCALITY_LENGTH), "lead_low_signal_locality")


def judged(totals: DataFrame, articles: DataFrame, disambiguations: DataFrame, processed: DataFrame, least_length: int = SHORT) -> DataFrame:
    """totals with page_id, text_length and reason (null: accepted). articles: (title, page_id, lead, text_length)."""
    known = articles.select(F.col("title").alias("_t"), "page_id", "lead", "text_length")
    rows = totals.join(known, totals["title"] == known["_t"], "left").drop("_t")
    rows = rows.join(disambiguations.select("title", F.lit(True).alias("_d")).distinct(), "title", "left").join(processed.select("page_id", F.lit(True).alias("_p")).distinct(), "page_id", "left")
    reason = F.coalesce(
        title_reason(F.col("title")),
        F.when(F.col("_d"), "disambiguation"),
        F.when(F.col("page_id").isNull(), "missing_article"),
        F.when(F.col("_p"), "processed"),
        F.when(F.col("text_length") < least_length, "short_text"),
        lead_reason(F.col("lead"), F.col("text_length")),
    )
    return rows.withColumn("reason", reason).drop("_d", "_p", "lead")


ORDER = (F.desc, "score"), (F.desc, "months_seen"), (F.desc, "total_views"), (F.asc, "best_rank"), (F.asc, "title")


def selected(rows: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages accepted rows in ranking order, with selection_rank."""
    order = [f(c) for f, c in ORDER]
    top = rows.filter("reason IS NULL").orderBy(*order).limit(max_pages)  # a ranked top-k: its size is the caller's bound
    return top.withColumn("selection_rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `_position` from 1 in a total order, by a prefix scan: no task sorts more than its range.

    The rows are cut into ranges of the order and written down, so that both passes see the same ranges; one number a
    range, its rows, goes to the driver.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn("_position", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def selection_summary(rows: DataFrame, max_pages: int) -> DataFrame:
    """(counter, n) of a selection that goes through judged rows in ranking order and stops at the max_pages-th accepted one: total_input, selected, and rejected_<reason> of the rows that it saw."""
    placed = positions(rows, [f(c) for f, c in ORDER])
    accepted = placed.filter("reason IS NULL").orderBy("_position").limit(max_pages)
    last = accepted.agg(F.count("*").alias("n"), F.max("_position").alias("at")).withColumn("stop", F.when(F.col("n") >= max_pages, F.col("at")))
    seen = placed.filter("reason IS NOT NULL").join(F.broadcast(last.select("stop")), F.col("stop").isNull() | (F.col("_position") <= F.col("stop")))  # one row
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    return count(rows, "total_input").union(last.select(F.lit("selected"), "n")).union(seen.groupBy(F.concat(F.lit("rejected_"), "reason")).agg(F.count("*")))


def submission_plan(candidates: DataFrame, documents: DataFrame, processed: DataFrame, units: DataFrame) -> DataFrame:
    """(page_id, action): what a replay does with each candidate.  Raises nothing: a candidate without a document is `missing`."""
    has = lambda df, name: df.select("page_id", F.lit(True).alias(name)).distinct()
    rows = candidates.select("page_id").join(has(documents, "d"), "page_id", "left").join(has(processed, "p"), "page_id", "left").join(has(units, "u"), "page_id", "left")
    action = F.when(F.col("d").isNull(), "missing").when(F.col("p") & F.col("u"), "skip_processed").when(F.col("u"), "mark_processed").when(F.col("p"), "skip_existing").otherwise("insert")
    return rows.select("page_id", action.alias("action"))


def source_units(documents: DataFrame) -> DataFrame:
    """(source_ref, title, metadata) of documents (page_id, title, url, rank)."""
    return documents.select(T.source_ref(F.col("page_id")).alias("source_ref"), "title", F.create_map(F.lit("url"), "url", F.lit("rank"), F.col("rank").cast("string")).alias("metadata"))


def page_kind(namespace: Column, title: Column, body: Column) -> Column:
    """ignored, redirect, disambiguation or article; the first that fits."""
    return (
        F.when(namespace != 0, "ignored")
        .when(body.rlike(r"(?i)^\s*#redirect"), "redirect")
        .when(title.rlike(r"\(disambiguation\)$") | body.rlike(r"(?i)\{\{\s*disambig"), "disambiguation")
        .otherwise("article")
    )


def clean_html(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags to blanks, common entities decoded, white space collapsed."""
    for pattern, to in ((r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = F.regexp_replace(html, pattern, to)
    return F.trim(F.regexp_replace(html, r"[ \t\n\r\f\x0B]+", " "))


def clean_wikitext(text: Column) -> Column:
    """Wikitext without comments, references, templates, tables, files, markup and link syntax."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"(?s)\{\|.*?\|\}", ""), *[(r"(?s)\{\{[^{}]*\}\}", "")] * 4, (r"(?i)\[\[(File|Image|Category):[^\[\]]*\]\]", ""), (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"), (r"\[https?://\S+ ([^\]]*)\]", "$1"), (r"'{2,5}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))
