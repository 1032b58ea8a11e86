"""Batches of lexical and vector searches, their fusion, and connected titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.functions import vectors as V
from cardloom.operators import fulltext
from cardloom.operators.graph import adjacency, blocked_topk


def _rank(df: DataFrame, name: str, *order: Column, limit: int | None = None) -> DataFrame:
    df = df.withColumn(name, F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))
    return df if limit is None else df.filter(F.col(name) <= limit)


def vector_topk(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(query_id, node_id, similarity, vector_rank); queries (query_id, embedding), vectors (node_id, embedding) of unit length."""
    found = blocked_topk(queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v")), vectors.select(F.col("node_id").alias("id"), F.col("embedding").alias("v")), limit)
    return found.select(F.col("src").alias("query_id"), F.col("dst").alias("node_id"), F.col("dot").alias("similarity"), F.col("rank").alias("vector_rank"))


def title_flags(title: Column, query: Column) -> tuple[Column, Column, Column]:
    """Exact, phrase and all-token matches of a title, as 0 or 1; query is normalised."""
    exact = F.lower(title) == query
    phrase = F.contains(F.lower(title), query)
    tokens = F.size(F.array_except(T.tokens(query), T.tokens(title))) == 0
    return tuple(F.coalesce(x, F.lit(False)).cast("int") for x in (exact, phrase, tokens))


def lexical_matches(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, query, node_id, title, exact, phrase, all_tokens, score): cards that hold every token of a query.

    Queries are (query_id, query_text).  A query meets the cards on its rarest token only, the other
    tokens are tested on the pairs so found; the score counts occurrences, a title's
    1.0 and a content's 0.4 each.
    """
    asked = queries.select("query_id", T.normalised(F.col("query_text")).alias("query"))
    asked = asked.withColumn("terms", F.array_distinct(T.tokens(F.col("query")))).filter(F.size("terms") > 0)
    own = cards.select("node_id", "title", T.tokens(F.col("title")).alias("tt"), T.tokens(F.col("content")).alias("ct"))
    postings = own.select("node_id", F.explode(F.array_distinct(F.concat("tt", "ct"))).alias("term"))
    wanted = asked.select("query_id", F.explode("terms").alias("term"))
    postings = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    common = postings.groupBy("term").agg(F.count("*").alias("df"))
    # A token that no card holds leaves its query without matches.
    rare = wanted.join(common, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
    pairs = rare.join(postings, "term").select("query_id", "node_id").join(asked, "query_id").join(own, "node_id")
    pairs = pairs.filter(F.size(F.array_except("terms", F.concat("tt", "ct"))) == 0)
    hits = lambda words: F.size(F.filter(words, lambda w: F.array_contains("terms", w)))
    exact, phrase, all_tokens = title_flags(F.col("title"), F.col("query"))
    return pairs.select("query_id", "query", "node_id", "title", exact.alias("exact"), phrase.alias("phrase"), all_tokens.alias("all_tokens"), (hits("tt") * 1.0 + hits("ct") * 0.4).alias("score"))


def lexical_topk(queries: DataFrame, cards: DataFrame, limit: int) -> DataFrame:
    """(query_id, node_id, exact, phrase, all_tokens, score, lexical_rank): the best of `lexical_matches`; cards meet the queries in parts, each of which passes on `limit` cards a query."""
    return fulltext.topk(queries.select("query_id", "query_text"), cards, limit, fulltext.TOKENS)


def hybrid(queries: DataFrame, cards: DataFrame, limit: int, pool: int, k: int = 60, named: DataFrame | None = None) -> DataFrame:
    """Fused ranking of active cards: (query_id, rank, node_id, rrf, lexical_rank, vector_rank).

    queries are (query_id, query_text, embedding); the vector side gives `pool` candidates, the lexical side `limit`: named, as
    full-text search ranks them (`fulltext.Searcher.topk`), or else what `lexical_topk` finds.
    """
    if pool < limit:
        raise ValueError("the vector pool must hold at least `limit` candidates")
    active = cards.filter("state = 'active'")
    near = vector_topk(queries.select("query_id", "embedding"), active.select("node_id", "embedding"), pool)
    named = lexical_topk(queries.select("query_id", "query_text"), active, limit) if named is None else named
    both = near.join(named, ["query_id", "node_id"], "full_outer").fillna(0, ["exact", "phrase", "all_tokens", "score"])
    both = both.withColumn("rrf", V.rrf(F.col("vector_rank"), k) + V.rrf(F.col("lexical_rank"), k))
    last = F.lit(limit + 1)
    order = [*(F.desc(c) for c in ("exact", "phrase", "all_tokens", "rrf", "score")), F.coalesce("lexical_rank", last), F.coalesce("vector_rank", last), F.col("node_id")]
    return _rank(both, "rank", *order, limit=limit).select("query_id", "rank", "node_id", "rrf", "lexical_rank", "vector_rank")


def connected_titles(matched: DataFrame, edges: DataFrame, cards: DataFrame, limit: int) -> DataFrame:
    """(query_id, position, title): titles of active neighbours of the matched cards (query_id, node_id), in order of match, neighbour, title.

    A title is given once and never if a matched card bears it.
    """
    titles = cards.select("node_id", "title", "state")
    # A query's few cards and titles travel with it, so that what was matched is found once.
    own = matched.join(titles.select("node_id", "title"), "node_id").groupBy("query_id").agg(F.collect_list(F.struct("node_id", "title")).alias("own"))
    own = own.select("query_id", F.col("own.node_id").alias("ids"), F.col("own.title").alias("names"), F.explode("own.node_id").alias("match_id"))
    near = own.join(adjacency(edges).select(F.col("node_id").alias("match_id"), F.col("neighbour_id").alias("node_id")), "match_id").filter(~F.array_contains("ids", F.col("node_id")))
    near = near.join(titles.filter("state = 'active'").select("node_id", "title"), "node_id").filter(~F.coalesce(F.array_contains("names", F.col("title")), F.lit(False)))
    first = near.groupBy("query_id", "title").agg(F.min(F.struct("match_id", "node_id")).alias("at"))
    return _rank(first, "position", F.col("at.match_id"), F.col("at.node_id"), F.col("title"), limit=limit).select("query_id", "position", "title")
