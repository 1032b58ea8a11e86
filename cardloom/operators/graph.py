"""Similarity graph: exact blocked nearest neighbours, adjacency and mention links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.functions import vectors as V

#: Vectors of a side that meet in one task while a side has up to SIDE blocks; a vector travels once for each block of the other side,
#: so beyond these blocks grow, until one holds NUMBERS components.
BLOCK, SIDE, NUMBERS = 2048, 8, 1 << 21
#: Up to this many distinct leads of titles are looked for inside a row.
LEADS = 2000


def _in_order(df: DataFrame, n: int) -> DataFrame:
    """df (id, v) with its block of n, which cut the ids in order into parts of about one size."""
    if n == 1:
        return df.withColumn("block", F.lit(0))
    cuts = df.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n).alias("c")).first()["c"]  # n - 1 ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(np.array(cuts), batch.column("id").to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["id", "v", "block"])

    return df.mapInArrow(place, f"id long, v {df.schema['v'].dataType.simpleString()}, block int")


def _blocks(df: DataFrame) -> int:
    """How many blocks df (id, v) is cut into."""
    size = df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    return max(1, -(-size["n"] * max(size["width"] or 1, 1) // NUMBERS), min(-(-size["n"] // BLOCK), SIDE))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def blocked_topk(left: DataFrame, right: DataFrame, k: int, earlier_only: bool = False, least: float | None = None) -> DataFrame:
    """(src, dst, dot, rank): for each row of left its k best rows of right by dot product, ties by id.

    left and right are (id, v).  The sides meet block by block, each pair of blocks in one task, which passes on
    at most k rows a source; a vector travels once for every block that its own meets.  With earlier_only, for which both
    sides are the same vectors, a source sees smaller ids alone: blocks follow the ids, and of two blocks only the
    later one's sources meet the other, so that half of the pairs are never formed.
    """
    n_left = _blocks(left)
    n_right = n_left if right is left else _blocks(right)
    if earlier_only:
        if right is not left:
            raise ValueError("earlier_only compares vectors with themselves")
        rows = _in_order(left.select(F.col("id").cast("long").alias("id"), "v"), n_left)
        a = rows.select("id", "v", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("j"))
        b = rows.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.explode(F.sequence(F.col("block"), F.lit(n_left - 1))).alias("i2"), F.col("block").alias("j2"))
    else:
        own = lambda df, n: df.withColumn("block", (F.pmod(F.xxhash64("id"), F.lit(n))).cast("int"))
        others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = own(left, n_left).select("id", "v", F.col("block").alias("i"), others(n_right).alias("j"))
        b = own(right, n_right).select(F.col("id").alias("id2"), F.col("v").alias("v2"), others(n_left).alias("i2"), F.col("block").alias("j2"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(x) and len(y):
            ids = y["id2"].to_numpy()
            order = np.argsort(ids, kind="stable")
            p, q, ids, own = _matrix(x["v"]), _matrix(y["v2"])[order], ids[order], x["id"].to_numpy()
            step = max(1, min(256, NUMBERS // len(q)))
            for lo in range(0, len(p), step):
                s = p[lo : lo + step] @ q.T
                src = own[lo : lo + step]
                hidden = np.zeros(s.shape, bool) if least is None else s < least
                if earlier_only:
                    hidden |= ids[None] >= src[:, None]
                s[hidden] = -np.inf
                if k < s.shape[1]:  # all that reach the k-th product, so that ties are settled by id
                    bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    r, c = np.nonzero((s >= bound[:, None]) & np.isfinite(s))
                else:
                    r, c = np.nonzero(np.isfinite(s))
                by = np.lexsort((c, -s[r, c], r))
                r, c = r[by], c[by]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                keep = np.arange(len(r)) - np.repeat(first, np.diff(first, append=len(r))) < k
                r, c = r[keep], c[keep]
                found.append((src[r], ids[c], s[r, c]))
        src, dst, dot = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"src": src, "dst": dst, "dot": dot})

    part = a.groupBy("i", "j").cogroup(b.groupBy("i2", "j2")).applyInArrow(best, "src long, dst long, dot double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("dot"), "dst")).cast("long")
    return part.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_edges(vectors: DataFrame, top_k: int = 4, min_strength: float = 0.5) -> DataFrame:
    """(node_a_id, node_b_id, strength): each node's top_k earlier nodes of at least min_strength."""
    if top_k < 1 or not 0 <= min_strength <= 1:
        raise ValueError("top_k must be at least 1 and min_strength in [0, 1]")
    v = vectors.select(F.col("node_id").alias("id"), F.col("embedding").alias("v"))
    found = blocked_topk(v, v, top_k, earlier_only=True, least=2 * min_strength - 1)
    return found.select(F.col("dst").alias("node_a_id"), F.col("src").alias("node_b_id"), V.strength(F.col("dot")).alias("strength"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour_id, strength): each edge from both ends."""
    end = lambda own, other: F.struct(F.col(own).alias("node_id"), F.col(other).alias("neighbour_id"))
    ends = F.array(end("node_a_id", "node_b_id"), end("node_b_id", "node_a_id"))
    return edges.select(F.explode(ends).alias("e"), "strength").select("e.*", "strength")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_id)."""
    return edges.join(nodes, edges["node_a_id"] == nodes["node_id"], "left_semi").join(nodes, edges["node_b_id"] == nodes["node_id"], "left_semi")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among nodes, each once."""
    ends = edges.select("node_a_id", "node_b_id", "strength", F.explode(F.array("node_a_id", "node_b_id")).alias("node_id"))
    return ends.join(nodes, "node_id", "left_semi").select("node_a_id", "node_b_id", "strength").distinct()


def degree(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node_id").agg(F.countDistinct("neighbour_id").alias("degree"))


def mentions(contents: DataFrame, titles: DataFrame) -> DataFrame:
    """(content_id, title_id): the title's whole token phrase stands in the content.

    contents is (content_id, content), titles (title_id, title).  Titles meet contents on their
    first two tokens (one, if they have one), an equi-join; the phrase is then tested
    in full.  Titles without a token match nothing.
    """
    head = lambda t, n: F.array_join(F.slice(t, 1, n), " ")
    words = T.tokens(F.col("title"))
    named = titles.select("title_id", words.alias("w")).filter(F.size("w") > 0)
    named = named.select("title_id", head(F.col("w"), 2).alias("lead"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("phrase"))
    own = contents.select("content_id", T.tokens(F.col("content")).alias("w")).filter(F.size("w") > 0)
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)).otherwise(a))
    padded = own.select("content_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("padded"), F.array_distinct(F.concat("w", pairs)).alias("leads"))
    few = [r["lead"] for r in named.select("lead").distinct().limit(LEADS + 1).collect()]
    if len(few) <= LEADS:
        # The leads that titles have are found inside the row: only contents that hold one go on, and none is shuffled.
        some = padded.withColumn("leads", F.array_intersect("leads", F.lit(few).cast("array<string>"))).filter(F.size("leads") > 0)
        found = some.select("content_id", "padded", F.explode("leads").alias("lead")).join(named, "lead")
    else:
        met = padded.select("content_id", F.explode("leads").alias("lead")).join(named.select("lead").distinct(), "lead", "left_semi")
        found = met.join(named, "lead").join(padded.select("content_id", "padded"), "content_id")
    return found.filter(F.contains("padded", "phrase")).select("content_id", "title_id").distinct()


def initial_edges(cards: DataFrame, mention_pairs: DataFrame, mention_k: int = 2, candidates: int = 9, semantic_k: int = 4, min_strength: float = 0.61) -> DataFrame:
    """(node_id, neighbour_id, strength, kind): links of each new card.

    mention_pairs is (node_id, neighbour_id).  The best mention_k mentions all become links; the best
    `candidates` of the other cards are then cut at min_strength and semantic_k.
    """
    if candidates < semantic_k:
        raise ValueError("candidates must be at least semantic_k")
    v = cards.select("node_id", "embedding")
    near = v.select(F.col("node_id").alias("neighbour_id"), F.col("embedding").alias("other"))
    pairs = mention_pairs.filter("node_id <> neighbour_id").join(v, "node_id").join(near, "neighbour_id").withColumn("dot", V.dot(F.col("embedding"), F.col("other")))
    ranked = lambda df: df.withColumn("k", F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("dot"), "neighbour_id")))
    named = ranked(pairs).filter(F.col("k") <= mention_k).select("node_id", "neighbour_id", "dot")
    ids = v.select(F.col("node_id").alias("id"), F.col("embedding").alias("v"))
    # Of the best candidates + mention_k + itself, at most mention_k + 1 can be excluded.
    pool = blocked_topk(ids, ids, candidates + mention_k + 1).select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour_id"), "dot").filter("node_id <> neighbour_id")
    rest = ranked(pool.join(named, ["node_id", "neighbour_id"], "left_anti")).filter(F.col("k") <= candidates)
    rest = rest.filter((V.strength(F.col("dot")) >= min_strength) & (F.col("k") <= semantic_k))
    out = named.withColumn("kind", F.lit("mention")).unionByName(rest.select("node_id", "neighbour_id", "dot").withColumn("kind", F.lit("semantic")))
    return out.select("node_id", "neighbour_id", V.strength(F.col("dot")).alias("strength"), "kind")


def materialised(cards: DataFrame, mention_pairs: DataFrame, root_id: int = 1) -> dict[str, DataFrame]:
    """What new cards (node_id, title, content, embedding) become, to be published as one version: `nodes` with their vectors, `versions` (each card's first), `assignments` to Root and `edges`."""
    return {
        "nodes": cards.select("node_id", "embedding", F.lit("active").alias("state"), F.lit(1).cast("long").alias("current_version")),
        "versions": cards.select("node_id", F.lit(1).cast("long").alias("version"), "title", "content"),
        "assignments": cards.select("node_id", F.lit(root_id).cast("long").alias("taxonomy_node_id")),
        "edges": initial_edges(cards, mention_pairs),
    }
