"""A stored full-text index: postings sorted by lexeme, and segments for edits.

The index is a set of tables published together (`sources.versioned`): `postings`, blocks sorted by lexeme, so that the
statistics of files, row groups and pages lead a scan to the lexemes of a query; and `texts`, a row for each text and segment.
An upsert or a deletion adds a segment with the postings of its own texts and leaves all others as they are; a text is alive in the
newest segment that names it, and older postings of it are passed over when blocks are ranked.  `merged` makes one segment again.

The lexemes depend on the configuration, which is kept with the texts; an index is asked with the one it was made with.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import fulltext as X
from cardloom.sources import versioned

#: Bytes of a row group: a scan for one lexeme reads little more than its own blocks.
GROUP_BYTES = 1 << 20


def _sorted(blocks: DataFrame) -> DataFrame:
    return blocks.repartitionByRange("lexeme", "block", "segment").sortWithinPartitions("lexeme", "block", "segment")


class TextIndex:
    """The index below a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, docs: DataFrame, config: str = "english") -> TextIndex:
        """Index texts (node_id, title, content) in place of what the folder's index held."""
        return self._write(docs.withColumn("alive", F.lit(True)), 0, config, add=False)

    def upsert(self, docs: DataFrame) -> TextIndex:
        """Texts that are new or changed, by node_id."""
        return self._write(docs.withColumn("alive", F.lit(True)), self._next(), self.config(), add=True)

    def delete(self, nodes: DataFrame) -> TextIndex:
        """Texts (node_id) that go."""
        none = F.lit(None).cast("string")
        return self._write(nodes.select("node_id", none.alias("title"), none.alias("content"), F.lit(False).alias("alive")), self._next(), self.config(), add=True)

    def merged(self) -> TextIndex:
        """One segment of the texts that are alive: postings are moved, texts are not read."""
        config, live = self.config(), self._live()
        place = F.explode(F.arrays_zip("nodes", "titles", "positions")).alias("p")
        own = self._postings().select("lexeme", "segment", place).select("lexeme", "segment", F.col("p.nodes").alias("node_id"), F.col("p.titles").alias("titles"), F.col("p.positions").alias("positions"))
        own = own.join(live.select("node_id", "segment"), ["node_id", "segment"], "left_semi")
        block = F.floor(F.col("node_id") / X.BLOCK).cast("long").alias("block")
        impact = F.size("positions") * F.when(F.col("titles") > 0, X.TITLE).otherwise(X.CONTENT)
        found = own.groupBy("lexeme", block).agg(F.sort_array(F.collect_list(F.struct("node_id", "titles", "positions"))).alias("p"), F.max(impact).alias("impact"))
        blocks = found.select("lexeme", "block", F.lit(0).alias("segment"), F.col("p.node_id").alias("nodes"), F.col("p.titles").alias("titles"), F.col("p.positions").alias("positions"), "impact")
        return self._publish(blocks, live.withColumns({"segment": F.lit(0), "config": F.lit(config)}), add=False)

    def _next(self) -> int:
        return len(versioned.current(self.spark, self.root).tables["texts"])

    def config(self) -> str:
        return versioned.read(self.spark, self.root, "texts").select("config").first()["config"]

    def _write(self, docs: DataFrame, segment: int, config: str, add: bool) -> TextIndex:
        blocks = X.postings(docs.filter("alive"), config, segment)
        return self._publish(blocks, docs.select(F.col("node_id").cast("long").alias("node_id"), "title", "alive", F.lit(segment).alias("segment"), F.lit(config).alias("config")), add)

    def _publish(self, blocks: DataFrame, texts: DataFrame, add: bool) -> TextIndex:
        blocks = blocks.persist(StorageLevel.DISK_ONLY)  # sorting by ranges looks at its rows twice
        try:
            tables = {"postings": _sorted(blocks), "texts": texts.select("node_id", "title", "alive", "segment", "config")}
            versioned.publish(self.root, tables, add, **{"parquet.block.size": str(GROUP_BYTES)})
        finally:
            blocks.unpersist()
        return self

    def _postings(self) -> DataFrame:
        return versioned.read(self.spark, self.root, "postings")

    def _edits(self) -> DataFrame | None:
        """(node_id, segment, alive): the newest segment of each text that was changed since the index was built."""
        folders = versioned.current(self.spark, self.root).tables["texts"][1:]
        if not folders:
            return None
        rows = self.spark.read.parquet(*folders)
        return rows.groupBy("node_id").agg(F.max(F.struct("segment", "alive", "title")).alias("m")).select("node_id", "m.*")

    def _live(self) -> DataFrame:
        """(node_id, title, alive, segment) of the texts that are alive."""
        base = self.spark.read.parquet(versioned.current(self.spark, self.root).tables["texts"][0]).select("node_id", "title", "alive", "segment")
        edits = self._edits()
        if edits is None:
            return base
        return base.join(edits.select("node_id"), "node_id", "left_anti").unionByName(edits.filter("alive").select("node_id", "title", "alive", "segment"))

    def searcher(self) -> X.Searcher:
        """A search over the newest version."""
        edits = self._edits()
        if edits is not None:  # at most BLOCK texts a row
            edits = edits.groupBy(F.floor(F.col("node_id") / X.BLOCK).cast("long").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "segment"))).alias("edits"))
        return X.Searcher(self._postings(), self._live().select("node_id", "title"), self.config(), edits)


def of_application(spark: SparkSession, docs: DataFrame, name: str, config: str = "english") -> TextIndex:
    """The index of docs that this application has made under a name, built when first asked for."""
    index = TextIndex(spark, versioned.own_folder(spark, f"text-{name}"))
    return index if versioned.current(spark, index.root) else index.build(docs, config)
