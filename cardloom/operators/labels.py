"""Labels of a layout: wrapped titles, their boxes on the screen, and the choice of those that do not cover each other.

Priority: selected and hovered nodes, then degree, then id.  Taken one after the other, a label would be shown if its box meets the
screen and no box shown before.  The same choice is made in rounds over a grid of the screen: in a round every label is shown that is the
best of all undecided ones in each square it touches (no better one can overlap it), and those it overlaps are out.  No scope is
gathered anywhere; each round is cut from the one before by a checkpoint.  There are as many rounds as the longest chain of labels
that wait for each other, few where titles lie apart.

Widths are those of an average character.  Titles that are null have no label, empty ones a box without width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import layout as L
from cardloom.sources.versioned import cut

#: Font size and offset in pixels, line height and greatest width in font sizes, average width of a character.
FONT, OFFSET = 24.0, 16.0
LINE, WIDEST, CHARACTER = 1.25, 16.0, 0.54
#: Characters that fit into a line.
FIT = max(n for n in range(1, 100) if n * FONT * CHARACTER <= FONT * WIDEST)


def wrapped(title: Column, fit: int = FIT) -> Column:
    """The lines of a title, filled word by word; a word that is too long is cut."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    cut_up = lambda w: F.regexp_replace(w, f"(.{{{fit}}})(?=.)", "$1\n")

    def add(text: Column, word: Column) -> Column:
        last = F.length(F.substring_index(text, "\n", -1))
        put = F.when(F.length(word) <= fit, word).otherwise(cut_up(word))
        return F.when(text == "", put).when(last + 1 + F.length(word) <= fit, F.concat(text, F.lit(" "), word)).otherwise(F.concat(text, F.lit("\n"), put))

    return F.split(F.aggregate(words, F.lit(""), add), "\n")


def boxes(placed: DataFrame, target: tuple[float, float], zoom: float, width: float, height: float) -> DataFrame:
    """placed (scope_id, node_id, x, y, title, ...) that have a label, with its lines and its sides x0, x1, y0, y1 on a canvas; those outside it are left out."""
    x, y = L.screen(F.col("x"), F.col("y"), target, zoom, width, height)
    rows = placed.filter("title IS NOT NULL").withColumn("lines", wrapped(F.col("title"))).withColumns({"_x": x, "_y": y})
    wide = F.least(F.lit(FONT * WIDEST), F.array_max(F.transform("lines", lambda t: F.length(t))) * (FONT * CHARACTER))
    high = FONT + (F.size("lines") - 1) * (FONT * LINE)
    rows = rows.withColumns({"x0": F.col("_x") - wide / 2, "x1": F.col("_x") + wide / 2, "y0": F.col("_y") + OFFSET, "y1": F.col("_y") + OFFSET + high}).drop("_x", "_y")
    return rows.filter((F.col("x1") >= 0) & (F.col("x0") <= width) & (F.col("y1") >= 0) & (F.col("y0") <= height))


def chosen(labels: DataFrame) -> DataFrame:
    """(scope_id, node_id) of the labels (scope_id, node_id, first, degree, x0, x1, y0, y1) that are shown; first marks selected and hovered nodes."""
    key = F.struct((-F.col("first").cast("int")).alias("a"), (-F.col("degree")).alias("b"), F.col("node_id").alias("c"))
    side = lambda c, size: F.floor(F.col(c) / size).cast("long")
    squares = lambda low, high, size: F.explode(F.sequence(side(low, size), side(high, size)))
    rows = labels.select("scope_id", "node_id", key.alias("key"), "x0", "x1", "y0", "y1")
    gridded = lambda df: df.withColumn("gx", squares("x0", "x1", FONT * WIDEST)).withColumn("gy", squares("y0", "y1", FONT * LINE * 3))
    left, shown = cut(rows), None
    while not left.isEmpty():
        grid = gridded(left)
        best = grid.groupBy("scope_id", "gx", "gy").agg(F.min("key").alias("best"))
        ahead = grid.join(best, ["scope_id", "gx", "gy"]).groupBy("scope_id", "node_id").agg(F.min(F.col("key") == F.col("best")).alias("all_best"))
        taken = cut(left.join(ahead.filter("all_best").select("scope_id", "node_id"), ["scope_id", "node_id"], "left_semi"))
        other = gridded(taken).select("scope_id", "gx", "gy", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y0").alias("v0"), F.col("y1").alias("v1"))
        met = grid.join(other, ["scope_id", "gx", "gy"]).filter("x0 <= u1 AND x1 >= u0 AND y0 <= v1 AND y1 >= v0").select("scope_id", "node_id").distinct()  # a taken label meets itself
        shown = taken if shown is None else shown.union(taken)
        left = cut(left.join(met, ["scope_id", "node_id"], "left_anti"))
    return (rows.limit(0) if shown is None else shown).select("scope_id", "node_id")
