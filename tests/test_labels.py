"""Labels against a choice made one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import labels


def lines_of(title, fit):
    out, line = [], ""
    for word in title.split() or [""]:
        if len(f"{line} {word}" if line else word) <= fit:
            line = f"{line} {word}" if line else word
            continue
        if line:
            out.append(line)
        while len(word) > fit:
            out.append(word[:fit])
            word = word[fit:]
        line = word
    return [*out, line] if line or not out else out


def test_titles_are_wrapped(spark):
    rng = random.Random(2)
    titles = ["", "  ", "one", "abcdefgh", "abcdefghi jk", *(" ".join("é" * rng.randint(1, 20) for _ in range(rng.randint(0, 6))) for _ in range(200))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, title string")
    got = {r["id"]: list(r["lines"]) for r in frame.select("id", labels.wrapped(F.col("title"), 8).alias("lines")).collect()}
    assert got == {i: lines_of(t, 8) for i, t in enumerate(titles)}
    assert labels.FIT == 29


@pytest.mark.parametrize("seed", [1, 2])
def test_choice_equals_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    rows = [(s, i, rng.uniform(-700, 700), rng.uniform(-400, 400), rng.randint(0, 4), rng.random() < 0.05, rng.choice([None, "t" * rng.randint(1, 60), "two words"])) for s in (1, 2) for i in range(90)] + [(3, 1, 0.0, 0.0, 0, False, "x")] * 1
    placed = spark.createDataFrame(rows, "scope_id long, node_id long, x double, y double, degree long, first boolean, title string").repartition(3)
    boxed = labels.boxes(placed, (10.0, -5.0), -0.5, 900.0, 500.0)
    want: dict = {}
    for r in sorted(boxed.collect(), key=lambda r: (not r["first"], -r["degree"], r["node_id"])):
        own = want.setdefault(r["scope_id"], [])
        if all(r["x1"] < o["x0"] or r["x0"] > o["x1"] or r["y1"] < o["y0"] or r["y0"] > o["y1"] for o in own):
            own.append(r)
    got = sorted((r["scope_id"], r["node_id"]) for r in labels.chosen(boxed).collect())
    assert got == sorted((s, r["node_id"]) for s, own in want.items() for r in own) and len(got) > 20
    assert labels.chosen(boxed.limit(0)).count() == 0
