from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import quality_classifier as classifier

from .helpers import clashing, frame, lower, words


def labelled(seed, n):
    """Prose of two vocabularies, and junk of some kinds."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        say = lambda k: [rng.choice(["the", "of", "und", "läuft", "river", "stone", "house", "green"]) + rng.choice(["", "", "s", "er"]) for _ in range(k)]
        own, bad = say(rng.randint(15, 120)), rng.random() < 0.4
        if bad:
            kind = rng.randrange(3)
            own = [w.upper() + "!!" for w in own] if kind == 0 else [w + "$$$" for w in own] if kind == 1 else own[:1] * len(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(not bad)))
    return rows, labels


def blocks_of(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_linear_time_margin_equals_all_pairs():
    rows, labels = labelled(2, 60)
    got = classifier.features(*blocks_of([t for _, t in rows]), np.full(len(rows), np.nan))
    model = classifier.fitted(*got, np.array([float(y) for _, y in labels]))
    bounds, f, x = model.whole(*got)
    margins, _ = model.margins(bounds, f, x)
    for k in range(len(rows)):
        own = range(bounds[k], bounds[k + 1])
        want = model.bias + sum(model.weight[f[i]] * x[i] for i in own)
        want += sum(float(model.factors[f[i]] @ model.factors[f[j]]) * x[i] * x[j] for i in own for j in own if i < j)
        assert margins[k] == pytest.approx(want, abs=1e-9)
    assert np.abs(model.factors).max() > 0.01 and len(f) == len(set(zip(np.repeat(range(len(rows)), np.diff(bounds)).tolist(), f.tolist(), strict=True)))


def test_features_count_whole_texts():
    texts = ["Ab ab AB 12 x!! x!!\nab", None, "  ", "same line\nsame line\nother"]
    bounds, buckets, values, stats = classifier.features(*blocks_of(texts), np.array([21.0, np.nan, 2, 26]))
    by = dict(zip(classifier.STATISTICS, stats.T, strict=True))
    assert by["n_words"].tolist() == [len(words(t)) for t in texts] == [7, 0, 0, 5]
    assert by["distinct_words"][0] == len({lower(w) for w in words(texts[0])}) / 7 and by["top_word"][0] == 4 / 7
    assert by["dup_lines"][3] == 1 / 5 and by["longest_word"].tolist() == [3, 0, 0, 5] and by["lines"][0] == 1 / 7
    words_of_first = buckets[: bounds[1]]
    assert (words_of_first < classifier.WORDS).sum() == 3 and (words_of_first >= classifier.WORDS).sum() == 5  # ab 12 x!!; Aa a A 0 a!
    assert bounds.tolist()[1:3] == [bounds[1]] * 2
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        for own in (buckets[lo:hi] < classifier.WORDS, buckets[lo:hi] >= classifier.WORDS):
            assert not own.any() or np.square(values[lo:hi][own]).sum() == pytest.approx(1)


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = labelled(4, 700)
    rows += [(9001, None), (9002, ""), (None, "the river"), (9001, "THE!! RIVER!!")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    rest = [(None, 1, 0), (9001, None, 0), (77777, 0, 1)]
    spark.createDataFrame([*((i, y, 0) for i, y in labels), *rest], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = classifier.op13_quality_classifier(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    truth = dict(labels)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    rows, labels = labelled(6, 120)
    docs, other = frame(spark, rows), frame(spark, rows, 5)
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    first = {r["doc_id"]: r["score"] for r in classifier.score(docs, classifier.train(docs, given)).collect()}
    moved = clashing(other).withColumns({"lang": F.lit("xx"), "source": F.lit("elsewhere"), "label": F.lit(0)})
    assert {r["doc_id"]: r["score"] for r in classifier.score(moved, classifier.train(moved, given)).collect()} == pytest.approx(first, abs=1e-12)


def test_bound_of_the_sample_and_tables_without_labels(spark):
    rows, labels = labelled(7, 60)
    docs = frame(spark, [*rows, *[(0, "the same id again")] * 40])
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    small = classifier.train(docs, given, sample=8)
    assert np.count_nonzero(small.weight) > 0
    none = classifier.train(docs, given.filter("doc_id < 0"))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}
    one = classifier.train(docs, given.filter("quality = 1"))
    assert {round(r["score"], 9) for r in classifier.score(docs.filter("doc_id > 0"), one).collect()} == {round(classifier.score(docs.limit(1), one).first()["score"], 9)} and one.bias > 0
    assert classifier.score(frame(spark, []), none).count() == 0 and classifier.train(frame(spark, []), given).bias == 0
    assert classifier.score(docs.drop("n_chars"), small).count() == 100
