from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from cardloom.llm import embedding_dedup as E
from cardloom.llm import pii, quality, simhash

from .helpers import clashing, components, corpus, frame, removed_windows, words


def vectors(seed=1, n=400, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    near = base[rng.integers(0, n, n // 2)] + rng.normal(scale=0.15, size=(n // 2, width))
    many = base[0] + rng.normal(scale=0.05, size=(150, width))
    rows = [[float(np.float32(x)) for x in v] for v in np.concatenate([base, near, many, base[:20]])]
    return [(i, v, 0) for i, v in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, t=0.9):
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= t
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), components(ids, ((ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)))


def test_links_equal_brute_force_at_full_recall(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)  # hot cells fall into many blocks
    rows = vectors()
    n, component = expected(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.link_vectors(clashing(spark.createDataFrame(rows, SCHEMA).repartition(5)), target_recall=1.0).collect()}
    assert got == {i: (n[i], component[i]) for i in n}


def test_measured_recall_reaches_the_target(spark):
    rows = vectors(2, 900)
    n, _ = expected(rows)
    got = {r["vec_id"]: r["n_links"] for r in E.link_vectors(spark.createDataFrame(rows, SCHEMA), target_recall=0.95).collect()}
    assert all(got[i] <= n[i] for i in n) and sum(got.values()) >= 0.9 * sum(n.values())


def test_cells_are_visited_nearest_first_and_less_recall_stops_sooner():
    x = np.array([v for _, v, _ in vectors(3, 400)], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = x.shape[1] // 2
    grid = E.Grid(E.codebook(x[:, :half], 8), E.codebook(x[:, half:], 8))
    most = grid.stop(x, 0.9, 1.0)
    home, row, cell = grid.visits(x, most)
    _, (a, b) = grid.bounds(x)
    bound = a[row, cell // 8] + b[row, cell % 8]
    assert most == pytest.approx(0.2) and all((np.diff(bound[row == r]) >= 0).all() for r in range(len(x))) and bound.max() <= most + 1e-9
    want = {(r, i * 8 + j) for r in range(len(x)) for i in range(8) for j in range(8) if a[r, i] + b[r, j] <= most and i * 8 + j <= home[r]}
    assert set(zip(row.tolist(), cell.tolist(), strict=True)) == want
    stops = [grid.stop(x, 0.9, t) for t in (0.5, 0.9, 0.99, 1.0)]
    assert stops == sorted(stops) and len(grid.visits(x, stops[0])[2]) <= len(cell)


def test_small_groups_keep_their_links_beside_a_large_one(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 16))
    pairs = base[:200] + rng.normal(scale=0.22, size=(200, 16))
    many = base[699] + rng.normal(scale=0.02, size=(500, 16))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(np.concatenate([base, pairs, many]))]
    n, component = expected(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (n[i], component[i]) for i in n}


def test_links_of_rarer_lengths_and_negative_ids(spark):
    rows = [(-5, [1.0, 0.0, 0.0], 0), (-4, [1.0, 0.1, 0.0], 0), (2**60 + 1, [0.0, 0.0, 1.0], 0), (2**60 + 3, [0.0, 0.1, 1.0], 0), (None, [0.0, 0.11, 1.0], 0)]
    rows += [(8, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [2.0, 0.1], 0), (11, [3.0], 0), (12, [4.0], 0), (13, [-4.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {-5: (1, -5), -4: (1, -5), 2**60 + 1: (2, 2**60 + 1), 2**60 + 3: (2, 2**60 + 1), None: (2, None), 8: (2, 8), 9: (2, 8), 10: (2, 8), 11: (1, 11), 12: (1, 11), 13: (0, 13)}


def test_vectors_that_link_with_nothing(spark):
    one = [1.0] + [0.0] * 3
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, None, 0), (4, [0.0] * 4, 0), (5, [float("nan"), 1.0, 0.0, 0.0], 0), (6, [None, 1.0, 0.0, 0.0], 0), (7, [1.0], 0), (8, [float("inf"), 0.0, 0.0, 0.0], 0), (9, [-1.0, 0.0, 0.0, 0.0], 0), (10, [1e30, 1e-30, 0.0, 0.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 3, 1)]
    assert E.link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = E.Grid(E.codebook(x[:, :5], 6), E.codebook(x[:, 5:], 6))
    home, (a, b) = grid.bounds(x)
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert (a[:, home // 6] + b[:, home % 6] <= apart + 1e-9).all()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    C = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rows = [*corpus(21, 64), (900, "mail me at a.b@c.org now " + " ".join(f"word{k}" for k in range(30)))]
    docs = frame(spark, rows)
    kept = [r["doc_id"] for r in quality.quality(docs.select("doc_id", "text")).filter("kept").collect()]
    stage = {i: t for i, t in rows if i in kept}
    fps = {i: simhash.fingerprint(t) % (1 << 64) for i, t in stage.items()}
    group = components(fps, [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3])
    stage = {i: t for i, t in stage.items() if group[i] == i}
    after = {}
    for i, (own, gone) in removed_windows(list(stage.items()), 20, words).items():
        after[i] = " ".join(w for w, g in zip(own, gone, strict=True) if not g) if any(gone) else stage[i]
    anchors = pii.automaton()
    clean = {i: pii.redact(t, [{"kind": k, "start": a, "end": b} for k, a, b in pii.spans(t, anchors)]) for i, t in after.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = C.run(spark, str(tmp_path)).collect()
    found = {}
    for r in pieces:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == expected[r["doc_id"]]
    assert found == expected and "<EMAIL>" in clean[900]
    out = docs
    for _, f in C.STAGES[:-1]:
        out = f(spark, out, str(tmp_path))
        assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == clean
    for _, f in C.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
