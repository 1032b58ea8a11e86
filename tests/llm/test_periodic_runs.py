from __future__ import annotations

import random
import zlib

import numpy as np

from cardloom.llm import periodic_runs as runs

from .helpers import clashing, frame, sha, words


def brute(w, least=runs.LEAST):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def looped(doc_id, text):
    w, h = words(text), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words(text))
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def expected(doc_id, text):
    w = looped(doc_id, text)
    found = brute(w)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(found), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repeating(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kinds = rng.choice([1, 2, 3, 40])
        w = [f"w{rng.randrange(kinds)}é" for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5 and len(w) > 8:
            p = rng.randint(1, len(w) // 3)
            a = rng.randrange(len(w) - p)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(w)))
    return rows


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "x"), (904, "x " * 11), (905, "x " * 12), (906, "a b c " * 500), (907, "漢 字 " * 9), (None, "a b " * 20), (905, "y y x " * 8), (906, "a b c " * 500)]


def test_core_against_every_period():
    for rows in (repeating(s, 7) for s in range(60)):
        texts = [words(t) for _, t in rows]
        bounds = np.cumsum([0, *map(len, texts)])
        names = {w: k for k, w in enumerate(dict.fromkeys(x for t in texts for x in t))}
        row, start, length, period = runs.runs(np.array([names[x] for t in texts for x in t], np.int64), bounds)
        got = [(int(r), int(a), int(b), int(c)) for r, a, b, c in zip(row, start, length, period, strict=True)]
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t)]


def test_suffix_array_and_extensions():
    rng = random.Random(3)
    for _ in range(40):
        s = [rng.randrange(rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 60))] + [99]
        order, rank, lcp = runs.suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:]) and rank[order].tolist() == list(range(len(s)))
        common = lambda a, b: next(k for k in range(len(s) + 1) if a + k == len(s) or b + k == len(s) or s[a + k] != s[b + k])
        assert lcp[1:].tolist() == [common(a, b) for a, b in zip(order[:-1], order[1:], strict=True)]
        pairs = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]
        if pairs:
            a, b = np.array(pairs).T
            assert runs.Extensions(np.array(s)).of(a, b).tolist() == [common(x, y) for x, y in pairs]


def test_query_against_brute_force(spark, tmp_path):
    rows = [*repeating(8, 60), *EDGES]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, *expected(i, t)) for i, t in rows), key=str)


def test_points_are_dealt_in_parts(monkeypatch):
    ids = np.array([k % 5 for k in range(300)], np.int64)
    whole = [x.tolist() for x in runs.runs(ids, np.array([0, 300]))]
    monkeypatch.setattr(runs, "POINTS", 40)
    assert [x.tolist() for x in runs.runs(ids, np.array([0, 300]))] == whole == [[0], [0], [300], [5]]


def test_operator_keeps_columns_of_any_name_and_empty_tables(spark):
    docs = clashing(frame(spark, [(1, "a b " * 10), (2, None)]))
    got = {r["doc_id"]: r for r in runs.periodic(docs).collect()}
    assert set(docs.columns) < set(got[1].asDict()) and got[1]["part"] == "mine"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 20, 2)] and got[1]["collapsed"] == "a b" and got[1]["text"] == "a b " * 10
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["text"] is None
    assert runs.periodic(frame(spark, [])).count() == 0
