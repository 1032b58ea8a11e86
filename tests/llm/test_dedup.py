from __future__ import annotations

import random

import numpy as np
import pyarrow.compute as pc
import pytest
import xxhash

from cardloom.llm import components as C
from cardloom.llm import countmin, simhash, substring_dedup, suffix_dedup
from cardloom.llm.textview import leaders, merge_spans

from .helpers import clashing, components, corpus, frame, lower, removed_windows, sha, words


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(clashing(frame(spark, rows))).collect()}
    for i, (own, gone) in removed_windows(rows, 20, words).items():
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(own), sum(gone))
        assert r["kept_text"] == " ".join(w for w, g in zip(own, gone, strict=True) if not g)


def test_substring_dedup_in_many_chunks_and_flushes(spark, monkeypatch):
    """Texts packed into several chunks, each of several blocks whose windows are emitted a few at a time."""
    rows = corpus(seed=6)
    plain = {r["doc_id"]: tuple(r) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "_FLUSH", 40)
    assert {r["doc_id"]: tuple(r) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()} == plain


def test_substring_dedup_edges(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (None, text), (7, None), (7, None), (9, "x " * 45)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, rows, 1)).collect())
    assert got == [(False, 5, 30, 0), (False, 5, 30, 0), (False, 7, 0, 0), (False, 7, 0, 0), (False, 9, 45, 44), (True, 0, 30, 30)]


def test_without_repeats_keeps_columns_and_untouched_texts(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = clashing(frame(spark, [(1, text), (2, f"{text}  tail\n"), (3, "left  as\tit is"), (4, None)]))
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: (text, len(text)), 2: ("tail", 4), 3: ("left  as\tit is", 14), 4: (None, None)}


def test_groups_split_over_many_tasks(spark):
    """A passage in every document, over more tasks than buckets hold."""
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(frame(spark, rows, 16)).collect()}
    assert got == {0: 0, **{i: 25 for i in range(1, 300)}}


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(clashing(frame(spark, rows))).collect()}
    for i, (own, gone) in removed_windows(rows, 100, lambda t: (t or "").encode()).items():
        r = got[i]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"])) == (len(own), sum(gone), runs)
        assert bytes(r["kept"]) == bytes(b for b, g in zip(own, gone, strict=True) if not g)


def test_suffix_dedup_edges_and_hot_line(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(80)) + line + "".join(rng.choice("uvw ") for _ in range(80))) for i in range(120)]
    rows += [(500, "q" * 350), (500, "q" * 350), (None, line), (501, None)]
    got = [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]]) for r in suffix_dedup.suffix_dedup(frame(spark, rows, 12)).collect()]
    by = {}
    for i, n, spans in got:
        by.setdefault(i, []).append((n, spans))
    assert by[0] == [(290, [])]
    assert all(by[i][0][1] == [(80, 210)] or by[i][0][1][0][0] <= 80 for i in range(1, 120))
    assert by[None] == [(130, [(0, 130)])] and by[501] == [(0, [])]
    assert by[500] == [(350, [(1, 350)])] * 2


def test_suffix_array_and_interval_tree():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 400)
    pos = np.arange(300)
    size = np.minimum(40, 400 - pos)
    order, common = suffix_dedup.suffix_array(data, pos, size, 40)
    texts = [data[p : p + s].tobytes() for p, s in zip(pos[order], size[order], strict=True)]
    assert texts == sorted(texts)
    before = np.where(pos[order] > 0, data[pos[order] - 1].astype(int), -1)
    found = {}
    for lo, hi, depth, diverse in suffix_dedup.interval_tree(common, 5, before):
        own = texts[lo][:depth]
        members = [k for k, t in enumerate(texts) if t.startswith(own)]
        assert members == list(range(lo, hi)) and hi - lo > 1
        assert len({t[: depth + 1] for t in texts[lo:hi]}) > 1 or len(texts[lo]) == depth or len(texts[hi - 1]) == depth
        lefts = [int(b) for b in before[lo:hi]]
        assert diverse == (len(set(lefts)) > 1 or -1 in lefts)
        found[own] = hi - lo
    expected = {t[:k] for t in texts for k in (5,) if sum(x.startswith(t[:k]) for x in texts) > 1}
    assert {k[:5] for k in found} == expected


def test_repeat_groups_hold_all_occurrences(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(140))
    rows = [(i, f"{i:05d}" * 7 + passage + f"{i:04d}" * 9) for i in range(6)]
    got = suffix_dedup.repeat_groups(frame(spark, rows)).collect()
    groups = {}
    for r in got:
        text = dict(rows)[r["doc_id"]].encode()[r["start"] : r["start"] + r["size"]]
        groups.setdefault((r["group_id"], r["size"]), []).append((text, r["doc_id"], r["earliest"]))
    assert groups
    for members in groups.values():
        assert len({t for t, _, _ in members}) == 1 and len(members) >= 2
    assert any(len(m) == 6 and sum(e for _, _, e in m) == 1 for m in groups.values())


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ("", "one", "One two", "a b c d a b c", "Ä b\tc\n d"):
        own = words(lower(text))
        shingles = [" ".join(own[j : j + 3]) for j in range(max(1, len(own) - 2))] if own else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
        assert simhash.fingerprint(text) % (1 << 64) == bits


@pytest.mark.parametrize("blocks", [1, 2])
def test_pairs_within_three_bits_share_an_anchor(blocks):
    rng = np.random.default_rng(blocks)
    x = rng.integers(-(2**63), 2**63, 500, dtype=np.int64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 1 + i % 3, replace=False):
            y[i] ^= np.uint64(1 << int(b)).view(np.int64)
    hx, rx, ax = simhash.visits(x, blocks)
    hy, ry, ay = simhash.visits(y, blocks)
    vx, vy = set(zip(rx.tolist(), ax.tolist(), strict=True)), set(zip(ry.tolist(), ay.tolist(), strict=True))
    assert all((i, hx[i]) in vy or (i, hy[i]) in vx for i in range(500))


def test_simhash_components_against_brute_force(spark, monkeypatch):
    rows = [*corpus(5), (1000, ""), (1001, None), (1002, "   ")]
    fps = {i: simhash.fingerprint(t) % (1 << 64) for i, t in rows}
    links = [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3]
    expected = components(fps, links)
    for first in (simhash.TWO_BLOCKS_FROM, 1):
        monkeypatch.setattr(simhash, "TWO_BLOCKS_FROM", first)
        got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(clashing(frame(spark, rows))).collect()}
        assert got == {i: (fps[i], expected[i]) for i in fps}


def test_simhash_splits_hot_anchors(spark, monkeypatch):
    """Fingerprints that crowd around a few anchors, dealt over grids of parts: the same links as before."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    bits = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for b in base]))
    apart = np.bitwise_count(bits[:, None] ^ bits[None, :])
    a, b = np.nonzero(apart <= simhash.DISTANCE)
    expected = components(bits.tolist(), zip(bits[a].tolist(), bits[b].tolist(), strict=True))
    distinct = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "fp long").repartition(5)
    monkeypatch.setattr(simhash, "_CELLS", 1 << 12)
    for homes, visitors in ((1 << 14, 1 << 18), (8, 20)):
        monkeypatch.setattr(simhash, "_HOMES", homes)
        monkeypatch.setattr(simhash, "_VISITORS", visitors)
        hot = simhash.hot_cells(distinct, len(bits), 1)
        assert (len(hot[0]) > 0) == (homes == 8) and all((x >= 1).all() for x in hot[1:])
        found = C.components(simhash.links(distinct, len(bits))).collect()
        got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in found}
        groups, same = {}, {}
        for x in bits.tolist():
            groups.setdefault(got.get(x, x), set()).add(x)
            same.setdefault(expected[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def test_simhash_edges(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    got = simhash.simhash_components(frame(spark, [(3, "a b c d"), (3, "a b c d"), (None, "a b c d")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 3), (3, 3), (3, 3)]


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    rng = random.Random(1)
    links = chain + star + [(5000, 5000)]
    rng.shuffle(links)
    got = dict(map(tuple, C.components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()))
    assert {v for k, v in got.items() if k <= 200} == {0} and {v for k, v in got.items() if 1000 <= k < 2000} == {1000}


def test_sketch_never_underestimates(spark):
    keys = np.random.default_rng(3).integers(0, 5000, 20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    df = spark.createDataFrame([(int(k) - (1 << 63),) for k in keys.tolist()], "k long").repartition(6)
    of = lambda batch: iter([(batch.column("k").to_numpy() + np.int64(-(2**63))).view(np.uint64)])
    sketch = countmin.repeated(df, of, 20_000, hot=6)
    own, n = np.unique(keys, return_counts=True)
    assert sketch.twice(own[n >= 2]).all() and sketch.hot(own[n >= 6]).all()
    assert sketch.twice(own[n < 2]).mean() < 0.2


def test_answers_never_miss_and_keep_their_load(spark):
    """Keys that stand twice are always found, and few others, at a tenfold corpus as well; an unasked chunk has no rows."""
    rng = np.random.default_rng(5)
    shares = []
    for size in (30_000, 300_000):
        keys = [rng.integers(0, 1 << 64, size, dtype=np.uint64) for _ in range(4)]
        keys[3][: size // 10] = keys[0][: size // 10]
        keys[2][0] = keys[2][1]
        log2 = countmin.open_width(4 * size)
        chunks = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(keys)] + [(9, b"")], "chunk long, packed binary").repartition(3)

        def keys_of(batch):
            for chunk, packed in zip(*[batch.column(x).to_pylist() for x in ("chunk", "packed")], strict=True):
                yield chunk, np.frombuffer(packed, np.uint64)

        found = countmin.answers(chunks, keys_of, log2).toArrow()
        got = [countmin.answered(x, found.filter(pc.equal(found["chunk"], i)), log2) for i, x in enumerate(keys)]
        assert got[0][: size // 10].all() and got[3][: size // 10].all() and got[2][:2].all()
        assert not len(countmin.answered(keys[0][:0], found.slice(0, 0), log2))
        shares.append(float(np.mean(got[1])))
    assert max(shares) < 0.1
    assert countmin.open_width(10**12) > countmin.MAX_LOG2


def test_chunks_hold_every_text_once(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    rows = corpus(seed=4)
    seen = []
    for r in substring_dedup.chunked(frame(spark, rows).select("doc_id", "text")).collect():
        ids = np.frombuffer(r["docs"], np.int64)
        for lo, hi, data, off in substring_dedup.opened(r["texts"], r["sizes"]):
            seen += [(int(i), data[a:b].tobytes()) for i, a, b in zip(ids[lo:hi], off, off[1:], strict=False)]
    assert sorted(seen) == sorted((i, (t or "").encode()) for i, t in rows)


def test_leaders_and_spans():
    grams = np.random.default_rng(4).integers(0, 1 << 63, 200).astype(np.uint64)
    for width in (1, 2, 7, 13):
        assert leaders(grams, width).tolist() == [k + int(np.argmin(grams[k : k + width] >> np.uint64(32))) for k in range(len(grams) - width + 1)]
    r, s, e = merge_spans(np.array([1, 0, 1, 1]), np.array([5, 0, 1, 3]), np.array([9, 2, 4, 5]))
    assert (r.tolist(), s.tolist(), e.tolist()) == ([0, 1], [0, 1], [2, 9])
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
