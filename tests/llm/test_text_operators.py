from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardloom.llm import lm_scoring, packing, pii, quality, url_filters
from cardloom.llm import sentencepiece_lattice as lattice

from .helpers import clashing, corpus, frame, lower, words

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_round_trip(spark, length):
    rows = [*corpus(7), (900, "İstanbul STRASSE ß e\u0301a A\u0301 <|endoftext|> x<|startoftext|>y 'S don'T ''s ﬁ ½ ١٢ ΑΣ.Α"), (901, "x" * 9000), (900, "again")]
    tokenizer = Tokenizer.from_file(BPE)
    expected = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    got = packing.pack(clashing(frame(spark, rows)), BPE, length).collect()
    stream, at = [], 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["sequence_id"] * length + r["offset"], len(ids)) == (at, r["length"]) and 0 < r["length"] <= length - r["offset"]
        at += len(ids)
        stream.append((r["doc_id"], r["start"], r["doc_tokens"], ids))
    found, held = Counter(), []
    for doc, start, total, ids in stream:
        assert start == len(held)
        held += ids
        if len(held) == total:
            found[(doc, tuple(held))] += 1
            held = []
    assert found == expected and not held


def test_packing_ids_of_added_tokens_and_marks_against_the_tokenizer():
    tokenizer, source, rng = Tokenizer.from_file(BPE), packing.WordIds(BPE), random.Random(4)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>", "J", "j", "H", "\u030c", "\u0331", "\u0338", "=", "<", "|", "'s", "'RE", "'", "É", "é", "E\u0301", "İ", "Σ", "\u00a0", " ", "\n", "7", "½", "漢", "ab", "Zx", "-"]
    texts = ["x<|endoftext|>y", "J\u030c a", "H\u0331", "<|ENDOFTEXT|> <|EndOfText|>", "", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000))]
    raw = [t.encode() for t in texts]
    ids, sizes = source.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(sizes)
    for text, lo, hi in zip(texts, ends - sizes, ends, strict=True):
        assert ids[lo:hi].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packing_edges(spark):
    assert packing.pack(frame(spark, []), BPE).count() == 0
    got = packing.with_checksums(packing.pack(frame(spark, [(1, None), (None, "")], 1), BPE)).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["doc_tokens"], r["ids_crc32"]) for r in got) == [(0, 1, 1, 2583214201), (1, 1, 1, 2583214201)]


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    good = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 12 <= len(digits(t)) <= 19 and pii.luhn(digits(t)), "phone": lambda t: 9 <= len(digits(t)) <= 15}
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if good[k](m[0])]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_spans_against_regexes():
    rng, anchors = random.Random(9), pii.automaton()
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.+-() 0123456789%é1.@+ 4") for _ in range(rng.randint(0, 45)))
        assert [x for x in pii.spans(text, anchors) if x[0] in pii.BASE] == base_spans(text), text


def test_pii_long_runs_of_digits():
    anchors = pii.automaton()
    assert pii.spans("0" * 5000 + ".0.0.0 " + "9" * 6000 + ".1.1.1", anchors) == [("ip", 0, 5006)]


def test_pii_added_kinds_and_redaction(spark):
    text = "漢 mail a.b@c.org or http://joe:s3cret@host/x; IBAN: DE89 3704 0044 0532 0130 00, SSN 078-05-1120 (noassn 123456789), card 4111 1111 1111 1111 ip 10.0.0.300 10.0.0.3"
    docs = clashing(frame(spark, [(1, text), (2, None), (3, "clean text, 2024-05-06, 12 apples")]))
    got = {r["doc_id"]: [(x["kind"], text[x["start"] : x["end"]]) for x in r["pii"]] for r in pii.find_pii(docs).collect()}
    assert got[2] == got[3] == []
    assert {("email", "a.b@c.org"), ("login", "joe:s3cret"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "078-05-1120"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.3")} <= set(got[1])
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(docs).collect()}
    assert clean[2] == (None, None) and clean[3][0] == "clean text, 2024-05-06, 12 apples"
    assert "4111" not in clean[1][0] and "<EMAIL>" in clean[1][0] and clean[1][1] == len(clean[1][0])
    assert pii.find_pii(frame(spark, [])).count() == 0


def measures(text):
    own, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(words(line))
        seen.add(line)
    windows = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
    covered = {j for k in range(len(own) - 7) if windows[tuple(own[k : k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_measures_and_verdicts(spark):
    junk = " ".join(f"word{k}$$$" for k in range(40))
    rows = [*corpus(11), (700, junk), (701, "# head\n\n" + "| a | b |\n" * 3 + "plain words go on " * 3), (702, "1 2 3 4 5 6 7 8 9 " * 2 + " ".join(map(str, range(100, 140))))]
    got = {r["doc_id"]: r for r in quality.quality(clashing(frame(spark, rows))).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(text)
        assert not (r["base_failed"] and r["kept"])
    assert not got[700]["kept"] and not got[702]["kept"] and not got[700]["base_failed"]


def test_cascade_order_never_changes_the_verdict():
    from itertools import permutations

    texts = [t or "" for _, t in corpus(12)] + ["$$$ " * 30, "9 " * 40, "x" * 600 + " a" * 20]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    m = quality.Measures(data, off)
    verdicts = {tuple(quality.cascade(m, list(p), np.ones(len(texts), bool))) for p in permutations(quality.RULES)}
    assert len(verdicts) == 1 and not all(next(iter(verdicts)))
    every = quality.BASE | quality.RULES
    whole = {tuple(quality.cascade(m, list(p))) for p in permutations(every)}
    assert whole == {tuple(~np.any([rule(m) for rule in every.values()], axis=0))} and any(next(iter(whole)))


def test_cascade_spares_later_rules_the_rejected_documents(monkeypatch):
    texts = ["short"] * 30 + ["a long enough text of plain words " * 6]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    seen = []
    monkeypatch.setitem(quality.RULES, "symbols", lambda m: seen.append(len(m.off) - 1) or np.zeros(len(m.off) - 1, bool))
    quality.cascade(quality.Measures(data, off), ["few_words", "symbols"])
    assert seen == [1]


def test_quality_filter_restores_columns(spark):
    docs = clashing(frame(spark, corpus(11)))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    judged = quality.quality(frame(spark, corpus(11))).filter("kept").select("doc_id", "text")
    assert sorted(map(tuple, kept.select("doc_id", "text").collect())) == sorted(map(tuple, judged.collect()))
    assert quality.quality_filter(frame(spark, [])).count() == 0


def test_url_filters_against_sql(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/70?x#y", "http://xcom/en/", "https://com/en/", "x://example.com/en/6", "http://u@example.net:80/de/8", "http://EXAMPLE.net/de/8a/b", "http://net/de/#/x", "http://a.org/es", "http://é.org/es/ü?/", "http://b.net/de/9://c.com/en/", "//net/de/"]
    rows = [(i, u, "<html>") for i, u in enumerate([*urls, "http://É.COM/en/"])]
    pages = spark.createDataFrame([*rows, rows[4]], "page_id long, url string, rule string")
    got = url_filters.filter_urls(pages, url_filters.RULES).select("page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    key = lambda r: r[0]
    assert sorted(set(map(tuple, got.collect())), key=key) == sorted(con.sql(url_filters.ORACLE_SQL).fetchall(), key=key) and got.count() == len(rows) + 1
    assert url_filters.filter_urls(pages.limit(0), url_filters.RULES).count() == 0


def test_url_digest_collisions_and_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda t: len(t))
    rules = [("a.com/x", "block"), ("b.com/y", "allow"), ("b.com/y", "block"), ("c.com/zz", "allow")]
    url_filters.DigestArray.write(rules, str(tmp_path))
    index = url_filters.DigestArray(str(tmp_path))
    assert [i >= 0 for i in index.find([b"a.com/x", b"b.com/y", b"c.com/x", b"c.com/zz"])] == [True, True, False, True]
    assert bool(index.blocks[index.find([b"b.com/y"])[0]])
    monkeypatch.undo()
    monkeypatch.setattr(url_filters, "MAX_LIST_BYTES", 8)
    pages = spark.createDataFrame([(1, "http://w.b.com/yy"), (2, "http://c.com/z")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, rules).collect()}
    assert got == {1: ("b.com/y", "block"), 2: (None, "allow")}


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_against_definition(spark, order, monkeypatch):
    import math
    import zlib

    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 3000)
    rows = [*corpus(13), (0, "again the"), (800, "The the THE")]
    count = Counter()
    tokens = [(i, [*words(lower(t)), "\0"]) for i, t in rows]
    for i, own in tokens:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count[("\1",)] += 1
            count.update((w,) for w in own)
            marked = ["\1", *own]
            count.update(tuple(marked[j : j + k]) for k in range(2, order + 1) for j in range(len(marked) - k + 1))
    known = {k: v for k, v in count.items() if len(k) == 1 and k != ("\1",)}
    total, kinds = sum(known.values()), len(known)

    def probability(h, w):
        if not h:
            return (count[(w,)] + 1) / (total + kinds + 1)
        return (count[(*h, w)] + lm_scoring.MU * probability(h[1:], w)) / (count[tuple(h)] + lm_scoring.MU)

    expected = Counter()
    for i, own in tokens:
        marked = ["\1", *own]
        base = sum(math.log10((count[(w,)] + 1) / (total + kinds + 1)) for w in own)
        full = sum(math.log10(probability(tuple(marked[max(0, j + 2 - order) : j + 1]), w)) for j, w in enumerate(own))
        expected[(i, zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(count[(w,)] > 0 for w in own), total, round(base, 6), round(full, 6))] += 1
    got = lm_scoring.score(clashing(frame(spark, rows)), order).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == expected
    sums = [sum(probability((h,), w) for (w,) in known) + probability((h,), "unseen") for h in ("the12", "\1", "nowhere")]
    assert sums == pytest.approx([1, 1, 1])


def test_lm_edges(spark):
    assert lm_scoring.score(frame(spark, [])).count() == 0
    got = lm_scoring.score(frame(spark, [(None, None), (1, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 1)]


def test_sentencepiece_against_library(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(lattice, "CHUNK_BYTES", 4000)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    parts = ["a", "the ", "  ", "\n", "\t", "é", "漢", "😀", ".", "'s", "12", "ß", "   x", "+", "THE", "ing", " ", "x" * 70, "Straße ", "\x0b", "((", "ñ", "-b", "\r", ";\r\n", "\x0c", "\0", " );\r"]
    rows = [*corpus(14), *((600 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(120))]
    rows += [(2000, " "), (2001, " a" + " " * 40 + "b"), (2002, "\n"), (2003, "a" * 5000)]
    got = {r["doc_id"]: r for r in lattice.decode(lattice.encode(clashing(frame(spark, rows)), PIECES), PIECES).collect()}
    both = {r["doc_id"]: r for r in lattice.encode(clashing(frame(spark, rows)), PIECES, with_text=True).collect()}
    for i, text in rows:
        assert (both[i]["ids"], both[i]["text"]) == (got[i]["ids"], got[i]["text"])
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == library.encode(text or ""), text
        assert got[i]["text"] == (text or "") and got[i]["n_pieces"] == len(got[i]["ids"]) // 4


def test_sentencepiece_marks_and_long_units_against_the_library(spark):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(8)
    parts = ["▁", " ", "the", "Ing", "é", "ß", "漢", "😀", "12", "-", "\u0301", "ñá", "\r", "xyzzy" * 20, "日本語" * 30]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    for r in lattice.encode(frame(spark, rows), PIECES, with_text=True).collect():
        text = rows[r["doc_id"]][1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text), ascii(text)
        assert r["text"] == text.replace("▁", " ")


def test_sentencepiece_refuses_models_that_it_would_encode_otherwise(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECES, "rb") as file:
        raw = file.read()
    for change in (lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True)):
        m = sentencepiece_model_pb2.ModelProto.FromString(raw)
        change(m)
        (tmp_path / "other.model").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError, match="only"):
            lattice.checked(str(tmp_path / "other.model"))
    lattice.checked(PIECES)


def test_sentencepiece_edges(spark):
    assert lattice.encode(frame(spark, []), PIECES).count() == 0
    got = lattice.encode(frame(spark, [(None, None), (1, "a"), (1, "a")]), PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["n_pieces"]) for r in got) == [(0, 0), (1, 1), (1, 1)]


def test_viterbi_fold_for_unigram_models(spark):
    rng = random.Random(3)
    pieces = {p: rng.uniform(-9, -1) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb", "aabb"]}
    ids = {p: i for i, p in enumerate(pieces)}
    units = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    table = spark.createDataFrame([(p, ids[p], s) for p, s in pieces.items()], "piece string, id int, score double")
    got = lattice.lattice(spark.createDataFrame(list(enumerate(units)), "key long, unit string"), table, kind="unigram").collect()
    names = {i: p for p, i in ids.items()}
    for r in got:
        best = [0.0] + [-1e9] * len(r["unit"])
        for e in range(1, len(best)):
            best[e] = max(best[s] + pieces.get(r["unit"][s:e], -1e9) for s in range(e))
        parts = [names[i] for i in r["ids"]]
        assert "".join(parts) == r["unit"] and sum(pieces[p] for p in parts) == pytest.approx(best[-1])
