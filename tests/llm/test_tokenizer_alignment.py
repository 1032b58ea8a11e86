from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cardloom.llm import tokenizer_alignment as alignment

from .helpers import clashing, corpus, frame, sha

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "x", "é", "漢字", "😀", " ", "　", " ", "\x00", "\x1c", "\x85", "×", "'s", "'", "don't", " ", "  ", "\n", "\r\n", "\t", "1", "234", "½", "-", "...", "the", " of", "Zürich", "naïve", "́", "İ", "€"]


class Definition:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}

    def tokens(self, text):
        """[(id, start, end)] of both, or two empty lists."""
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text or "")]
        if not text or any(b"".join(x for _, x in t) != whole for t in (a, b)):
            return [], []
        out = []
        for t in (a, b):
            ends = np.cumsum([len(x) for _, x in t]).tolist()
            out.append([(i, e - len(x), e) for (i, x), e in zip(t, ends, strict=True)])
        return out

    def links(self, a, b):
        return [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]

    def groups(self, a, b):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, lo = [], 0
        for hi in ends:
            parts.append("|".join(",".join(str(i) for i, s, _ in t if lo <= s < hi) for t in (a, b)))
            lo = hi
        return parts


def expected(rows):
    own = Definition()
    got = [(i, *own.tokens(t)) for i, t in rows]
    links = [own.links(a, b) for _, a, b in got]
    count = Counter(p for x in links for p in set(x))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, a, b), x in zip(got, links, strict=True):
        groups = own.groups(a, b)
        out.append((i, len(a), len(b), len(groups), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), sha(";".join(groups)) if groups else ""))
    return out, count


def odd(seed, n):
    rng = random.Random(seed)
    return [(1000 + k, "".join(rng.choices(PARTS, k=rng.randint(0, 14)))) for k in range(n)]


ROWS = [*corpus(21, 24), *odd(2, 250), (2000, "a b c " * 400), (2001, "漢字" * 300), (2001, "again"), (2002, "   leading"), (2003, " "), (None, "no id")]


def test_units_are_encoded_as_the_whole_text():
    own, encoders = Definition(), alignment._encoders(A, B)
    for _, text in odd(5, 3000):
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        starts, _ = alignment.units(raw, np.array([0, len(raw)]))
        parts = [raw[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
        assert [i for x in encoders[0].encode(parts) for i in x] == own.a.encode(" " + text, add_special_tokens=False).ids, ascii(text)
        if text:
            assert [i for x in encoders[1].encode(parts) for i in x] == own.b.encode(text), ascii(text)


def test_documents_and_pairs_against_the_definition(spark):
    documents, pairs = alignment.align(clashing(frame(spark, ROWS)), A, B)
    want, count = expected(ROWS)
    assert sorted(map(tuple, documents.collect()), key=str) == sorted(want, key=str)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    assert any(n == 0 for _, n, *_ in want) and any(t and "▁" in t for _, t in ROWS)


def test_groups_as_text(spark):
    rows = [(1, "tokenizers disagree"), (2, None), (3, "x▁y"), (4, "don't  stop\n")]
    own = Definition()
    got = {r["doc_id"]: r["groups"] for r in alignment.token_groups(frame(spark, rows), A, B).collect()}
    assert got == {i: ";".join(own.groups(*own.tokens(t))) for i, t in rows} and got[2] == got[3] == "" and got[1]


def test_query_and_empty_tables(spark, tmp_path):
    frame(spark, ROWS[:30]).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, alignment.op12_tokenizer_alignment(spark, str(tmp_path)).collect()), key=str) == sorted(expected(ROWS[:30])[0], key=str)
    documents, pairs = alignment.align(frame(spark, []), A, B)
    assert documents.count() == pairs.count() == 0
    documents, _ = alignment.align(frame(spark, [(1, None), (2, "")]), A, B)
    assert sorted(map(tuple, documents.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_of_any_size_add_up(spark, monkeypatch):
    """Documents fall into chunks by their place; counts are the corpus's all the same."""
    rows = [(k, "the same words in every text and one of its own: " + "x" * k) for k in range(60)]
    want = sorted(expected(rows)[0])
    for parts in (1, 7):
        assert sorted(map(tuple, alignment.align(frame(spark, rows, parts), A, B)[0].collect())) == want
