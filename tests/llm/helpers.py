"""Fixtures and brute-force forms shared by the operator tests."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def clash() -> tuple[str, str]:
    """Two words that polynomial hashes modulo powers of two take for one, whatever their base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def corpus(seed: int = 1, n: int = 40) -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared passages, blanks, empties and one long text."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Läufer", "naïve", "x", "Zürich,", "data.", "spark", "42", "don't", "É", "over", "a-b", "漢字", "😀"]
    say = lambda k: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(k))
    passage = say(60)
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        kind = i % 8
        text = say(rng.randint(0, 90))
        if kind == 1:
            text = f"{text} {passage}\n{say(5)}"
        elif kind == 2 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        elif kind == 3 and rows:
            near = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        elif kind == 4:
            text = rng.choice(["", "  \n\t ", "one", "a b " * 60, "\n".join(["same line here"] * 4 + ["other"])])
        elif kind == 5:
            text = f"  {text}\t\t{say(8)}\r\n{say(8)}  "
        rows.append((i * 3, text))
    rows += [(n * 3, None), (n * 3 + 1, passage * 40)]
    one, other = clash()
    tail = say(19)
    rows += [(n * 3 + 2, f"{one} {tail}"), (n * 3 + 3, f"{other} {tail}"), (n * 3 + 4, f"{one}\n{other}\n{one}"), (n * 3 + 5, " ".join(c + "x" for c in one[:256])), (n * 3 + 6, " ".join(c + "x" for c in other[:256]))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, partitions: int = 3):
    """documents with all their columns."""
    full = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def clashing(df):
    """The frame with more columns, of names that operators use inside."""
    from pyspark.sql import functions as F

    extra = ("row_key", "spans", "fp", "component_id", "part", "n_words", "kept", "pii", "_spans", "held", "bucket", "host", "rule")
    return df.withColumns({c: F.lit("mine") for c in extra if c not in df.columns})


def removed_windows(rows, size, units):
    """Per document the covered flags of units in windows that also start earlier."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        own = units(text)
        gone = [False] * len(own)
        for s in range(len(own) - size + 1):
            w = tuple(own[s : s + size]) if not isinstance(own, bytes) else own[s : s + size]
            if w in seen:
                gone[s : s + size] = [True] * size
            else:
                seen[w] = i
        out[i] = (own, gone)
    return out


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def grams(tokens, order):
    return Counter(tuple(tokens[j : j + k]) for k in range(2, order + 1) for j in range(len(tokens) - k + 1))
