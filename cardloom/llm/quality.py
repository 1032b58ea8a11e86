"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so the order of the rules changes cost and never the
verdict.  Each rule's cost and rejection rate are estimated on a bounded sample of documents (`SAMPLE`
rows, measured inside a task), and rules are ordered by rejections per second.  A block of documents goes through the
rules in that order; once enough of them are rejected the rest are moved together, so later rules touch only the
bytes of documents that are still alive, and what rules share (words, their names) is computed when first asked for.  Words, lines and
windows are compared by their bytes or by names given to distinct ones, never by hashes.

`quality_filter` runs the whole cascade, the base rule's two halves (too few words, too many words in
repeated windows) among its rules.  `quality` reports measures of every document, so it has the base rule's
verdict already and runs the cascade of the further rules over the documents that pass it.

Defined cases: null or empty text has no words and fails the base rule; repeated rows are
judged each; other columns are carried, but `quality` puts its measures in place of columns of their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean, set_aside
from .textview import WHITE, blocks, distinct, factorized, ranges, words

WINDOW = 8  # a power of two
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
#: Documents on which the cascade's order is estimated.
SAMPLE = 512

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_FEED = np.zeros(256, dtype=bool)
_FEED[10] = True
_SOLID = ~WHITE  # bytes that begin a code point of a word
_SOLID[128:192] = False


class Measures:
    """Flat arrays of one block of documents, and the measures that rules ask for."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def only(self, rows: np.ndarray) -> Measures:
        """These rows alone, in a block of their own."""
        size = np.diff(self.off)[rows]
        return Measures(self.data[ranges(self.off[rows], size)], np.concatenate(([0], np.cumsum(size))))

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.off)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[2])

    @cached_property
    def _word_names(self) -> np.ndarray:
        return distinct(self.data, *self._words[:2], all_words=True)[0].astype(np.int64)

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each row that the table marks."""
        total = np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int32)))
        return (total[self.off[1:]] - total[self.off[:-1]]).astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Characters of the row that are not white space."""
        return self.count(_SOLID)

    @cached_property
    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their row."""
        feed = np.flatnonzero(self.data == 10)
        row = np.searchsorted(self.off, feed, side="right") - 1
        some = np.flatnonzero(np.bincount(row, minlength=len(self.off) - 1))  # one line repeats nothing
        if not len(some):
            return np.zeros(len(self.off) - 1, np.int64)
        begin = np.sort(np.concatenate((self.off[:-1][some], feed + 1)), kind="stable")
        end = np.sort(np.concatenate((feed, self.off[1:][some])), kind="stable")
        # A row's k feeds give it k + 1 lines: starts and ends of all rows interleave alike.
        lines = np.repeat(some, np.bincount(row, minlength=len(self.off) - 1)[some] + 1)
        starts = self._words[0]
        worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end, lines = begin[worded], end[worded], lines[worded]
        return self._repeats(lines, distinct(self.data, begin, end)[0])

    def _repeats(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.off) - 1, np.int64)
        if len(rows):
            order = np.lexsort((keys, rows))
            same = (rows[order][1:] == rows[order][:-1]) & (keys[order][1:] == keys[order][:-1])
            np.add.at(out, rows[order][1:][same], 1)
        return out

    @cached_property
    def repeat_words(self) -> np.ndarray:
        """Words covered by WINDOW-word windows that stand twice or more in their row."""
        bounds = self._words[2]
        n = len(self._words[0])
        out = np.zeros(len(self.off) - 1, np.int64)
        if n < WINDOW:
            return out
        rows = np.repeat(np.arange(len(self.n_words)), self.n_words)
        at = np.arange(n - WINDOW + 1)
        at = at[bounds[1:][rows[at]] >= at + WINDOW]
        names, size = self._word_names, 1
        while size < WINDOW:  # runs of twice the words are named by the pair of names of their halves
            names = factorized(names[:-size] * (int(names.max()) + 1) + names[size:])[1].astype(np.int64)
            size *= 2
        keys = names[at]
        order = np.lexsort((keys, rows[at]))
        a, r = keys[order], rows[at][order]
        same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        total = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        return np.diff(total[bounds])


Rule = Callable[[Measures], np.ndarray]

#: The base rule in its two halves: name -> which rows are rejected.
BASE: dict[str, Rule] = {
    "few_words": lambda m: m.n_words < LEAST_WORDS,
    "repeated_windows": lambda m: 100 * m.repeat_words > MOST_REPEATED * m.n_words,
}
#: Rules beyond the base rule.  Lenient: they reject junk, not style.
RULES: dict[str, Rule] = {
    "symbols": lambda m: m.count(_SYMBOL) > m.n_words,
    "long_words": lambda m: m.word_chars > 24 * m.n_words,
    "duplicate_lines": lambda m: 2 * m.dup_lines > m.count(_FEED) + 1,
    "few_letters": lambda m: 4 * m.count(_LETTER) < np.diff(m.off),
}
#: Live documents are moved together once they are at most this share of a block.
COMPACT = 0.8


def cascade(m: Measures, order: list[str], alive: np.ndarray | None = None) -> np.ndarray:
    """Which rows every rule keeps; `alive` are the rows to look at (all)."""
    kept = np.zeros(len(m.off) - 1, dtype=bool)
    rows = np.arange(len(kept)) if alive is None else np.flatnonzero(alive)  # alive, as rows of the whole block
    own = rows if alive is not None else np.arange(len(kept))  # the same as rows of m
    for name in order:
        if not len(rows):
            break
        if len(rows) <= COMPACT * (len(m.off) - 1):
            m, own = m.only(own), np.arange(len(rows))
        keep = ~(BASE | RULES)[name](m)[own]
        rows, own = rows[keep], own[keep]
    kept[rows] = True
    return kept


def rule_order(docs: DataFrame, rules: dict[str, Rule], sample: int = SAMPLE) -> list[str]:
    """Rules by estimated rejections per second on the first documents that a few partitions give (at most `sample`)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in blocks(batch):
                for name, rule in rules.items():
                    began = time.perf_counter()
                    rejected = int(rule(Measures(data, off)).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [name], "rejected": [rejected], "seconds": [time.perf_counter() - began]})

    found = docs.select("text").filter("length(text) > 0").limit(sample).mapInArrow(lean(measure), "rule string, rejected long, seconds double")
    seen = {r["rule"]: (r["rejected"], r["seconds"]) for r in found.groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()}  # a row a rule
    reject, cost = ({name: seen.get(name, (0, 1e-9))[k] for name in rules} for k in (0, 1))
    return sorted(rules, key=lambda name: (-reject[name] / cost[name], cost[name], name))


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality(docs: DataFrame) -> DataFrame:
    """docs with the measures, `base_failed` and `kept`."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*(x.split()[0] for x in _COLUMNS.split(", ")))
    order, names = rule_order(docs, RULES), docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch):
                m = Measures(data, off)
                failed = BASE["few_words"](m) | BASE["repeated_windows"](m)
                own = [m.n_words, m.word_chars, m.count(_SYMBOL), m.dup_lines, m.repeat_words, failed, cascade(m, order, ~failed)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], *map(pa.array, own)], names=[*names, *(x.split()[0] for x in _COLUMNS.split(", "))])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], _COLUMNS])
    return docs.mapInArrow(lean(judge), schema)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the whole cascade keeps, with their own columns."""
    bounded_batches(docs.sparkSession)
    renamed, restored = set_aside(docs, "text")
    order = rule_order(renamed, BASE | RULES)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch):
                yield batch.slice(lo, hi - lo).filter(pa.array(cascade(Measures(data, off), order)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema)
    return renamed.mapInArrow(lean(sift), schema).selectExpr(*restored)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged.drop("text")
