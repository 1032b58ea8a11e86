"""Periodic runs of words by the harmonic grid.

A run is a stretch of consecutive words that repeats with period p (words p apart are identical), holds at least two periods
and `LEAST` words, and cannot be extended on either side; p is its smallest period.  Any stretch of two periods covers two
neighbouring points jp and (j+1)p of the grid of p, so for every p up to half the words and every j the forward and backward
longest common extensions of these two points give the run through them, if there is one.  A document has n/p points for p, n log n in
all.  Points with unequal words extend nowhere and are left out by one comparison; the others are answered in constant time
by range minima over the common prefixes of neighbours in the suffix array of the words (forward) and in that of the reversed words (backward).

Documents are judged one by one; a task takes them in blocks of some bytes that share arrays, a long one alone.  Its
arrays take some 400 bytes a word, more for text that repeats deeply.  Nothing is shuffled.

Defined cases: null or text without words has no runs; documents whose rows repeat or share a doc_id are judged each;
of runs through the same stretch only the one of the smallest period exists; runs with the same length are listed by start, then
period; other columns are carried as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean, set_aside
from .textview import blocks, distinct, factorized, ranges, words

LEAST = 12
BLOCK = 1 << 20
#: Grid points that are compared at once.
POINTS = 2_000_000


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes of s, each suffix's rank, and the common prefix of each with the one before it in the order.

    Prefix doubling that sorts again only what is still tied.  The last value of s must occur once.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.diff(s[order], prepend=s[order[0]] - 1))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    levels, lcp, k = [], np.zeros(n, np.int32), 1
    tied = np.bincount(rank, minlength=n)[rank[order]] > 1
    at = np.flatnonzero(tied)  # places of the order that are still tied
    while len(at):
        levels.append(rank.copy())
        own = order[at]
        key = rank[own].astype(np.int64) * n + rank[own + k]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head = at[np.flatnonzero(new)]
        rank[own] = np.repeat(head, np.diff(np.flatnonzero(new), append=len(at)))
        # Neighbours that part here agree on k values and part within k more.
        split = head[head > levels[-1][order[head]]]
        a, b, length = order[split - 1], order[split], np.full(len(split), k, np.int64)
        for u in range(len(levels) - 2, -1, -1):
            more = levels[u][a + length] == levels[u][b + length]
            length[more] += 1 << u
        lcp[split] = length + (s[a + length] == s[b + length])
        size = np.diff(np.flatnonzero(new), append=len(at))
        at = at[np.repeat(size > 1, size)]
        k *= 2
    return order, rank, lcp


class Extensions:
    """Longest common extensions of pairs of places, by range minima over common prefixes."""

    def __init__(self, s: np.ndarray):
        _, self.rank, lcp = suffix_array(s)
        self.least = [lcp]
        while 2 << (len(self.least) - 1) <= len(lcp):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, which differ."""
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(a), np.int64)
        for u in np.unique(level).tolist():
            own = level == u
            out[own] = np.minimum(self.least[u][lo[own]], self.least[u][hi[own] - (1 << u)])
        return out


def _grid(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, period, number of point pairs) for every period of every row up to half its words, in parts of at most POINTS pairs (or one period)."""
    begin = np.concatenate(([0], np.cumsum(n // 2)))
    for lo in range(0, int(begin[-1]), POINTS):
        at = np.arange(lo, min(lo + POINTS, int(begin[-1])))
        row = np.searchsorted(begin, at, side="right") - 1
        period = at - begin[row] + 1
        count = (n[row] - 1) // period
        total = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + POINTS, side="right")))
            yield row[a:b], period[a:b], count[a:b]
            a = b


def runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of the runs of all rows, by row, start and period; ids number the words of each row."""
    n = np.diff(bounds)
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row, period, count in _grid(n):
        j = ranges(np.zeros(len(row), np.int64), count)
        row, period = np.repeat(row, count), np.repeat(period, count)
        x = bounds[row] + j * period
        same = np.flatnonzero(ids[x] == ids[x + period])
        met.append((row[same], x[same], period[same]))
    empty = np.zeros(0, np.int64)
    row, x, period = (np.concatenate(c) for c in zip(*met, strict=True)) if met else (empty, empty, empty)
    if not len(x):
        return empty, empty, empty, empty
    some = np.unique(row)  # no other row can have a run
    # The rows one after the other, with a value of its own before, between and after them; equal words of different rows differ.
    size = n[some]
    place = bounds[some] - np.concatenate(([0], np.cumsum(size)[:-1])) - np.arange(len(some)) - 1
    kinds = int(ids.max()) + 1
    _, named = factorized(np.repeat(np.arange(len(some)), size) * kinds + ids[ranges(bounds[some], size)])
    s = np.arange(int(size.sum()) + len(some) + 1, dtype=np.int64) + int(named.max(initial=0)) + 1
    s[ranges(np.cumsum(size) - size + np.arange(len(some)) + 1, size)] = named
    own = np.searchsorted(some, row)
    x = x - place[own]
    forward = Extensions(s).of(x, x + period)
    back = len(s) - x
    backward = Extensions(s[::-1].copy()).of(back, back - period)
    start, length = x - backward, forward + backward + period
    good = length >= np.maximum(least, 2 * period)
    row, start, length, period = row[good], (start + place[own])[good] - bounds[row[good]], length[good], period[good]
    by = np.lexsort((period, length, start, row))
    row, start, length, period = row[by], start[by], length[by], period[by]
    first = np.ones(len(by), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    row, start, length, period = row[first], start[first], length[first], period[first]
    by = np.lexsort((period, start, row))
    return row[by], start[by], length[by], period[by]


def periodic(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with `runs` (array of start, length and period in words, by start and period) and `collapsed`: the words, joined by one space, without those that a run repeats."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop("runs", "collapsed")
    renamed, restored = set_aside(kept, "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch, limit=BLOCK):
                starts, ends, bounds = words(data, off)
                ids, _ = distinct(data, starts, ends)
                row, start, length, period = runs(ids.astype(np.int64), bounds, least)
                again = np.zeros(len(starts) + 1, np.int64)
                np.add.at(again, bounds[row] + start + period, 1)
                np.add.at(again, bounds[row] + start + length, -1)
                stay = np.cumsum(again[:-1]) == 0
                size = (ends - starts)[stay]
                text = np.full(int(size.sum()) + len(size), 32, np.uint8)
                closed = np.cumsum(size + 1)
                text[ranges(closed - size - 1, size)] = data[ranges(starts[stay], size)]
                count = np.concatenate(([0], np.cumsum(stay)))[bounds]
                ends_at = np.concatenate(([0], closed))[count]
                raw = text.tobytes()
                collapsed = [raw[a : max(a, b - 1)] for a, b in zip(ends_at[:-1].tolist(), ends_at[1:].tolist(), strict=True)]
                found = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()), found)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, listed, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*part.schema.names, "runs", "collapsed"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema], "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    return renamed.mapInArrow(lean(find), schema).selectExpr(*restored, "runs", "collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """docs in which every tenth, by the CRC-32 of its doc_id, repeats a stretch of its own words to its end."""
    own = docs.withColumns({"_w": F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"), "_h": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))})
    own = own.withColumns({"_n": F.size("_w"), "_g": F.expr("_h div 10")})
    own = own.withColumn("_a", F.expr("IF(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = F.expr("IF(_h % 10 = 0 AND _n > 0, array_join(transform(_w, (w, i) -> IF(i < _a, w, _w[CAST(_a + (i - _a) % _p AS INT)])), ' '), text)")
    return own.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = looped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic(docs).withColumn("_best", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.expr("-_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.expr("-_best.period").alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
