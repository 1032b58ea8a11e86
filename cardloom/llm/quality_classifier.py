"""Quality classifier: a factorisation machine over hashed words, word shapes, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is taken in linear time as
half of |sum_i x_i v_i|^2 - sum_i x_i^2 |v_i|^2.

Features of a text: its lower-cased words and the shapes of its words (runs of letters, capitals and digits reduced to
one sign each, marks kept), hashed to fixed numbers of buckets, log counts brought to length one each; some statistics of its structure
(lengths, shares of capitals, digits, symbols and letters, repeated lines, windows and words) and the table's `n_chars`, each as one of `BINS` bins whose
bounds are quantiles of the sample.  Words are counted over the whole text.  Labels, language, source and doc_id are no features.

Fitting takes at most `SAMPLE` labelled documents, those of the least hash of doc_id among all that may be learnt from: a bounded sample,
gathered at the driver as features and fitted by mini-batches in a fixed order.  Scoring is one pass without a shuffle; the
model is broadcast, its size fixed by the parameters (2.6 MB).

Defined cases: null and empty texts are scored by their structure alone; without labelled rows every score is 0.5, with labels of
one kind only it is their smoothed mean; null labels and labels of no document are not used; rows that repeat or share a doc_id are scored
each (and learnt from each, up to the bound); n_chars null or not there is a bin of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean
from .quality import _LETTER, _SYMBOL, Measures
from .textview import blocks, distinct, words

#: Most labelled documents that a model is fitted on.
SAMPLE = 8192
MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3
WORDS, SHAPES, BINS, RANK = 1 << 16, 1 << 12, 16, 8
#: A bucket seen in fewer sampled documents says nothing.
LEAST_SEEN = 3
EPOCHS, BATCH, RATE, SHRINK = 8, 64, 0.1, 1e-5
#: Block of texts whose features a task holds at once.
BLOCK = 1 << 20
STATISTICS = ("n_chars", "n_words", "word_length", "capitals", "digits", "symbols", "letters", "marks", "lines", "dup_lines", "repeat_words", "distinct_words", "top_word", "longest_word")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def _table(low: int, high: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[low:high] = True
    return out


_CAPITAL, _DIGIT = _table(65, 91), _table(48, 58)
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = ~_LETTER[33:127] & ~_DIGIT[33:127]


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT


def _buckets(spans: pa.Array, size: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 97) % size for s in spans.to_pylist()), np.int64, len(spans))


def _bag(row: np.ndarray, bucket: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of log counts, each row's values of length one."""
    keys = np.sort(row * size + bucket)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    row, bucket = keys[first] // size, keys[first] % size
    value = 1 + np.log(np.diff(first, append=len(keys)))
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    return row, bucket, value / length[row]


def features(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucketed features of a block of texts as row offsets, buckets and values, and the statistics as a matrix; n_chars is NaN where null."""
    n = len(off) - 1
    starts, ends, bounds = words(data, off)
    count = np.diff(bounds)
    row = np.repeat(np.arange(n), count)
    which, spans = distinct(_LOWER[data], starts, ends)
    bags = [_bag(row, _buckets(spans, WORDS)[which], WORDS, n)]
    keys = np.sort(row * max(len(spans), 1) + which)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    kinds, top = np.zeros(n), np.zeros(n)
    np.add.at(kinds, keys[first] // max(len(spans), 1), 1)
    np.maximum.at(top, keys[first] // max(len(spans), 1), np.diff(first, append=len(keys)))
    # Shapes: only the first sign of each run of one kind stays.
    sign = _SHAPE[data]
    stay = np.ones(len(data), dtype=bool)
    stay[1:] = sign[1:] != sign[:-1]
    stay[starts] = True
    before = np.concatenate(([0], np.cumsum(stay)))
    which, spans = distinct(sign[stay], before[starts], before[ends])
    r, b, v = _bag(row, _buckets(spans, SHAPES)[which], SHAPES, n)
    bags.append((r, b + WORDS, v))
    r, b, v = (np.concatenate(x) for x in zip(*bags, strict=True))
    by = np.argsort(r, kind="stable")
    m = Measures(data, off)
    share = lambda table: m.count(table) / size
    size, per = np.maximum(np.diff(off), 1), np.maximum(count, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, row, ends - starts)
    stats = np.stack([n_chars, count, m.word_chars / per, share(_CAPITAL), share(_DIGIT), share(_SYMBOL), share(_LETTER), share(_MARK), m.count(_table(10, 11)) / per, m.dup_lines / per, m.repeat_words / per, kinds / per, top / per, longest], axis=1)
    return np.searchsorted(r[by], np.arange(n + 1)), b[by], v[by], stats


@dataclass
class Model:
    """Weights by feature; the statistics' bins follow the buckets."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray
    cuts: np.ndarray

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature of each statistic: its bin among the sample's quantiles, the last for one that is missing."""
        out = np.empty(stats.shape, np.int64)
        for k in range(stats.shape[1]):
            bin_ = np.searchsorted(self.cuts[k], stats[:, k], side="right")
            out[:, k] = WORDS + SHAPES + k * BINS + np.where(np.isnan(stats[:, k]), BINS - 1, bin_)
        return out

    def whole(self, bounds: np.ndarray, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row offsets, features and values with the statistics' bins among them."""
        n, k = stats.shape
        size = np.diff(bounds) + k
        out = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(np.arange(n), np.diff(bounds)) * k + np.arange(len(buckets))
        bin_at = (out[1:, None] - k + np.arange(k)).ravel()
        f, x = np.empty(int(out[-1]), np.int64), np.empty(int(out[-1]))
        f[at], x[at] = buckets, values
        f[bin_at], x[bin_at] = self.bins(stats).ravel(), k**-0.5
        return out, f, x

    def margins(self, bounds: np.ndarray, f: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each row, and its sum of factors."""
        sums = np.add.reduceat(self.factors[f] * x[:, None], bounds[:-1])
        squares = np.add.reduceat(np.square(self.factors).sum(1)[f] * x * x, bounds[:-1])
        return self.bias + np.add.reduceat(self.weight[f] * x, bounds[:-1]) + (np.square(sums).sum(1) - squares) / 2, sums

    def score(self, bounds: np.ndarray, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.margins(*self.whole(bounds, buckets, values, stats))[0]))


def fitted(bounds: np.ndarray, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray, label: np.ndarray) -> Model:
    """AdaGrad on the log loss over mini-batches in a fixed order."""
    size = WORDS + SHAPES + len(STATISTICS) * BINS
    known = np.where(np.isnan(stats), np.inf, stats)
    cuts = np.quantile(known, np.arange(1, BINS - 1) / (BINS - 1), axis=0, method="lower").T if len(label) else np.zeros((len(STATISTICS), BINS - 2))
    mean = (label.sum() + 1) / (len(label) + 2)
    model = Model(float(np.log(mean / (1 - mean))), np.zeros(size), np.zeros((size, RANK)), cuts)
    if not len(label) or label.min() == label.max():
        return model
    bounds, f, x = model.whole(bounds, buckets, values, stats)
    rng = np.random.default_rng(5)
    seen = np.bincount(f, minlength=size) >= LEAST_SEEN
    model.factors[seen] = rng.normal(0, 0.05, (int(seen.sum()), RANK))
    x = np.where(seen[f], x, 0)
    square_w, square_v, square_b = np.full(size, 1e-8), np.full((size, RANK), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            n = np.diff(bounds)[rows]
            at = np.repeat(bounds[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            g, y = f[at], x[at]
            own, where = np.unique(g, return_inverse=True)
            cut = np.concatenate(([0], np.cumsum(n)))
            margin, sums = model.margins(cut, g, y)
            miss = (1 / (1 + np.exp(-margin)) - label[rows]) / len(rows)
            each = np.repeat(miss, n) * y
            slope = np.bincount(where, weights=each, minlength=len(own)) + SHRINK * model.weight[own]
            part = each[:, None] * (np.repeat(sums, n, axis=0) - model.factors[g] * y[:, None])
            slopes = np.stack([np.bincount(where, weights=part[:, k], minlength=len(own)) for k in range(RANK)], axis=1) + SHRINK * model.factors[own]
            square_w[own] += slope * slope
            square_v[own] += slopes * slopes
            square_b += miss.sum() ** 2
            model.weight[own] -= RATE * slope / np.sqrt(square_w[own])
            model.factors[own] -= RATE / 2 * slopes / np.sqrt(square_v[own])
            model.bias -= RATE * miss.sum() / np.sqrt(square_b)
    model.weight[~seen] = 0
    model.factors[~seen] = 0
    return model


def _measured(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def _n_chars(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels (doc_id, label) over docs, fitted on at most `sample` labelled documents."""
    bounded_batches(docs.sparkSession)
    by = F.xxhash64("doc_id")
    chosen = labels.toDF("doc_id", "label").filter("label IS NOT NULL AND doc_id IS NOT NULL").orderBy(by, "doc_id", "label").limit(sample)
    own = _measured(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` narrow rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch, limit=BLOCK):
                part = batch.slice(lo, hi - lo)
                bounds, buckets, values, stats = features(data, off, _n_chars(part))
                cut = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.float64()), pa.ListArray.from_arrays(cut, pa.array(buckets, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(values)), pa.array(stats.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "buckets", "values", "stats"])

    found = own.mapInArrow(lean(measure), "doc_id long, label double, buckets array<int>, values array<double>, stats array<double>")
    # Rows that share a doc_id could be many more than the labels: the bound holds for them, too.
    rows = found.orderBy(by, "doc_id", "label", F.xxhash64("buckets", "values")).limit(sample).toArrow().combine_chunks()
    size = rows["buckets"].combine_chunks().value_lengths().to_numpy() if len(rows) else np.zeros(0, np.int64)
    flat = [rows[c].combine_chunks().flatten().to_numpy() if len(rows) else np.zeros(0) for c in ("buckets", "values", "stats")]
    return fitted(np.concatenate(([0], np.cumsum(size))).astype(np.int64), flat[0].astype(np.int64), flat[1], flat[2].reshape(-1, len(STATISTICS)), rows["label"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row a document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in blocks(batch, limit=BLOCK):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(*features(data, off, _n_chars(part))))], names=["doc_id", "score"])

    return _measured(docs).mapInArrow(lean(judge), "doc_id long, score double")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = train(docs, labels.select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
