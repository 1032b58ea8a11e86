"""Language-model scoring with a weighted backoff automaton.

Model: n-grams of all training documents, smoothed towards the next lower order,
P(w|h) = (c(hw) + MU * P(w|h')) / (c(h) + MU), ending at P(w) = (c(w) + 1) / (N + V + 1).
As an automaton: every history seen in training is a state; a seen n-gram is an arc that
carries log10 P(w|h) and leads to the longest known history that ends in w; any other word takes the state's
failure arc, weight log10(MU / (c(h) + MU)), to the state of the shorter history and is tried again there.
A text is scored in one pass from left to right that carries the state.  Texts are cut into segments that
advance side by side, a word of each at a time; as a state depends on the last words only, a segment
finds its first state by reading the order - 1 words before it.

The whole automaton grows with the corpus and is never held by one process.  Documents
are gathered into chunks (written to the shared folder).  A chunk sends the distinct
n-grams it holds, with its training counts, to buckets of the key space; a bucket adds
up the counts and answers every chunk in the order of its request; and the chunk builds
from the answers just the slice of the automaton that its own texts can reach.  Frequent
n-grams are thus one entry a chunk, wherever they occur.

Words are told apart by their bytes inside a chunk and by 128-bit digests between chunks, longer n-grams by 64-bit hashes of digests.

Defined cases: null or empty text is the end token alone; a null doc_id hashes as the empty
string (a training document); with no training documents N = V = 0; rows that repeat are counted
and scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import BUCKET_BYTES, bounded_batches, lean, stored, text_bytes
from .textview import column, factorized, keyed, mix, pairs, ranges, words

ORDER = 2
MU = 8.0
MODULUS, HELD_OUT = 7, 2
#: Text bytes whose slice of the automaton a task holds at once.
CHUNK_BYTES = 8 << 20
#: Words of a text that are read one after the other; longer texts are read in several segments at once.
SEGMENT = 192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT


def chunks(docs: DataFrame, limit: int) -> DataFrame:
    """Rows (chunk, ids, held, sizes, text): runs of documents of some `limit` bytes; ids null stay null."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            flags, sizes, text = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            packed = zstandard.compress(text.tobytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | at]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (flags.tobytes(), sizes.tobytes(), packed))], names=["chunk", "ids", "held", "sizes", "text"])

        for batch in batches:
            data, off = column(batch, "text")
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit - size, side="right")) - 1))
                own = batch.slice(lo, hi - lo)
                held.append((own.column("doc_id"), own.column("held").to_numpy(zero_copy_only=False), np.diff(off[lo : hi + 1]), data[off[lo] : off[hi]]))
                size += int(off[hi] - off[lo])
                lo = hi
                if size >= limit or lo < batch.num_rows:
                    yield close()
                    at, held, size = at + 1, [], 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held"))
    return rows.mapInArrow(lean(gather), "chunk long, ids array<long>, held binary, sizes binary, text binary")


def _tokens(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's index among the chunk's distinct words, an end token (the last of them) after each text; the words' digests; and the documents' token offsets."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, bounds = words(data, np.concatenate(([0], np.cumsum(sizes))))
    which, digests = keyed(data, starts, ends)
    bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) + 1)))
    out = np.full(int(bounds[-1]), len(digests), np.int32)
    out[np.delete(np.arange(len(out)), bounds[1:] - 1)] = which
    return out, np.concatenate((digests, [[_END, _END]])).astype(np.uint64), bounds


def _grams(tokens: np.ndarray, digests: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of order 2 to `order` that end at each token; the start mark precedes each text, shorter histories repeat the order below."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys, before, own = [], digests[tokens, 0], digests[tokens, 1]
    for k in range(2, order + 1):
        last = np.empty_like(before)
        last[1:] = before[:-1]
        last[place == 0] = _START
        key = mix(last * np.uint64(0x9FB21C651E98DF25) + mix(own ^ np.uint64(0xD6E8FEB86659FD93 + k)))
        if k > 2:
            key = np.where(place < k - 2, before, key)
        keys.append(key)
        before = key
    return keys


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # grows with the key


def _planes(values: np.ndarray) -> bytes:
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def _unplanes(packed: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _distinct(row: dict, order: int):
    """Token offsets, the distinct words' second digests, and per order (distinct sorted keys, each token's index, training counts)."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    tokens, digests, bounds = _tokens(zstandard.decompress(row["text"]), sizes)
    train = np.repeat(~np.frombuffer(row["held"], bool), np.diff(bounds))
    by = np.lexsort((digests[:, 1], digests[:, 0]))
    named = [(digests[by, 0], by, tokens)]
    for keys in _grams(tokens, digests, bounds, order):
        first, which = factorized(keys)
        by = np.argsort(keys[first])
        named.append((keys[first[by]], by, which))
    out = []
    for keys, by, which in named:
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        at = rank[which]
        out.append((keys, at, np.bincount(at[train], minlength=len(by)).astype("<u4")))
    return bounds, digests[named[0][1], 1], out


class Automaton:
    """The slice of the model that one chunk's texts can reach: states, their failure arcs, and arcs by (state, word).

    State 0 is the empty history and state 1 the beginning of a text.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, starts: float, total: int, kinds: int):
        """grams: for each order the n-grams' training counts and each token's n-gram; starts: training texts."""
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
        self.words = grams[0][1]
        self.kinds = len(grams[0][0])
        order = len(grams)
        self.root = np.log10((grams[0][0] + 1.0) / (total + kinds + 1.0))  # arcs of state 0, by word
        state_of, counts, fails, arcs = [], [np.zeros(1), np.full(1, starts)], [np.zeros(2, np.int64)], []
        n, weight = 2, self.root
        for k, (count, at) in enumerate(grams, 1):
            real = np.flatnonzero(place >= k - 2)  # nearer to its text's beginning a token has no n-gram of this order
            seen = np.full(len(count), -1, np.int64)
            seen[at[real]] = real  # a token that ends this n-gram
            own = np.flatnonzero((seen >= 0) & (count > 0))
            end = seen[own]
            if k > 1:
                history = np.where(place[end] == 0, 1, state_of[-1][grams[k - 2][1][end - 1]])
                lower = weight[grams[k - 2][1][end]]
                weight = np.zeros(len(count))
                weight[own] = np.log10((count[own] + MU * 10.0**lower) / (np.concatenate(counts)[history] + MU))
            state = np.full(len(count), 0 if k == 1 else -1, np.int64)
            if k < order:
                state[own] = n + np.arange(len(own))
                n += len(own)
                counts.append(count[own].astype(float))
                fails.append(np.zeros(len(own), np.int64) if k == 1 else state_of[-1][grams[k - 2][1][end]])
            elif k > 1:
                state[own] = state_of[-1][grams[k - 2][1][end]]
            if k > 1:
                arcs.append((history * self.kinds + self.words[end], weight[own], state[own]))
            state_of.append(state)
        self.root_to = state_of[0] if order > 1 else np.zeros(self.kinds, np.int64)
        self.fail = np.concatenate(fails)
        self.fail_weight = np.log10(MU / (np.concatenate(counts) + MU))
        keys, weights, to = (np.concatenate(x) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        by = np.argsort(keys)
        self.keys, self.weights, self.to = keys[by], weights[by], to[by]
        self.bounds, self.back = bounds, order - 1

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word after its state, failure arcs included, and the states it leads to."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_, state = np.arange(len(state)), state.copy()
        while len(open_):
            at_root = state == 0
            done = open_[at_root]
            weight[done] += self.root[word[done]]
            after[done] = self.root_to[word[done]]
            open_, state = open_[~at_root], state[~at_root]
            if not len(open_):
                break
            want = state * self.kinds + word[open_]  # state is a 64-bit number
            at = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
            found = self.keys[at] == want if len(self.keys) else np.zeros(len(want), bool)
            weight[open_[found]] += self.weights[at[found]]
            after[open_[found]] = self.to[at[found]]
            open_, state = open_[~found], state[~found]
            weight[open_] += self.fail_weight[state]
            state = self.fail[state]
        return weight, after

    def score(self) -> np.ndarray:
        """log10 probability of each token, by one pass over the texts' segments."""
        n = -(-np.diff(self.bounds) // SEGMENT)
        text = np.repeat(np.arange(len(n)), n)
        first = self.bounds[text] + ranges(np.zeros(len(n), np.int64), n) * SEGMENT
        last = np.minimum(first + SEGMENT, self.bounds[text + 1])
        begin = np.maximum(first - self.back, self.bounds[text])
        state = np.where(begin == self.bounds[text], 1 if self.back else 0, 0)
        by = np.argsort(begin - last, kind="stable")  # the longest first: those that still run are the first few
        first, last, begin, state = first[by], last[by], begin[by], state[by]
        out = np.zeros(self.bounds[-1])
        for k in range(int((last - begin).max(initial=0))):
            run = int(np.searchsorted(begin - last, -k, side="left"))
            at = begin[:run] + k
            weight, state[:run] = self.step(state[:run], self.words[at])
            own = at >= first[:run]
            out[at[own]] = weight[own]
        return out


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document."""
    bounded_batches(docs.sparkSession)
    buckets = int(max(64, text_bytes(docs) // BUCKET_BYTES))
    gathered = stored(chunks(docs, CHUNK_BYTES), "lm-chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, checks, grams = _distinct(row, order)
                for k, (keys, _, counts) in enumerate(grams):
                    at = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(at)).tolist():
                        own = slice(at[b], at[b + 1])
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["chunk"]]), pa.array([k], pa.int32()), pa.array([_planes(np.diff(keys[own], prepend=np.uint64(0)))], pa.binary()), pa.array([_planes(counts[own])], pa.binary()), pa.array([None if k else checks[own].tobytes()], pa.binary())], names=["bucket", "chunk", "k", "keys", "counts", "checks"])

    def answer(table: pa.Table) -> pa.Table:
        out = []
        asked = table.to_pylist()
        for k in range(order):
            rows = [r for r in asked if r["k"] == k]
            if not rows:
                continue
            keys = [np.cumsum(_unplanes(r["keys"], "<u8"), dtype=np.uint64) for r in rows]
            if k:
                own, at = np.unique(np.concatenate(keys), return_inverse=True)
                n = len(own)
            else:  # words are told apart by both digests
                first, at = pairs(np.concatenate(keys), np.concatenate([np.frombuffer(r["checks"], "<u8") for r in rows]))
                n = len(first)
            total = np.bincount(at, weights=np.concatenate([_unplanes(r["counts"], "<u4") for r in rows]), minlength=n)
            cut = np.cumsum([0, *map(len, keys)])
            for i, r in enumerate(rows):
                out.append({"chunk": r["chunk"], "k": k, "bucket": r["bucket"], "counts": _planes(total[at[cut[i] : cut[i + 1]]].astype("<u8")), "tokens": int(total.sum()) if k == 0 and i == 0 else 0, "kinds": int((total > 0).sum()) if k == 0 and i == 0 else 0})
        return pa.Table.from_pylist(out, schema=_answers)

    _answers = pa.schema([("chunk", pa.int64()), ("k", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])
    asked = gathered.mapInArrow(lean(ask), "bucket int, chunk long, k int, keys binary, counts binary, checks binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(lean(answer), "chunk long, k int, bucket int, counts binary, tokens long, kinds long"), "lm-answers")
    sums = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    total, kinds = sums["tokens"], sums["kinds"]

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(right.to_pylist(), key=lambda r: (r["k"], r["bucket"]))
        counts = [np.concatenate([_unplanes(r["counts"], "<u8") for r in got if r["k"] == k]).astype(np.int64) for k in range(order)]
        out = []
        for row in left.to_pylist():
            bounds, _, grams = _distinct(row, order)
            starts = float(counts[0][grams[0][1][bounds[1] - 1]])  # as many texts began as ended
            model = Automaton([(c, at) for c, (_, at, _) in zip(counts, grams, strict=True)], bounds, starts, total, kinds)
            base, full, known = model.root[grams[0][1]], model.score(), (counts[0] > 0)[grams[0][1]]
            sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, full, known.astype(np.int64))]
            n = len(bounds) - 1
            out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(np.frombuffer(row["held"], bool)), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(sums[2]), "train_tokens": pa.array(np.full(n, total)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])}))
        return pa.concat_tables(out)

    return gathered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(walk), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
