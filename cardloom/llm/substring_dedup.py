"""Substring dedup over word windows: count-min prefilter, then exact grouping.

Rule: a word goes when it is covered by a window of `window` consecutive words whose
word sequence also starts earlier (smaller doc_id, or the same document further left).
Windows are judged on the input, not on what is left.

Texts are first packed into chunks of some MB in the shared folder.  Pass one sketches the
corpus, with some 4 to 8 cells a key at any size; no process holds the sketch, each chunk
gets back the answers for its own cells.  Counting every window would make the sketch some
sevenfold larger, so a window is counted by its leading gram (the run of `GRAM` words
of least hash in it): equal windows have equal leading grams at equal places, so a gram's
count is never below that of any window it leads.  Pass two takes only windows whose gram is estimated
repeated, and groups them by 128 bits: two hashes of the words' two independent digests, neither of which is a sum
that regular sequences could cancel.  Each chunk first settles the copies it
holds itself, so a window that stands in a third of all documents reaches the
shuffle once a chunk, and the buckets settle the rest.

Defined cases: null or empty text has no words; a null doc_id sorts last; rows that share a
doc_id are equally early, so neither is removed for the other; extra columns are ignored
(`substring_dedup`) or carried (`without_repeats`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import countmin
from .jobs import BUCKET_BYTES, bounded_batches, lean, row_key, set_aside, stored, text_bytes
from .textview import blocks, cut, inside, keyed, leaders, merge_spans, pairs, runs_at, runs_of, words

WINDOW = 20
GRAM = 8
_LAST = np.iinfo(np.int64).max
#: Windows of a chunk that are settled and emitted together.
_FLUSH = 500_000


def _word_hashes(data: np.ndarray, off: np.ndarray):
    """Two independent 64-bit hashes of each word, each word's row, and the rows' word offsets."""
    starts, ends, bounds = words(data, off)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    which, keys = keyed(data, starts, ends)
    return [keys[which, half] for half in (0, 1)], rows, bounds


def _leading(words_: np.ndarray, rows: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Start words of the valid windows, the hashes of their distinct leading grams in order, and each window's index among these."""
    n = len(rows)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = runs_of(words_, gram)
    place = leaders(grams, window - gram + 1)
    starts = np.flatnonzero(inside(bounds[1:], rows[: len(place)], np.arange(len(place)), window))
    fresh = np.diff(place[starts], prepend=-1) != 0
    return starts, grams[place[starts][fresh]], np.cumsum(fresh) - 1


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


#: Text bytes of a chunk (one longer document stands alone).
CHUNK_BYTES = 8 << 20
_CHUNKS = pa.schema([("chunk", pa.int64()), *[(x, pa.binary()) for x in ("docs", "keys", "sizes", "texts")]])


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of many documents each: chunk, and packed doc_ids, row keys, text sizes and compressed texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            ids, keys, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = (ids.tobytes(), keys.tobytes(), sizes.astype(np.int64).tobytes(), zstandard.compress(data.tobytes(), 3))
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), *[pa.array([x], pa.binary()) for x in whole]], schema=_CHUNKS)

        for batch in batches:
            ids, keys = ids_of(batch), batch.column("row_key").to_numpy()
            for lo, hi, data, off in blocks(batch, limit=CHUNK_BYTES):
                if held and size + len(data) > CHUNK_BYTES:
                    yield packed()
                    n, held, size = n + 1, [], 0
                held.append((ids[lo:hi], keys[lo:hi], np.diff(off), data))
                size += len(data)
        if held:
            yield packed()

    rows = docs.withColumn("row_key", row_key()).mapInArrow(lean(pack), "chunk long, docs binary, keys binary, sizes binary, texts binary")
    return stored(rows, "substring-chunks")


def opened(texts: bytes, sizes: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The blocks of a chunk's texts."""
    off = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64))))
    yield from cut(np.frombuffer(zstandard.decompress(texts), np.uint8), off)


def _chunk_keys(window: int, gram: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for chunk, sizes, texts in zip(*[batch.column(x) for x in ("chunk", "sizes", "texts")], strict=True):
            found = []
            for _, _, data, off in opened(texts.as_py(), sizes.as_py()):
                hashes, rows, bounds = _word_hashes(data, off)
                found.append(_leading(hashes[0], rows, bounds, window, gram)[1])
            yield chunk.as_py(), np.concatenate(found)

    return keys_of


def settle(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the entries that are not earliest of their hash, and of one earliest entry each."""
    order = np.lexsort((start, doc, h2, h1))
    if not len(order):
        return order, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (doc[order] != doc[head]) | (start[order] != start[head])
    # Rows with one doc_id and the earliest place are all kept; each stands for itself.
    return order[later], order[~later]


SPANS = "bucket int, doc_id long, row_key long, spans binary, h1 binary, h2 binary, doc binary, at binary"
_SPANS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), *[(x, pa.binary()) for x in ("spans", "h1", "h2", "doc", "at")]])


def span_rows(doc: np.ndarray, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """One row for each document: its merged spans as int64 pairs."""
    if not len(doc):
        return None
    first, row = pairs(doc, key)
    row, starts, ends = merge_spans(row, starts, ends)
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    packed = np.stack([starts, ends], axis=1)
    at = first[row[cuts]]
    none = [None] * len(cuts)
    spans = [packed[lo:hi].tobytes() for lo, hi in zip(cuts, [*cuts[1:], len(row)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array((key[at] % buckets).astype(np.int32)), pa.array(doc[at]), pa.array(key[at]), pa.array(spans, pa.binary()), *[pa.array(none, pa.binary())] * 4], schema=_SPANS)


def _emit(h1, h2, doc, key, start, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Settle what one task holds: spans of its own copies, and its earliest windows packed by bucket."""
    later, first = settle(h1, h2, doc, start)
    if (spans := span_rows(doc[later], key[later], start[later], start[later] + window, buckets)) is not None:
        yield spans
    bucket = (h1[first] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start[first], doc[first], bucket))
    first, bucket = first[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(first)], strict=True):
        own = first[lo:hi]
        rows, at = pairs(doc[own], key[own])
        table = np.stack([doc[own[rows]], key[own[rows]]])
        place = np.stack([np.diff(at, prepend=0), np.diff(start[own], prepend=0)]).astype(np.int32)  # small steps, which the shuffle compresses well
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[lo])], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), *[pa.array([x.tobytes()], pa.binary()) for x in (h1[own], h2[own], table, place)]], schema=_SPANS)


def _unpack(table: pa.Table):
    parts = [[], [], [], [], []]
    for a, b, docs, place in zip(*[table.column(x).to_pylist() for x in ("h1", "h2", "doc", "at")], strict=True):
        if a is None:
            continue
        docs = np.frombuffer(docs, np.int64).reshape(2, -1)
        row, start = np.cumsum(np.frombuffer(place, np.int32).reshape(2, -1), axis=1, dtype=np.int64)
        for x, y in zip(parts, (np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), docs[0][row], docs[1][row], start), strict=True):
            x.append(y)
    return [np.concatenate(x) for x in parts] if parts[0] else None


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, spans): for each document with copies the runs of words that go, as packed int64 pairs."""
    docs = docs.select("doc_id", "text")
    bounded_batches(docs.sparkSession)
    size = text_bytes(docs)
    log2 = countmin.open_width(size // 40)
    chunks = chunked(docs)
    answers = countmin.answers(chunks, _chunk_keys(window, gram), log2)
    buckets = max(64, size * 2 // BUCKET_BYTES // 5)

    def candidates(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        out = [_SPANS.empty_table()]
        for texts, sizes, docs, keys in zip(*[chunk.column(x).to_pylist() for x in ("texts", "sizes", "docs", "keys")], strict=True):
            ids, keys = np.frombuffer(docs, np.int64), np.frombuffer(keys, np.int64)
            held, leads = [], []
            for lo, hi, data, off in opened(texts, sizes):
                hashes, rows, bounds = _word_hashes(data, off)
                starts, lead, which = _leading(hashes[0], rows, bounds, window, gram)
                held.append((lo, hi, hashes, rows, bounds, starts, which))
                leads.append(lead)
            twice = np.split(countmin.answered(np.concatenate(leads), answer, log2), np.cumsum([len(x) for x in leads])[:-1])
            held.reverse()  # popped in order, so a block's arrays go when it is done
            found, n = [], 0
            for again in twice:
                lo, hi, hashes, rows, bounds, starts, which = held.pop()
                starts = starts[again[which]]
                row = rows[starts]
                found.append((*[runs_at(h, starts, window) for h in hashes], ids[lo:hi][row], keys[lo:hi][row], starts - bounds[row]))
                n += len(starts)
                if n and (n >= _FLUSH or not held):
                    out.extend(pa.Table.from_batches([x]) for x in _emit(*map(np.concatenate, zip(*found, strict=True)), window, buckets))
                    found, n = [], 0
        return pa.concat_tables(out)

    def group(table: pa.Table) -> pa.Table:
        out = [table.select(["doc_id", "row_key", "spans"]).filter(table.column("spans").is_valid())]
        if (entries := _unpack(table)) is not None:
            h1, h2, doc, key, start = entries
            later, _ = settle(h1, h2, doc, start)
            if (spans := span_rows(doc[later], key[later], start[later], start[later] + window, buckets)) is not None:
                out.append(pa.Table.from_batches([spans]).select(["doc_id", "row_key", "spans"]))
        return pa.concat_tables(out)

    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(candidates), SPANS)
    return found.groupBy("bucket").applyInArrow(lean(group), "doc_id long, row_key long, spans binary")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with `_text`, the text compressed for the way through the shuffle (null: null), in place of `text`, and `_spans`, the packed spans of each row or null."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([None if t is None else pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, "_text"])

    own = spans.groupBy("doc_id", "row_key").agg(F.collect_list("spans").alias("_spans")).withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    keyed = docs.withColumn("_row", row_key()).withColumn("_own", F.coalesce("doc_id", F.lit(int(_LAST))))
    names = [c for c in keyed.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in names), "_text binary"])
    keyed = keyed.mapInArrow(lean(shrink), schema)
    return keyed.join(own, (F.col("_own") == F.col("_id")) & (F.col("_row") == F.col("_key")), "left").drop("_id", "_key", "_own", "_row")


def unpack_spans(packed: list[bytes] | None) -> np.ndarray:
    """(n, 2) merged and sorted spans."""
    if not packed:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in packed])
    _, starts, ends = merge_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    return np.stack([starts, ends], axis=1)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of `with_spans` as UTF-8; null is empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) if t else b"" for t in batch.column("_text").to_pylist()]


def kept_words(text: bytes, packed: list[bytes] | None) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    own = text.split()
    spans = unpack_spans(packed)
    if not len(spans):
        return len(own), 0, b" ".join(own)
    keep = np.ones(len(own), dtype=bool)
    for lo, hi in spans:
        keep[lo:hi] = False
    return len(own), len(own) - int(keep.sum()), b" ".join(compress(own, keep.tolist()))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t, s) for t, s in zip(texts_of(batch), batch.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    docs = docs.select("doc_id", "text")
    return with_spans(docs, repeated_spans(docs, window)).select("doc_id", "_text", "_spans").mapInArrow(lean(finish), "doc_id long, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of `text`, and `n_chars` (if there) brought up to date.

    A text that loses words is the kept words joined by one space; any other stays as it is.
    """
    docs, restored = set_aside(docs, "doc_id", "text", "n_chars")
    names = docs.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, raw, spans in zip(batch.column("_text").to_pylist(), texts_of(batch), batch.column("_spans").to_pylist(), strict=True):
                texts.append(None if packed is None else (kept_words(raw, spans)[2] if spans else raw).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    spanned = with_spans(docs, repeated_spans(docs, window))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return recounted(spanned.mapInArrow(lean(finish), schema)).selectExpr(*restored)


def recounted(docs: DataFrame) -> DataFrame:
    """`n_chars`, if it is there, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
