"""Packing by concatenate and cut.

All documents, each closed by an end id, form one stream of ids that is cut every
`length` ids.  Pass one tokenises a partition, notes for each document the ids before it in
the partition, and writes the rows to the shared folder.  A prefix sum over the partition
totals (one number a partition) turns these into places in the whole stream, so pass two
cuts every document alone: a document that crosses a boundary gives a boundary record on
each side.  Only the last sequence is short.

Defined cases: null or empty text is the end id alone; rows that share a doc_id are packed
each on their own; order follows the partitions of the input; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean, stored
from .textview import between, blocks, byte_prefix, distinct, factorized, ranges, words

LENGTH = 2048
END_ID = 1
#: Distinct pieces whose ids a worker remembers before it starts over.
CACHE_WORDS = 800_000


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)  # ASCII, neither letter nor white space
_MARK[33:128] = ~_LETTER[33:128]


def units(data: np.ndarray, off: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the words: the bytes to read them from, start and end bytes, and each row's offsets.

    Pure ASCII words are lower-cased and cut where a letter is followed by a digit or mark.  Any other word stays
    whole and keeps its case, as does one that holds (in any case) an added token, given in lower case.
    """
    starts, ends, _ = words(data, off)
    if not len(starts):
        return data, starts, ends, np.searchsorted(starts, off)
    low = _LOWER[data]
    high = np.concatenate(([0], np.cumsum(data >= 128)))
    whole = high[ends] > high[starts]
    raw = low.tobytes()
    for token in added:
        at = raw.find(token)
        while at >= 0:
            whole[np.searchsorted(starts, at, side="right") - 1] = True
            at = raw.find(token, at + 1)
    kept = ranges(starts[whole], (ends - starts)[whole])
    low[kept] = data[kept]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[starts] = False
    cut[kept] = False
    cut = np.flatnonzero(cut)
    starts, ends = np.sort(np.concatenate((starts, cut)), kind="stable"), np.sort(np.concatenate((ends, cut)), kind="stable")
    return low, starts, ends, np.searchsorted(starts, off)


class WordIds:
    """Ids of the words of many documents, tokenising a distinct piece once.

    For tokenizers that lower-case, drop white space and split letters from everything else
    (as `word_bpe_49k` does), the ids of a text are those of its `units` in turn.  Added tokens are
    matched in the raw text and normal forms depend on case (J with a caron has none, j has), so words
    with either go to the tokenizer as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = tuple(t.content.encode().lower() for t in self._tokenizer.get_added_tokens_decoder().values())
        if any(len(t.split()) != 1 for t in self._added):
            raise ValueError("an added token with white space cannot be found word by word")
        self._clear()

    def _clear(self) -> None:
        """Slots have a piece's bytes and ids; sorted hashes lead to slots, and the bytes decide."""
        self._keys, self._slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._raw, self._at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self._ids, self._bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots for these pieces."""
        raw, got = flat.tobytes(), []
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for lo in range(0, len(texts), 5000):
            got += self._encode(texts[lo : lo + 5000])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        slots = np.arange(len(got), dtype=np.int32) + len(self._bounds) - 1
        self._ids = np.concatenate((self._ids, np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))))
        self._bounds = np.concatenate((self._bounds, self._bounds[-1] + np.cumsum(sizes)))
        self._raw = np.concatenate((self._raw, flat[ranges(starts, ends - starts)]))
        self._at = np.concatenate((self._at, self._at[-1] + np.cumsum(ends - starts)))
        return slots

    def _slots(self, spans: pa.Array) -> np.ndarray:
        """The slot of each of some distinct pieces."""
        off = np.frombuffer(spans.buffers()[1], np.int64)[: len(spans) + 1]
        flat = np.frombuffer(spans.buffers()[2] or b"", np.uint8)
        starts, ends = off[:-1], off[1:]
        keys = between(byte_prefix(flat, 31), starts, ends)
        at = np.minimum(np.searchsorted(self._keys, keys), max(len(self._keys) - 1, 0))
        known = self._keys[at] == keys if len(self._keys) else np.zeros(len(keys), bool)
        slot = np.full(len(keys), -1, np.int32)
        slot[known] = self._slot[at[known]]
        own, size = slot[known], (ends - starts)[known]
        same = np.diff(self._at)[own] == size
        own, size, begin = own[same], size[same], starts[known][same]
        differ = self._raw[ranges(self._at[:-1][own], size)] != flat[ranges(begin, size)]
        same[np.flatnonzero(same)[np.unique(np.repeat(np.arange(len(size)), size)[differ])]] = False
        slot[np.flatnonzero(known)[~same]] = -1  # another piece has this hash
        new = np.flatnonzero(slot < 0)
        slot[new] = self._learn(flat, starts[new], ends[new])
        new = new[~known[new]]
        new = new[factorized(keys[new])[0]]
        new = new[np.argsort(keys[new])]
        place = np.searchsorted(self._keys, keys[new])
        self._keys, self._slot = np.insert(self._keys, place, keys[new]), np.insert(self._slot, place, slot[new])
        return slot

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and each row's id count."""
        data, starts, ends, bounds = units(data, off, self._added)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        which, spans = distinct(data, starts, ends, all_words=True)  # the pieces of all words are all their bytes
        if len(self._bounds) > CACHE_WORDS:
            self._clear()
        slot = self._slots(spans)[which]
        sizes = np.diff(self._bounds)[slot]
        before = np.concatenate(([0], np.cumsum(sizes)))
        return self._ids[ranges(self._bounds[slot], sizes)], np.diff(before[bounds])


_sources: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One source a worker process, so what a task has learnt serves the next."""
    if path not in _sources:
        _sources[path] = WordIds(path)
    return _sources[path]


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before (ids before it in its partition), n_tokens, ids (little-endian uint32, end id included)."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, part, done = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, off in blocks(batch):
                ids, sizes = source.of(data, off)
                out = np.full(len(ids) + hi - lo, end_id, dtype="<u4")
                ends = np.cumsum(sizes + 1)
                out[ranges(ends - sizes - 1, sizes)] = ids
                before = done + ends - sizes - 1
                done += int(ends[-1])
                raw = out.tobytes()
                cut = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int64)), pa.array(before), pa.array(sizes + 1), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "part", "before", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(tokenise), "doc_id long, part long, before long, n_tokens long, ids binary")


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    bounded_batches(docs.sparkSession)
    tokens = stored(token_table(docs, tokenizer, end_id), "packing-tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row a partition
    starts = np.concatenate(([0], np.cumsum([n for _, n in totals])))
    base = dict(zip([p for p, _ in totals], starts.tolist(), strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            at = np.array([base[p] for p in batch.column("part").to_pylist()], dtype=np.int64) + batch.column("before").to_numpy()
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = ranges(first, pieces)
            lo = np.maximum(sequence * length, at[row])
            hi = np.minimum((sequence + 1) * length, (at + n)[row])
            raw, begin = batch.column("ids"), lo - at[row]
            ids = [raw[r].as_buffer()[4 * a : 4 * b].to_pybytes() for r, a, b in zip(row.tolist(), begin.tolist(), (hi - at[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, (begin, hi - lo, n[row], sequence, lo - sequence * length)), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.mapInArrow(lean(cut), PIECES)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return with_checksums(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
