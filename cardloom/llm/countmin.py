"""Count-min sketches built by partitions and merged by blocks of cells.

`answers` widens the sketch with the corpus: the merged blocks stay where they are and each chunk
of texts gets back one bit for every cell that it touched.  `repeated` broadcasts the merged
sketch as bitmaps, so its width has a bound.

A merged cell counts every key that falls into it, so the smallest of a key's cells
never lies below the key's true count.  Only two questions are asked of the sketch
(is the count at least 2, at least `hot`), so the driver receives one bit a cell for the
first, at most depth * 2**MAX_LOG2 / 8 bytes whatever the corpus, and one bit for every
`_FOLD` cells for the second.  Beyond the
load for which that is roomy, more keys are estimated repeated and the exact pass that
follows takes more rows; none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .jobs import lean
from .textview import mix

DEPTH = 2
MIN_LOG2, MAX_LOG2 = 20, 28
_BLOCK_LOG2 = 19
#: Neighbouring cells that share a "hot" bit.
_FOLD = 16
#: Cells held by a task before it emits its partial sketch.
_FLUSH = 3_000_000
_SALTS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def width_for(keys: int) -> int:
    """log2 of the cells of a row: 4 to 8 for each expected key, within the bounds."""
    return max(MIN_LOG2, min(MAX_LOG2, int(np.ceil(np.log2(max(keys, 1) * 4)))))


def open_width(keys: int) -> int:
    """As `width_for`, without the upper bound."""
    return max(MIN_LOG2, int(np.ceil(np.log2(max(keys, 1) * 4))))


def cells(keys: np.ndarray, row: int, log2: int) -> np.ndarray:
    return (mix(keys ^ _SALTS[row]) >> np.uint64(64 - log2)).astype(np.int64)


def _planes(cell: np.ndarray) -> bytes:
    """Steps of sorted cells, low bytes of all first: the shuffle's compression then keeps little more than a byte each."""
    return np.diff(cell, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _cells(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _partial(keys: np.ndarray, log2: int) -> Iterator[pa.RecordBatch]:
    """Sparse partial sketch of the keys: for each row and block the touched cells and their counts (at most 255)."""
    names, parts, cell_bytes, count_bytes = [], [], [], []
    for row in range(DEPTH):
        cell, count = np.unique(cells(keys, row, log2), return_counts=True)
        block = cell >> _BLOCK_LOG2
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(cell)], strict=True):
            names.append(row)
            parts.append(int(block[lo]))
            cell_bytes.append(_planes(cell[lo:hi] & ((1 << _BLOCK_LOG2) - 1)))
            count_bytes.append(np.minimum(count[lo:hi], 255).astype(np.uint8).tobytes())
    if names:
        yield pa.RecordBatch.from_pydict({"row": pa.array(names, pa.int32()), "block": pa.array(parts, pa.int32()), "cells": pa.array(cell_bytes, pa.binary()), "counts": pa.array(count_bytes, pa.binary())})


@dataclass
class Repeated:
    """The merged sketch's answers; `twice` and `hot` are vectorised membership tests."""

    log2: int
    bits: Broadcast

    def _test(self, keys: np.ndarray, level: int) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for row in range(DEPTH):
            at = cells(keys, row, self.log2) // (1, _FOLD)[level]
            found &= (np.frombuffer(self.bits.value[level][row], np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def twice(self, keys: np.ndarray) -> np.ndarray:
        return self._test(keys, 0)

    def hot(self, keys: np.ndarray) -> np.ndarray:
        return self._test(keys, 1)


def repeated(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int, hot: int = 16) -> Repeated:
    """Sketch the keys that `keys_of` takes from each batch of documents."""
    log2 = width_for(expected)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= _FLUSH:
                    yield from _partial(np.concatenate(held), log2)
                    held, n = [], 0
        if n:
            yield from _partial(np.concatenate(held), log2)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << _BLOCK_LOG2, dtype=np.int64)
        for at, count in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total[_cells(at)] += np.frombuffer(count, np.uint8)  # a partial sketch names a cell once
        bits = [np.packbits(x, bitorder="little").tobytes() for x in (total >= 2, (total >= hot).reshape(-1, _FOLD).any(axis=1))]
        return pa.table({"row": [key[0].as_py()], "block": [key[1].as_py()], "twice": [bits[0]], "hot": [bits[1]]}, schema=_merged)

    _merged = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("twice", pa.binary()), ("hot", pa.binary())])
    merged = docs.mapInArrow(lean(build), "row int, block int, cells binary, counts binary").groupBy("row", "block").applyInArrow(lean(merge), "row int, block int, twice binary, hot binary")
    bits = [[bytearray((1 << log2) // fold // 8) for _ in range(DEPTH)] for fold in (1, _FOLD)]
    for r in merged.toLocalIterator():
        for level, name in enumerate(("twice", "hot")):
            step = (1 << _BLOCK_LOG2) // (1, _FOLD)[level] // 8
            bits[level][r["row"]][r["block"] * step : (r["block"] + 1) * step] = r[name]
    return Repeated(log2, docs.sparkSession.sparkContext.broadcast([[bytes(x) for x in level] for level in bits]))


_ANSWERS = "chunk long, row int, block int, bits binary"
_ANSWERS_SCHEMA = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])


def _block_log2(log2: int) -> int:
    """log2 of the cells of a block: 64 blocks a row, until a block's counters take 32 MB."""
    return max(18, min(24, log2 - 6))


def answers(chunks: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], log2: int) -> DataFrame:
    """(chunk, row, block, bits): for the sorted distinct cells of each chunk in each block, whether the corpus holds them twice.

    `keys_of` gives (chunk, keys) for each chunk of a batch.
    """
    width = _block_log2(log2)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys in keys_of(batch):
                if not len(keys):
                    continue
                rows, blocks, planes, counts = [], [], [], []
                for row in range(DEPTH):
                    cell, count = np.unique(cells(keys, row, log2), return_counts=True)
                    count = np.minimum(count, 2).astype(np.uint8)
                    block = cell >> width
                    cuts = np.flatnonzero(np.diff(block, prepend=-1))
                    for lo, hi in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                        rows.append(row)
                        blocks.append(int(block[lo]))
                        planes.append(_planes(cell[lo:hi] & ((1 << width) - 1)))
                        counts.append(np.packbits(count[lo:hi] > 1, bitorder="little").tobytes())
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(rows), pa.int64()), "row": pa.array(rows, pa.int32()), "block": pa.array(blocks, pa.int32()), "cells": pa.array(planes, pa.binary()), "several": pa.array(counts, pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, dtype=np.uint8)
        held = [_cells(x) for x in table.column("cells").to_pylist()]
        for at, several in zip(held, table.column("several").to_pylist(), strict=True):
            total[at] = np.minimum(total[at] + 1 + np.unpackbits(np.frombuffer(several, np.uint8), count=len(at), bitorder="little"), 2)
        bits = [np.packbits(total[at] >= 2, bitorder="little").tobytes() for at in held]
        return pa.table([table.column("chunk"), pa.array([key[0].as_py()] * len(held), pa.int32()), pa.array([key[1].as_py()] * len(held), pa.int32()), pa.array(bits, pa.binary())], schema=_ANSWERS_SCHEMA)

    return chunks.mapInArrow(lean(build), "chunk long, row int, block int, cells binary, several binary").groupBy("row", "block").applyInArrow(lean(merge), _ANSWERS)


def answered(keys: np.ndarray, table: pa.Table, log2: int) -> np.ndarray:
    """Whether each key of a chunk is estimated repeated, by the chunk's rows of `answers`."""
    found = np.ones(len(keys), dtype=bool)
    if not len(keys):
        return found
    rows, blocks, bits = (table.column(x).to_pylist() for x in ("row", "block", "bits"))
    of = {(r, b): x for r, b, x in zip(rows, blocks, bits, strict=True)}
    for row in range(DEPTH):
        cell, which = np.unique(cells(keys, row, log2), return_inverse=True)
        block, n = np.unique(cell >> _block_log2(log2), return_counts=True)
        twice = np.concatenate([np.unpackbits(np.frombuffer(of[row, int(b)], np.uint8), count=int(k), bitorder="little") for b, k in zip(block, n, strict=True)])
        found &= twice[which] == 1
    return found
