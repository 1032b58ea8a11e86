"""Vectorised views over the UTF-8 bytes of an Arrow text column.

Tasks see a batch of documents as one flat byte array plus row offsets, so words,
hashes and windows of many documents are found with a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .jobs import FORGET

#: Documents are taken together up to this many bytes (one longer document stands alone).
BLOCK_BYTES = 2 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
_tables: dict[int, np.ndarray] = {}
FORGET.append(_powers.clear)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and int64 offsets of a string column; null counts as empty."""
    col = batch.column(name)
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most `limit` bytes."""
    if batch.num_rows == 0:
        return
    yield from cut(*column(batch, name), limit)


def cut(data: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows, as `blocks`."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (run of bytes that are not white), and the word offsets of each row."""
    solid = ~white[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = off[:-1][off[:-1] < len(data)]
        first[edge] = solid[edge]
        edge = off[1:][off[1:] > 0] - 1
        last[edge] = solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES // 2)
        have = np.full(size, _BASE_INV if inverse else _BASE, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * BLOCK_BYTES:
            _powers[inverse] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `between` takes the hash of any run of values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(len(values), False), out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of values[start:end]."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums), True)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def byte_prefix(data: np.ndarray, seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
    return prefix(_tables[seed][data])


def leaders(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` consecutive gram hashes the index of the least (leftmost on ties).

    Equal runs choose the same relative index, whatever stands around them.
    """
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def inside(row_ends: np.ndarray, rows: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of `length` at each start ends in its own row."""
    return starts + length <= row_ends[rows]


def merge_spans(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching [start, end) spans of each row, sorted."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    # Running maximum of ends inside a row: shift each row above all positions of the one before.
    shift = (np.cumsum(np.concatenate(([0], (rows[1:] != rows[:-1]).astype(np.int64))))) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift) - shift
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return rows[at], starts[at], np.maximum.reduceat(reach, at)


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first index of each distinct pair (a, b), sorted by a and then b, and each entry's index among them."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def factorized(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first entry of each distinct key, in the order in which they come, and each entry's index among them."""
    which = pa.array(keys).dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)), which


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + step


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, all_words: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Index of each span's bytes among the distinct ones, by comparison of bytes and not of hashes, and these as a binary array in the order in which they come.

    all_words says that the spans are, or together make up, all words of the data, whose bytes are then found without an index for each.
    """
    size = ends - starts
    flat = data[~WHITE[data]] if all_words else np.ascontiguousarray(data[ranges(starts, size)])
    off = np.concatenate(([0], np.cumsum(size)))
    spans = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(flat)]).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary


def keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word among the distinct ones (the spans are all words of the data), and these ones' XXH3 digests as rows of two independent 64-bit halves."""
    which, spans = distinct(data, starts, ends, all_words=True)
    return which, np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, spans.to_pylist())), "<u8").reshape(-1, 2)


def _after(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a pair in order.  The scrambling between the products keeps regular sequences apart, which a polynomial does not."""
    return mix(first * np.uint64(0x9FB21C651E98DF25) + mix(then ^ np.uint64(0x632BE59BD9B4E019)))


def runs_of(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` values, built from runs of powers of two."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, values, 1
    while True:
        if length & size:
            out = power[:n] if out is None else _after(out, power[done : done + n])
            done += size
        if 2 * size > length:
            return out
        power, size = _after(power[:-size], power[size:]), 2 * size


def runs_at(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of `length` values at each start, value by value."""
    out = values[starts]
    for k in range(1, length):
        out = _after(out, values[starts + k])
    return out
