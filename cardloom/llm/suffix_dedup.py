"""Substring dedup over bytes with a distributed, sparse enhanced suffix array.

Rule: a byte goes when it is covered by a `length`-byte string that also starts earlier
(smaller doc_id, or the same document further left), judged on the input.

A suffix array over every position of a corpus would have to move each position with its
next hundred bytes.  Here only positions that can matter are moved:

1. Every window of `length` bytes is led by its gram (`GRAM` bytes) of least hash.
   Equal windows have equal leading grams at equal places, so the windows led by one gram
   occurrence, a stretch of 100 to 160 bytes called a context, need comparing only with
   contexts of an equal gram.  A count-min sketch of the leading grams drops contexts whose
   gram stands once in the corpus.
2. Grams with very many occurrences (a common line, a group of copies) lie in contexts that
   run over into whatever stands around.  A second sketch, of whole windows, trims their
   contexts to windows estimated repeated, so they become few and equal.
3. Each task settles equal contexts itself and sends the earliest of each with its bytes to
   the gram's bucket.
4. A bucket settles equal contexts, then sorts the suffixes of those that differ but share
   a gram, takes their common-prefix lengths, and stack-scans the interval tree.  An
   interval of depth >= length is a repeat group holding all its occurrences; it is maximal
   if its occurrences are preceded by different bytes (or by the edge of a context).

Defined cases: null text is empty; texts shorter than `length` keep every byte; null doc_id
sorts last; rows that share a doc_id are equally early; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import countmin
from .jobs import BUCKET_BYTES, bounded_batches, lean, row_key, text_bytes
from .substring_dedup import ids_of, settle, texts_of, unpack_spans, with_spans
from .textview import between, blocks, byte_prefix, leaders, merge_spans, mix, pairs, ranges

LENGTH = 100
GRAM = 40
HOT = 16
_SEEDS = (21, 22)
_FLUSH = 200_000
#: Suffixes sorted together, unless one gram has more.
_SORT = 100_000


def _runs(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Hash sums, and the runs of windows with one leader: first window, windows, leader's place and gram hash."""
    sums = byte_prefix(data, _SEEDS[0])
    n = len(data)
    if n < length:
        return sums, *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    grams = between(sums, at, at + gram)
    place = leaders(grams, length - gram + 1)
    bad = np.zeros(n + 1, dtype=np.int32)
    np.add.at(bad, np.maximum(off[1:] - length + 1, off[:-1]), 1)
    np.add.at(bad, off[1:], -1)
    starts = np.flatnonzero(np.cumsum(bad[: len(place)]) == 0)
    place = place[starts]
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    return sums, starts[cut], np.diff(cut, append=len(starts)), place[cut], grams[place[cut]]


def _gram_keys(length: int, gram: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, off in blocks(batch):
            yield _runs(data, off, length, gram)[4]

    return keys_of


def _window_keys(sketch: countmin.Repeated, length: int, gram: int):
    """Hashes of the windows led by hot grams."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, off in blocks(batch):
            sums, first, count, _, keys = _runs(data, off, length, gram)
            hot = sketch.hot(keys)
            starts = ranges(first[hot], count[hot])
            yield between(sums, starts, starts + length)

    return keys_of


_ROWS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), *[(x, pa.binary()) for x in ("spans", "groups", "doc", "at", "shape", "text")]])
_ROWS_SQL = "bucket int, doc_id long, row_key long, spans binary, groups binary, doc binary, at binary, shape binary, text binary"


def _span_rows(doc, key, starts, ends, group, buckets: int, grouped: bool) -> pa.RecordBatch | None:
    """One row a document: merged spans, or with `grouped` each span with its group hash and flags."""
    if not len(doc):
        return None
    first, row = pairs(doc, key)
    if grouped:
        order = np.argsort(row, kind="stable")
        row, starts, ends, group = row[order], starts[order], ends[order], group[:, order]
    else:
        row, starts, ends = merge_spans(row, starts, ends)
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    bounds = list(zip(cuts, [*cuts[1:], len(row)], strict=True))
    packed, at, none = np.stack([starts, ends], axis=1), first[row[cuts]], pa.array([None] * len(cuts), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array((key[at] % buckets).astype(np.int32)), pa.array(doc[at]), pa.array(key[at]), pa.array([packed[lo:hi].tobytes() for lo, hi in bounds], pa.binary()), pa.array([group[:, lo:hi].tobytes() if grouped else None for lo, hi in bounds], pa.binary()), *[none] * 4], schema=_ROWS)


def _flags(h: np.ndarray, first: bool | np.ndarray, maximal: bool | np.ndarray) -> np.ndarray:
    """(2, n): group hash; bit 0 earliest occurrence, bit 1 maximal."""
    return np.stack([h, np.full(len(h), first, dtype=np.uint64) | (np.full(len(h), maximal, dtype=np.uint64) << np.uint64(1))])


def _send(held: list, buckets: int, grouped: bool) -> Iterator[pa.RecordBatch]:
    """Settle the contexts of one task: spans of its own copies, and the earliest contexts packed by bucket."""
    base = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
    data = np.concatenate([x[0] for x in held])
    at = np.concatenate([x[1] + b for x, b in zip(held, base, strict=True)])
    h1, h2, doc, key, start, size, lead, gram = (np.concatenate([x[i] for x in held]) for i in range(2, 10))
    later, first = settle(h1, h2, doc, start)
    if (rows := _span_rows(doc[later], key[later], start[later], start[later] + size[later], _flags(h1[later], False, True), buckets, grouped)) is not None:
        yield rows
    bucket = (gram[first] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start[first], doc[first], bucket))
    first, bucket = first[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(first)], strict=True):
        own = first[lo:hi]
        rows, row = pairs(doc[own], key[own])
        table = np.stack([doc[own[rows]], key[own[rows]]])
        place = np.stack([np.diff(row, prepend=0), np.diff(start[own], prepend=0)]).astype(np.int32)
        shape = np.stack([size[own], lead[own]]).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[lo])], pa.int32()), *[pa.array([None], pa.int64())] * 2, *[pa.array([None], pa.binary())] * 2, *[pa.array([x.tobytes()], pa.binary()) for x in (table, place, shape)], pa.array([zstandard.compress(data[ranges(at[own], size[own])].tobytes(), 3)], pa.binary())], schema=_ROWS)


def _contexts(table: pa.Table):
    parts: list[list] = [[] for _ in range(6)]
    for docs, place, shape, text in zip(*[table.column(x).to_pylist() for x in ("doc", "at", "shape", "text")], strict=True):
        if docs is None:
            continue
        docs = np.frombuffer(docs, np.int64).reshape(2, -1)
        row, start = np.cumsum(np.frombuffer(place, np.int32).reshape(2, -1), axis=1, dtype=np.int64)
        size, lead = np.frombuffer(shape, np.uint16).reshape(2, -1).astype(np.int64)
        for x, y in zip(parts, (docs[0][row], docs[1][row], start, size, lead, np.frombuffer(zstandard.decompress(text), np.uint8)), strict=True):
            x.append(y)
    return [np.concatenate(x) for x in parts] if parts[0] else None


def suffix_array(data: np.ndarray, pos: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[pos:pos+size] (size <= width), and each one's common prefix with the one before (first: 0)."""
    width = -(-width // 8) * 8
    text = np.zeros((len(pos), width), dtype=np.uint8)
    column = np.arange(width)
    for lo in range(0, len(pos), 20_000):  # bounds the index arrays
        own = slice(lo, lo + 20_000)
        inside = column < size[own, None]
        text[own] = np.where(inside, data[np.minimum(pos[own, None] + column, len(data) - 1)], 0)
    order = np.lexsort((size, *text.view(">u8").astype(np.uint64).T[::-1]))
    text, size = text[order], size[order]
    common = np.zeros(len(order), dtype=np.int64)
    for lo in range(1, len(order), 20_000):
        differ = text[lo : lo + 20_000] != text[lo - 1 : lo - 1 + 20_000][: len(text[lo : lo + 20_000])]
        common[lo : lo + 20_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def interval_tree(common: np.ndarray, least: int, before: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(first, end, depth, left-diverse) of each interval of depth >= least, by one scan with a stack.

    `before` holds the byte to the left of each suffix, -1 if unknown; an unknown byte differs
    from every other.  Each open interval keeps the one left byte it has seen, or None.
    """
    n = len(common)
    stack: list[list] = []  # [depth, first, left byte or None if diverse]
    depths, lefts = common.tolist(), before.tolist()
    for i in range(1, n + 1):
        depth = depths[i] if i < n else 0
        left = lefts[i - 1] if lefts[i - 1] >= 0 else None
        first = i - 1
        carried = left
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            carried = top[2] if top[2] == carried else None
            first = top[1]
            yield first, i, top[0], carried is None
        if depth >= least:
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == carried else None
            else:
                stack.append([depth, first, carried])


def _bucket_spans(entries, length: int, gram: int):
    """doc, key, starts, ends and (2, n) group marks of what one bucket settles."""
    doc, key, start, size, lead, data = entries
    at = np.cumsum(size) - size
    sums = [byte_prefix(data, seed) for seed in _SEEDS]
    h1, h2 = (between(s, at, at + size) ^ mix(lead.astype(np.uint64)) for s in sums)
    grams = between(sums[0], at + lead, at + lead + gram)
    later, first = settle(h1, h2, doc, start)
    found = [(doc[later], key[later], start[later], start[later] + size[later], _flags(h1[later], False, True))]
    found.append((doc[first], key[first], start[first], start[first] + size[first], _flags(h1[first], True, True)))
    one = first[np.unique(np.stack([h1[first], h2[first]]), axis=1, return_index=True)[1]]  # a context each
    _, which, count = np.unique(grams[one], return_inverse=True, return_counts=True)
    one = one[count[which] > 1]
    one = one[np.argsort(grams[one], kind="stable")]
    windows = size[one] - length + 1
    total = np.cumsum(windows)
    fresh = np.flatnonzero(np.concatenate(([True], grams[one[1:]] != grams[one[:-1]]))) if len(one) else []
    slices, lo = [], 0
    for edge in [*fresh[1:], len(one)] if len(one) else []:
        if total[edge - 1] - (total[lo - 1] if lo else 0) >= _SORT or edge == len(one):
            slices.append((lo, edge))
            lo = edge
    for lo, hi in slices:
        own = one[lo:hi]
        n = windows[lo:hi]
        owner = np.repeat(own, n)
        step = ranges(np.zeros(len(own), np.int64), n)
        pos = at[owner] + step
        left = np.where(step > 0, data[np.maximum(pos - 1, 0)].astype(np.int64), -1)
        order, common = suffix_array(data, pos, size[owner] - step, int(size[own].max()))
        owner, begin, pos, left = owner[order], (start[owner] + step)[order], pos[order], left[order]
        rows: list[tuple] = []
        for a, b, depth, diverse in interval_tree(common, length, left):
            head = np.lexsort((begin[a:b], doc[owner[a:b]]))[0] + a
            rows.append((a, b, depth, diverse, head))
        if rows:
            a, b, depth, diverse, head = (np.array(x) for x in zip(*rows, strict=True))
            member = ranges(a, b - a)
            node = np.repeat(np.arange(len(a)), b - a)
            isfirst = (doc[owner[member]] == doc[owner[head[node]]]) & (begin[member] == begin[head[node]])
            name = between(sums[0], pos[a], pos[a] + depth)[node]
            found.append((doc[owner[member]], key[owner[member]], begin[member], begin[member] + depth[node], _flags(name, isfirst, diverse[node])))
    return [np.concatenate(x, axis=-1) for x in zip(*found, strict=True)]


def _found(docs: DataFrame, length: int, gram: int, grouped: bool) -> DataFrame:
    docs = docs.select("doc_id", "text")
    bounded_batches(docs.sparkSession)
    total = text_bytes(docs)
    grams = countmin.repeated(docs, _gram_keys(length, gram), expected=total // 30, hot=HOT)
    common = countmin.repeated(docs, _window_keys(grams, length, gram), expected=total // 60)
    buckets = max(64, 2 * total // BUCKET_BYTES)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, keys = ids_of(batch), batch.column("row_key").to_numpy()
            for lo, hi, data, off in blocks(batch):
                sums, first, count, place, key = _runs(data, off, length, gram)
                again = grams.twice(key)
                first, count, place, key = first[again], count[again], place[again], key[again]
                run = np.repeat(np.arange(len(first)), count)
                at = ranges(first, count)
                hot = grams.hot(key)[run]
                keep = ~hot
                keep[hot] = common.twice(between(sums, at[hot], at[hot] + length))
                run, at = run[keep], at[keep]
                cut = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
                run, windows, at = run[cut], np.diff(cut, append=len(run)), at[cut]
                size, lead = windows + length - 1, place[run] - at
                row = np.searchsorted(off, at, side="right") - 1
                mark = mix(lead.astype(np.uint64))
                h1, h2 = between(sums, at, at + size) ^ mark, between(byte_prefix(data, _SEEDS[1]), at, at + size) ^ mark
                held.append((data, at, h1, h2, ids[lo:hi][row], keys[lo:hi][row], at - off[row], size, lead, key[run]))
                n += len(at)
                if n >= _FLUSH or sum(len(x[0]) for x in held) > 32 << 20:
                    yield from _send(held, buckets, grouped)
                    held, n = [], 0
        if n:
            yield from _send(held, buckets, grouped)

    columns = ["doc_id", "row_key", "spans", "groups"]

    def group(table: pa.Table) -> pa.Table:
        out = [table.select(columns).filter(table.column("spans").is_valid())]
        if (entries := _contexts(table)) is not None:
            doc, key, starts, ends, marks = _bucket_spans(entries, length, gram)
            if not grouped:
                keep = marks[1] & np.uint64(1) == 0
                doc, key, starts, ends, marks = doc[keep], key[keep], starts[keep], ends[keep], marks[:, keep]
            if (rows := _span_rows(doc, key, starts, ends, marks, buckets, grouped)) is not None:
                out.append(pa.Table.from_batches([rows]).select(columns))
        return pa.concat_tables(out)

    return docs.withColumn("row_key", row_key()).mapInArrow(lean(candidates), _ROWS_SQL).groupBy("bucket").applyInArrow(lean(group), "doc_id long, row_key long, spans binary, groups binary")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, spans): the byte spans of each document that go."""
    return _found(docs, length, gram, grouped=False).drop("groups")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(group_id, doc_id, start, size, earliest, maximal): every occurrence of every repeat group found.

    Long repeats appear as overlapping groups of up to length + (length - gram) bytes, nested
    groups as in the interval tree.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, spans, groups in zip(*[batch.column(x).to_pylist() for x in ("doc_id", "spans", "groups")], strict=True):
                spans, marks = np.frombuffer(spans, np.int64).reshape(-1, 2), np.frombuffer(groups, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"group_id": marks[0].view(np.int64), "doc_id": np.full(len(spans), doc), "start": spans[:, 0], "size": spans[:, 1] - spans[:, 0], "earliest": marks[1] & np.uint64(1) == 1, "maximal": marks[1] & np.uint64(2) == 2})

    rows = _found(docs, length, gram, grouped=True).mapInArrow(lean(unpack), "group_id long, doc_id long, start long, size long, earliest boolean, maximal boolean").distinct()
    several = rows.groupBy("group_id", "size").count().filter("count > 1").drop("count")
    return rows.join(several, ["group_id", "size"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, removed (the removed byte spans), kept (the remaining bytes)."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for raw, packed in zip(texts_of(batch), batch.column("_spans").to_pylist(), strict=True):
                at, left = 0, []
                spans = unpack_spans(packed).tolist()
                for lo, hi in spans:
                    left.append(raw[at:lo])
                    at = hi
                left.append(raw[at:])
                sizes.append(len(raw))
                removed.append([{"start": lo, "end": hi} for lo, hi in spans])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    docs = docs.select("doc_id", "text")
    return with_spans(docs, repeated_bytes(docs, length)).select("doc_id", "_text", "_spans").mapInArrow(lean(finish), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
