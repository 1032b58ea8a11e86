"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at `DISTANCE` or fewer differing bits.  The anchors are the
words of a covering code: on 23 (or twice 23) of the bits the perfect binary Golay code,
covering radius 3 a block, and no demand on the other bits.  A fingerprint's home is its
nearest anchor.  If x and y differ in j bits of a block, y's distance to x's home word is at
most 3 + j (covering radius plus threshold) and at most its own home distance + 2 j.  So y is
replicated to every anchor whose words satisfy both for block distances that sum to
`DISTANCE` at most, and there meets x.  A pair needs to meet once, so y visits only anchors
below its own home.  Homes and visitors are compared anchor by anchor.

Equal fingerprints are one node, so a group of copies costs one fingerprint.  Homes and
visitors are counted first; those of an anchor with many are dealt over a grid of parts, each
of bounded size, in which every home meets every visitor once.  A task turns
the links it finds into spanning stars, so dense groups yield no table of all pairs.

Defined cases: null or empty text has fingerprint zero, linked like any other; a null doc_id counts
in no minimum unless all of a component are null; repeated rows are returned each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spanning
from .jobs import bounded_batches, lean, stored
from .textview import mix, ranges

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Visits of a fingerprint on one and on two blocks, the average of random bits.
_VISITS = {1: 36, 2: 151}
#: Anchors are counted by hash in so many cells: the list of hot cells is bounded at every size.
_CELLS = 1 << 20
#: Homes and visitors of one part, or four times what an average cell has, if that is more.
_HOMES = 1 << 14
_VISITORS = 1 << 18
_BITS = 23
_MASK = (1 << _BITS) - 1
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101
#: From this many distinct fingerprints on two blocks pay: fewer meet at an anchor, though more are sent.
TWO_BLOCKS_FROM = 1_000_000
_PAIRS = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles (A-Z lower-cased, XXH64, repeats counted)."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(size + 1) - 1
    starts, k = ends - size, min(shingle, len(own))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), "<u8", len(own) - k + 1)  # noqa: B905
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        count += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], pa.int64())], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(of), "doc_id long, fp long")


class Golay:
    """Nearest words of the perfect Golay code, and the words that block distances of 0 to 3 can lead to."""

    def __init__(self) -> None:
        self.code = np.zeros(1 << 12, np.uint32)
        for i in range(12):
            self.code ^= np.where(np.arange(1 << 12) >> i & 1, np.uint32(_GENERATOR << i), np.uint32(0)).astype(np.uint32)
        one = np.arange(_BITS)
        low = [np.uint32(0)]
        low += [np.uint32(1 << i) for i in one]
        low += [np.uint32(1 << i | 1 << j) for i in one for j in range(i)]
        low += [np.uint32(1 << i | 1 << j | 1 << k) for i in one for j in range(i) for k in range(j)]
        errors = np.array(low, np.uint32)
        self._leader = np.zeros(1 << 11, np.uint32)
        self._leader[self._syndrome(errors)] = errors
        moves, levels, counts = [], [], []
        for leader in self._leader:
            own = int(np.bitwise_count(leader))
            d = np.bitwise_count(self.code ^ leader).astype(np.int64)
            level = np.where(self.code == 0, 0, np.maximum(d - 3, (d - own + 1) // 2))
            near = np.flatnonzero(level <= DISTANCE)
            near = near[np.argsort(level[near], kind="stable")]
            moves.append(self.code[near])
            levels.append(level[near])
            counts.append(np.searchsorted(level[near], np.arange(DISTANCE + 1), side="right"))
        self.moves, self.levels = np.concatenate(moves), np.concatenate(levels)
        self.counts = np.array(counts)  # moves of level <= l, by syndrome
        self.first = np.cumsum([0, *[len(x) for x in moves[:-1]]])

    def _syndrome(self, word: np.ndarray) -> np.ndarray:
        rest = word.copy()
        for bit in range(_BITS - 1, 10, -1):
            rest ^= np.where(rest >> np.uint32(bit) & np.uint32(1), np.uint32(_GENERATOR << (bit - 11)), np.uint32(0)).astype(np.uint32)
        return rest.astype(np.int64)

    def home(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        syndrome = self._syndrome(word)
        return word ^ self._leader[syndrome], syndrome


_golay: list[Golay] = []


def visits(fp: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint; then (row, anchor) of all its visits, its home included."""
    if not _golay:
        _golay.append(Golay())
    code, bits = _golay[0], fp.view(np.uint64)
    home, syndrome = code.home((bits & np.uint64(_MASK)).astype(np.uint32))
    n = code.counts[syndrome, DISTANCE]
    row = np.repeat(np.arange(len(fp)), n)
    at = ranges(code.first[syndrome], n)
    anchor, own = (home[row] ^ code.moves[at]).astype(np.int64), home.astype(np.int64)
    if blocks == 2:
        home, syndrome = code.home((bits >> np.uint64(_BITS) & np.uint64(_MASK)).astype(np.uint32))
        n = code.counts[syndrome[row], DISTANCE - code.levels[at]]
        before, row, anchor = row, np.repeat(row, n), np.repeat(anchor, n)
        at = ranges(code.first[syndrome[before]], n)
        anchor, own = anchor << _BITS | (home[row] ^ code.moves[at]), own << _BITS | home
    keep = anchor <= own[row]
    return own, row[keep], anchor[keep]


def _cell(anchor: np.ndarray, cells: int) -> np.ndarray:
    return (mix(anchor.astype(np.uint64)) % np.uint64(cells)).astype(np.int64)


def hot_cells(distinct: DataFrame, n: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of anchors with more homes or visitors than a part holds, in order, and the parts of each of the two.

    As a hot cell has four times the average of either, there are at most `_CELLS` / 2 of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visitors = np.zeros(_CELLS, np.int64), np.zeros(_CELLS, np.int64)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for lo in range(0, len(fps), 20_000):
                own, _, anchor = visits(fps[lo : lo + 20_000], blocks)
                homes += np.bincount(_cell(own, _CELLS), minlength=_CELLS)
                visitors += np.bincount(_cell(anchor, _CELLS), minlength=_CELLS)
        cell = np.flatnonzero(visitors)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, homes[cell], visitors[cell])], names=["cell", "homes", "visitors"])

    loads = distinct.mapInArrow(lean(count), "cell long, homes long, visitors long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    most_homes, most_visitors = max(_HOMES, 4 * n // _CELLS), max(_VISITORS, 4 * _VISITS[blocks] * n // _CELLS)
    parts = loads.select("cell", F.ceil(F.col("homes") / most_homes).alias("h"), F.ceil(F.col("visitors") / most_visitors).alias("v"))
    hot = np.array([tuple(r) for r in parts.filter("h > 1 OR v > 1").orderBy("cell").collect()], np.int64).reshape(-1, 3)
    return hot[:, 0], np.maximum(hot[:, 1], 1), np.maximum(hot[:, 2], 1)


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links with the components of all pairs of distinct fingerprints within DISTANCE bits."""
    blocks = 1 if n < TWO_BLOCKS_FROM else 2
    buckets = max(64, n * _VISITS[blocks] // 1_000_000)
    cells, home_parts, visitor_parts = hot_cells(distinct, n, blocks)

    def dealt(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the homes and of the visitors of each anchor."""
        h, v = np.ones(len(anchor), np.int64), np.ones(len(anchor), np.int64)
        if len(cells):
            cell = _cell(anchor, _CELLS)
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            hot = cells[at] == cell
            h[hot], v[hot] = home_parts[at[hot]], visitor_parts[at[hot]]
        return h, v

    def places(anchor: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One number a part of an anchor; should two share it, more is compared and nothing lost."""
        return mix(mix(anchor.astype(np.uint64)) ^ (i << 32 | j).astype(np.uint64))

    def records(place: np.ndarray, value: np.ndarray, is_home: bool) -> Iterator[pa.RecordBatch]:
        bucket = (place % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = order[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[part[0]])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (place[part].view(np.int64), value[part], np.full(b - a, is_home))]], names=["bucket", "place", "fp", "home"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for lo in range(0, len(fps), 20_000):
                fp = fps[lo : lo + 20_000]
                own, row, anchor = visits(fp, blocks)
                for at, value, is_home in ((own, fp, True), (anchor, fp[row], False)):
                    h, v = dealt(at)
                    mine, others = (h, v) if is_home else (v, h)
                    part = (mix(value.view(np.uint64)) % mine.astype(np.uint64)).astype(np.int64)
                    total, done = np.cumsum(others), 0
                    while done < len(at):
                        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, side="right")))
                        copies = others[done:end]
                        k = done + np.repeat(np.arange(end - done), copies)
                        other = ranges(np.zeros(end - done, np.int64), copies)
                        i, j = (part[k], other) if is_home else (other, part[k])
                        yield from records(places(at[k], i, j), value[k], is_home)
                        done = end

    def compare(table: pa.Table) -> pa.Table:
        place, fp, is_home = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("place", np.int64), ("fp", np.int64), ("home", np.bool_)))
        order = np.argsort(place[is_home], kind="stable")
        at, homes = place[is_home][order], fp[is_home][order]
        visitors, to = fp[~is_home], place[~is_home]
        lo, hi = np.searchsorted(at, to), np.searchsorted(at, to, side="right")
        met = np.flatnonzero(hi > lo)
        visitors, lo, n = visitors[met], lo[met], (hi - lo)[met]
        total, out, done = np.cumsum(n), [], 0
        while done < len(n):
            end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, side="right")))
            x, y = np.repeat(visitors[done:end], n[done:end]), homes[ranges(lo[done:end], n[done:end])]
            near = (np.bitwise_count(x ^ y) <= DISTANCE) & (x != y)
            out.append(spanning(x[near], y[near]))
            done = end
        a, b = spanning(*(np.concatenate(v) for v in zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return distinct.mapInArrow(lean(send), "bucket int, place binary, fp binary, home binary").groupBy("bucket").applyInArrow(lean(compare), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links can reach."""
    prints = stored(fingerprints(docs, shingle), "simhash-fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = components(links(distinct.select("fp"), distinct.count()))
    group = distinct.join(near, distinct["fp"] == near["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = group.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = group.join(least, "group").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(ids, prints["fp"] == ids["_fp"], "left").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.col:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")
