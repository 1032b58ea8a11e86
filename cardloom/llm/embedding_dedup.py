"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are cut in halves with a codebook each (k-means on at most `SAMPLE` vectors); the
product of the codebooks is a grid of cells, and every vector has a home cell.  A vector visits
cells by multi-sequence traversal: each half's codewords in the order of the squared distance from the vector to the plane
between its own codeword and theirs, and cells in the order of the sum of both, which is a lower bound on the distance to
anything at home there.  It stops at the bound that reaches the recall asked for.  Recall 1 is the bound of the threshold
itself: vectors of cosine >= t lie within squared distance 2 - 2 t, so that every link is found, of pairs and small groups as of
large ones.  For less, the links of a probe set among the sample tell the bound that holds so many of them.
The sample also chooses the size of the codebooks, which changes cost only: where the bound excludes few cells the work is
quadratic.  A pair needs to meet once, so a vector visits only cells before its own home.

Met vectors are verified in double precision.  Equal vectors are one node with a
multiplicity.  Cells are split into blocks of homes and of visitors by counts taken
beforehand, so a cell that holds a third of all vectors becomes many tasks' work, and tasks
return link counts and spanning stars, never lists of all pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors link with those of their own length only, each length having its own grid; a null vec_id names no component; repeated rows
count as copies; label and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spanning
from .jobs import lean, stored
from .textview import mix, ranges

COSINE = 0.9
TARGET_RECALL = 1.0
#: Vectors that the codebooks are fitted on, and vectors that tell their cost.
SAMPLE, PROBES = 8192, 256
#: Homes and visitors of a block.
BLOCK = 4096
_ROUNDS = 8


def _unit_rows(bits: np.ndarray, kind: str) -> np.ndarray:
    x = np.ascontiguousarray(bits).view(kind).astype(np.float64)
    # Scaling by the largest component first keeps tiny and huge vectors from under- and overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """One unit vector a row."""
    if not raw:
        return np.zeros((0, 2))
    return _unit_rows(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), kind)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from a fixed start."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(_ROUNDS):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Grid:
    """Home cells and lower bounds of a product of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.gaps = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-12)) for c in self.books]  # wider than true only lowers bounds

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell; for each half the squared distances to the planes between own codeword and each other (0 at home)."""
        at, homes, out = 0, [], []
        for c, gap in zip(self.books, self.gaps, strict=True):
            part = x[:, at : at + c.shape[1]]
            at += c.shape[1]
            d = (part * part).sum(1)[:, None] + (c * c).sum(1) - 2 * part @ c.T
            own = np.argmin(d, axis=1)
            homes.append(own)
            plane = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * gap[own])
            plane[np.arange(len(x)), own] = 0
            out.append(plane**2)
        return homes[0] * len(self.books[1]) + homes[1], out

    def visits(self, x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells; (row, cell) of all cells up to the bound and not after the home, each row's nearest first: a merge of both halves' sorted sequences by their sums."""
        home, (a, b) = self.bounds(x)
        row, i = np.nonzero(a <= most)
        order = np.argsort(b, axis=1)
        ranked = np.take_along_axis(b, order, axis=1)
        room = most - a[row, i]
        n = np.zeros(len(row), np.int64)
        for lo in range(0, len(row), 50_000):
            own = slice(lo, lo + 50_000)
            n[own] = (ranked[row[own]] <= room[own, None]).sum(axis=1)
        place = ranges(np.zeros(len(row), np.int64), n)
        row, i = np.repeat(row, n), np.repeat(i, n)
        cell = i * len(self.books[1]) + order[row, place]
        near = a[row, i] + ranked[row, place]
        keep = np.flatnonzero(cell <= home[row])
        keep = keep[np.lexsort((cell[keep], near[keep], row[keep]))]
        return home, row[keep], cell[keep]

    def stop(self, sample: np.ndarray, cosine: float, recall: float) -> float:
        """The bound up to which vectors visit cells to find that share of the links."""
        most = 2 - 2 * cosine + 1e-9
        if recall >= 1:
            return most
        home, (a, b) = self.bounds(sample)
        x, y = np.nonzero(sample[:PROBES] @ sample.T >= cosine)
        x, y = x[x != y], y[x != y]
        first = np.where(home[x] >= home[y], x, y)  # visits
        other = np.where(home[x] >= home[y], y, x)
        needs = a[first, home[other] // len(self.books[1])] + b[first, home[other] % len(self.books[1])]
        return min(most, float(np.quantile(needs, recall, method="higher")) + 1e-12) if len(needs) else most


def _prepared(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, str, DataFrame]:
    """(vec_id, raw) of every row, the element type, and the distinct valid vectors (uid, least, copies, raw)."""
    element = vectors.schema[column].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column("v"):
                x = v.values
                ok = v.is_valid and len(x) > 0 and x.null_count == 0
                a = x.to_numpy(zero_copy_only=False) + 0.0 if ok else None  # -0.0 becomes 0.0
                raw.append(a.astype(kind).tobytes() if ok and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    rows = stored(own.mapInArrow(lean(pack), "vec_id long, raw binary"), "embedding-rows")
    distinct = rows.filter("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return rows, kind, stored(distinct.withColumn("uid", F.monotonically_increasing_id()), "embedding-distinct")  # numbered as they are written


def _columns(batch: pa.RecordBatch, kind: str):
    return units(batch.column("raw").to_pylist(), kind)


def fitted(sample: np.ndarray, n: int, most: float) -> Grid:
    """The grid of the least cost (vectors sent and, lighter, compared) for n vectors by its sample."""
    half, best = sample.shape[1] // 2, None
    for k in (2**i for i in range(9)):
        if k > max(4, np.sqrt(n) / 4):
            break
        grid = Grid(codebook(sample[:, :half], k), codebook(sample[:, half:], k))
        homes = np.bincount(grid.bounds(sample)[0], minlength=k * k) * (n / len(sample))
        cells = grid.visits(sample[:PROBES], most)[2]
        cost = float((np.ceil(homes[cells] / BLOCK) + homes[cells] / 256).sum())
        if best is None or cost < best[0]:
            best = cost, grid
    return best[1]


def _met(distinct: DataFrame, n: int, kind: str, cosine: float, recall: float) -> DataFrame:
    """(uid, n, a, b) of all links among n distinct vectors of one length: link counts, and stars over the least vec_ids."""
    sample = units([bytes(r["raw"]) for r in distinct.orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()], kind)
    most = 2 - 2 * cosine + 1e-9
    grid = fitted(sample, n, most)
    most = grid.stop(sample, cosine, recall)
    rows = max(1, min(1000, 500_000 // (len(grid.books[0]) * len(grid.books[1]))))  # a chunk's visits fit in memory

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(grid.books[0]) * len(grid.books[1])
        homes, met = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            x = _columns(batch, kind)
            for lo in range(0, len(x), rows):
                home, _, cell = grid.visits(x[lo : lo + rows], most)
                homes += np.bincount(home, minlength=cells)
                met += np.bincount(cell, minlength=cells)
        used = np.flatnonzero(homes + met)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used), "homes": pa.array(homes[used]), "met": pa.array(met[used])})

    counted = distinct.select("raw").mapInArrow(lean(count), "cell long, homes long, met long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("met").alias("met")).collect()  # at most a row a cell
    home_blocks = {r["cell"]: -(-r["homes"] // BLOCK) for r in counted}
    visit_blocks = {r["cell"]: -(-max(r["met"], 1) // (4 * BLOCK)) for r in counted}
    cells = len(grid.books[0]) * len(grid.books[1])
    hb, vb = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for cell in home_blocks:
        hb[cell], vb[cell] = home_blocks[cell], visit_blocks[cell]
    step = int(max([1, *hb.tolist()])) * int(max([1, *vb.tolist()]))
    width = 8 if kind == "<f8" else 4
    sent = sum(r["met"] * home_blocks[r["cell"]] + r["homes"] * visit_blocks[r["cell"]] for r in counted) * (sample.shape[1] * width + 32)
    buckets = int(max(64, sent // (8 << 20)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            uid, copies = (batch.column(c).to_numpy() for c in ("uid", "copies"))
            least, named = pc.fill_null(batch.column("least"), 0).to_numpy(), batch.column("least").is_valid().to_numpy(zero_copy_only=False)
            for lo in range(0, len(raw), rows):
                part = raw[lo : lo + rows]
                bits = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1)
                home, row, cell = grid.visits(units(part, kind), most)
                used = hb[cell] > 0
                row, cell = row[used], cell[used]
                salt = mix(uid[lo : lo + len(part)].view(np.uint64)).astype(np.int64) & 0x7FFFFFFF
                # A visitor goes to every block of homes with its own visitor block, a home to every visitor block.
                r1, c1 = np.repeat(row, hb[cell]), np.repeat(cell, hb[cell])
                b1 = ranges(np.zeros(len(row), np.int64), hb[cell])
                v1 = salt[r1] % vb[c1]
                r2, c2 = np.repeat(np.arange(len(part)), vb[home]), np.repeat(home, vb[home])
                v2, b2 = ranges(np.zeros(len(home), np.int64), vb[home]), (salt[r2] >> 8) % hb[c2]
                r, place = np.concatenate((r1, r2)), np.concatenate(((c1 * step + b1 * vb[c1] + v1), (c2 * step + b2 * vb[c2] + v2)))
                role = np.concatenate((np.where(home[r1] == c1, 1, 0), np.full(len(r2), 2))).astype(np.int8)  # visitor, visitor at home, home
                bucket = (mix(place.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    own = order[a:b]
                    at = r[own] + lo
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (place[own], role[own], uid[at], least[at], named[at], copies[at].astype(np.int64), bits[r[own]])]], names=["bucket", "place", "role", "uid", "least", "named", "copies", "raw"])

    def compare(table: pa.Table) -> pa.Table:
        read = lambda name, t: np.concatenate([np.frombuffer(x, t) for x in table.column(name).to_pylist()])
        place, role, uid, least, named, copies = read("place", np.int64), read("role", np.int8), read("uid", np.int64), read("least", np.int64), read("named", np.bool_), read("copies", np.int64)
        bits = read("raw", np.uint8).reshape(len(place), -1)
        order = np.lexsort((role, place))
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
        ids, counts, stars = [], [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[lo:hi]
            split = int(np.searchsorted(role[own], 2))
            homes, visitors = own[split:], own[:split]
            if not len(homes) or not len(visitors):
                continue
            h = _unit_rows(bits[homes], kind)
            for at in range(0, len(visitors), 512):
                v = visitors[at : at + 512]
                near = _unit_rows(bits[v], kind) @ h.T >= cosine
                near &= uid[v][:, None] != uid[homes][None]
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                ids.append(uid[v[x]])
                counts.append(copies[homes[y]])
                other = role[v[x]] == 0  # of two vectors at home in one cell each visits the other
                ids.append(uid[homes[y[other]]])
                counts.append(copies[v[x[other]]])
                a, b = least[v[x]], least[homes[y]]
                both = named[v[x]] & named[homes[y]] & (a != b)
                stars.append(spanning(a[both], b[both]))
                if sum(map(len, ids)) > 2_000_000:
                    ids, counts = _summed(ids, counts)
        ids, counts = _summed(ids, counts)
        a, b = spanning(*(np.concatenate(x) for x in zip(*stars, strict=True)))
        none = lambda k: pa.nulls(k, pa.int64())
        n, m = len(ids[0]), len(a)
        return pa.table({"uid": pa.concat_arrays([pa.array(ids[0], pa.int64()), none(m)]), "n": pa.concat_arrays([pa.array(counts[0], pa.int64()), none(m)]), "a": pa.concat_arrays([none(n), pa.array(a, pa.int64())]), "b": pa.concat_arrays([none(n), pa.array(b, pa.int64())])})

    met = distinct.mapInArrow(lean(send), "bucket int, place binary, role binary, uid binary, least binary, named binary, copies binary, raw binary").groupBy("bucket").applyInArrow(lean(compare), "uid long, n long, a long, b long")
    return stored(met, "embedding-links")


def link_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id), one row a vector; no link is found below the cosine, and at a target_recall of 1 all are."""
    rows, kind, distinct = _prepared(vectors, id_column, column)
    size = F.octet_length("raw")
    lengths = distinct.groupBy(size.alias("size")).count().filter("count > 1").orderBy("size").collect()  # a row a length
    none = vectors.sparkSession.createDataFrame([], "uid long, n long, a long, b long")
    met = reduce(DataFrame.union, [_met(distinct.filter(size == r["size"]), r["count"], kind, cosine, target_recall) for r in lengths] or [none])
    counts = met.filter("uid IS NOT NULL").groupBy("uid").agg(F.sum("n").alias("far"))
    groups = components(met.filter("uid IS NULL").select("a", "b"))
    nodes = distinct.join(counts, "uid", "left").join(groups, distinct["least"] == groups["node"], "left")
    nodes = nodes.select(F.col("raw").alias("_raw"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "least").alias("least"))
    joined = rows.join(nodes, F.col("raw") == F.col("_raw"), "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))


def _summed(ids: list, counts: list) -> tuple[list, list]:
    if not ids:
        return [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own, at = np.unique(np.concatenate(ids), return_inverse=True)
    return [own], [np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)]


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
