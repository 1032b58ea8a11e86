"""Layouts: spiral seeds, force simulation by scope, slices, bubbles and byte packing.

A simulation is sequential inside a scope, so a scope is one group; scopes run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.functions import layout as L
from cardloom.functions.series import inverse_distances
from cardloom.sources.versioned import cut

TICKS = 160
#: Nodes of a scope whose charges are added up pair by pair, at most; those of more nodes meet by groups.
PLAIN = 1024
#: Nodes by nodes whose pairs are formed at a time: a tile stays in a core's cache.
TILE = (128, 1024)
#: Partitions that scopes are spread over, at most.
TASKS = 2000
#: Squares of collisions end this far out, so that they have whole numbers; pairs whose distances are held at a time.
FAR, PAIRS = 1 << 30, 1 << 20


@dataclass(frozen=True)
class Forces:
    """Parameters of the force model; the defaults are fixed values."""

    ticks: int = TICKS
    alpha_min: float = 0.001
    friction: float = 0.55
    link_distance: float = 92.0
    link_distance_by_strength: float = 36.0
    link_pull: float = 1.05
    link_pull_by_strength: float = 0.5
    charge: float = -180.0
    radius: float = 16.0
    collide: float = 0.92
    center: float = 0.10
    boundary_radius: float = 0.0
    boundary: float = 0.0

    def __post_init__(self) -> None:
        if not isinstance(self.ticks, int) or self.ticks < 0:
            raise ValueError("ticks must be a whole number from 0")
        for name, value in vars(self).items():
            if not math.isfinite(value):
                raise ValueError(f"{name} must be finite")
        for name in ("link_distance", "radius", "collide", "center", "boundary_radius", "boundary"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0 < self.alpha_min < 1 or not 0 <= self.friction <= 1:
            raise ValueError("alpha_min must lie between 0 and 1, friction from 0 to 1")


def seeded(nodes: DataFrame) -> DataFrame:
    """(scope_id, node_id, side, x, y): nodes on the spiral of their scope, by id."""
    index = F.row_number().over(W.partitionBy("scope_id").orderBy("node_id")) - 1
    x, y = L.seed(index)
    return nodes.select("scope_id", "node_id", "side", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _unit(i: int, j: int, ids: np.ndarray) -> np.ndarray:
    angle = (ids[i] * 31 + ids[j] * 17) * L.GOLDEN_ANGLE
    return np.array([np.cos(angle), np.sin(angle)])


def _charged(ids: np.ndarray, pos: np.ndarray, force: float) -> np.ndarray:
    """What all nodes do to each, added up in their order, a tile after the other."""
    x, y = np.ascontiguousarray(pos.T)
    n, out = len(ids), np.zeros((2, len(ids)))
    dx, dy, f, g = np.empty((4, *TILE))
    for lo in range(0, n, TILE[1]):
        hi = min(lo + TILE[1], n)
        for at in range(0, n, TILE[0]):
            to = min(at + TILE[0], n)
            a, b, c, d = (z[: to - at, : hi - lo] for z in (dx, dy, f, g))
            np.subtract(x[at:to, None], x[None, lo:hi], out=a)
            np.subtract(y[at:to, None], y[None, lo:hi], out=b)
            np.multiply(a, a, out=c)
            np.multiply(b, b, out=d)
            np.add(c, d, out=c)
            zero = np.argwhere(c == 0) if c.min() == 0 else ()
            np.maximum(c, 1, out=c)
            np.divide(force, c, out=c)
            for j, i in zero:
                if i + lo == j + at:
                    c[j, i] = 0
                else:
                    low, high = sorted((i + lo, j + at))
                    a[j, i], b[j, i] = _unit(low, high, ids) * (1 if i + lo == low else -1)
            for k, z in enumerate((a, b)):
                np.multiply(z, c, out=z)
                z[0] += out[k, lo:hi]
                np.add.reduce(z, axis=0, out=out[k, lo:hi])
    return out.T


def _pulled(ids: np.ndarray, edges: list[tuple[int, int, float]], pos: np.ndarray, vel: np.ndarray, alpha: float, forces: Forces) -> np.ndarray:
    """Velocities after the links, one after the other.  abs(complex) is C's hypot, as in numpy."""
    (px, py), (vx, vy) = pos.T.tolist(), vel.T.tolist()
    for i, j, strength in edges:
        dx, dy = px[j] + vx[j] - px[i] - vx[i], py[j] + vy[j] - py[i] - vy[i]
        length = abs(complex(dx, dy))
        if length == 0:
            (dx, dy), length = _unit(i, j, ids).tolist(), 1.0
        wanted = forces.link_distance - forces.link_distance_by_strength * strength
        f = (length - wanted) / length * alpha * (forces.link_pull + forces.link_pull_by_strength * strength)
        fx, fy = dx * f / 2, dy * f / 2
        vx[i] += fx
        vy[i] += fy
        vx[j] -= fx
        vy[j] -= fy
    return np.array([vx, vy]).T.copy()


def _charges(ids: np.ndarray, pos: np.ndarray, force: float) -> np.ndarray:
    """What all nodes do to each."""
    if len(ids) <= PLAIN:
        return _charged(ids, pos, force)
    x, y = pos.T
    met = -force * inverse_distances(x + 1j * y)
    out = np.stack([met.real, -met.imag], axis=1)
    order = np.lexsort((np.arange(len(ids)), y, x))
    same = np.append((np.diff(x[order]) == 0) & (np.diff(y[order]) == 0), False)
    for at in np.flatnonzero(same & ~np.roll(same, 1)):  # nodes in one place
        group = order[at : at + 1 + np.argmin(same[at:])].tolist()
        for k, i in enumerate(group):
            for j in group[k + 1 :]:
                push = _unit(i, j, ids) * force
                out[i] += push
                out[j] -= push
    return out


def _close(x: np.ndarray, y: np.ndarray, key: np.ndarray, order: np.ndarray, square: float) -> np.ndarray:
    """The lower nodes of the pairs nearer than the root of `square`; nodes come in the order of their squares' keys."""
    key, found = key[order], [np.zeros(0, np.int64)]
    after = np.arange(1, len(key) + 1)
    for lo, hi in ((after, np.searchsorted(key, key + 1, "right")), (np.searchsorted(key, key + 4 * FAR - 1), np.searchsorted(key, key + 4 * FAR + 1, "right"))):
        ends = np.cumsum(hi - lo)
        for rows in np.split(np.arange(len(key)), np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS))):
            n = (hi - lo)[rows]
            i = np.repeat(rows, n)
            j = np.arange(len(i)) + np.repeat(lo[rows] - np.cumsum(n) + n, n)
            i, j = order[i], order[j]
            found.append(np.minimum(i, j)[np.square(x[i] - x[j]) + np.square(y[i] - y[j]) <= square])
    return np.concatenate(found)


def _apart(ids: np.ndarray, ahead: np.ndarray, alpha: float, forces: Forces) -> np.ndarray:
    """Places after the collisions: each node in order meets the later ones in order, as they then stand.

    Squares keep who is near, and only nodes that are, or come to be, near a later one are looked at.
    """
    least = 2 * forces.radius
    if not least:
        return ahead
    side, square = least * (1 + 1e-9), least * least
    a, b = np.clip(ahead // side, -FAR, FAR).astype(np.int64).T
    keys = a * (4 * FAR) + b
    order = np.argsort(keys, kind="stable")
    due = bytearray(len(keys))
    for i in _close(*ahead.T, keys, order, square * (1 + 1e-9)).tolist():
        due[i] = 1
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1)).tolist()
    nodes, (x, y), at = order.tolist(), ahead.T.tolist(), keys.tolist()
    held = {at[nodes[lo]]: nodes[lo:hi] for lo, hi in zip(first, [*first[1:], len(nodes)], strict=True)}
    around = [p * 4 * FAR + q for p in (-1, 0, 1) for q in (-1, 0, 1)]

    def moved(i: int, dx: float, dy: float) -> bool:
        x[i] += dx
        y[i] += dy
        c = int(min(max(x[i] // side, -FAR), FAR)) * 4 * FAR + int(min(max(y[i] // side, -FAR), FAR))
        if c == at[i]:
            return False
        held[at[i]].remove(i)
        held.setdefault(c, []).append(i)
        at[i] = c
        return True

    def later(i: int, last: int) -> list[int]:
        return sorted([m for k in around for m in held.get(at[i] + k, ()) if m > last], reverse=True)

    i = due.find(1)
    while i >= 0:
        left = later(i, i)
        while left:
            j = left.pop()
            dx, dy = x[j] - x[i], y[j] - y[i]
            if dx * dx + dy * dy >= square:
                continue
            length = abs(complex(dx, dy))
            if length == 0:
                (dx, dy), length = _unit(i, j, ids).tolist(), 1.0
            f = (least - length) / length * forces.collide * alpha
            if moved(i, -dx * f / 2, -dy * f / 2):
                left = later(i, j)
            moved(j, dx * f / 2, dy * f / 2)
            for m in later(j, i):
                if m != j and (x[m] - x[j]) * (x[m] - x[j]) + (y[m] - y[j]) * (y[m] - y[j]) < square:
                    due[min(m, j)] = 1
        i = due.find(1, i + 1)
    return np.array([x, y]).T.copy()


def simulate(ids: np.ndarray, edges: list[tuple[int, int, float]], ticks: int | None = None, forces: Forces = Forces()) -> np.ndarray:
    """Places of nodes (ids ascending) after the simulation; edges are index pairs with a strength.

    Links and collisions look at where nodes are about to be, and each pair moves before the next is looked at; charge, center and
    boundary look at places.  Memory is linear in the nodes, and so is a tick's work, but for the log of the nodes in their charges; these are
    as exact as a sum over all pairs.
    """
    n = len(ids)
    index = np.arange(n)
    radius = L.SEED_RADIUS + np.sqrt(index + 1) * L.SEED_STEP
    pos = np.stack([np.cos(index * L.GOLDEN_ANGLE) * radius, np.sin(index * L.GOLDEN_ANGLE) * radius], axis=1)
    if n <= 1:
        return np.round(pos, 6)
    vel, alpha = np.zeros_like(pos), 1.0
    decay = 1 - forces.alpha_min ** (1 / 300)
    for _ in range(forces.ticks if ticks is None else ticks):
        alpha -= alpha * decay
        vel = _pulled(ids, edges, pos, vel, alpha, forces)
        vel += _charges(ids, pos, forces.charge * alpha)
        vel = _apart(ids, pos + vel, alpha, forces) - pos
        vel -= pos * (forces.center * alpha)
        if forces.boundary and forces.boundary_radius:
            length = np.hypot(*pos.T)
            over = np.maximum(length - forces.boundary_radius, 0) / np.maximum(length, 1e-300)
            vel -= pos * (over * forces.boundary * alpha)[:, None]
        vel *= forces.friction
        pos = pos + vel
    return np.round(pos, 6)


def canonical_edges(ids: np.ndarray, rows) -> list[tuple[int, int, float]]:
    """Index pairs of the undirected edges whose ends both exist, sorted; of doubles the first counts."""
    at = {int(v): i for i, v in enumerate(ids)}
    found: dict[tuple[int, int], float] = {}
    for a, b, strength in rows:
        if a in at and b in at and a != b:
            found.setdefault((min(a, b), max(a, b)), strength)
    return [(at[a], at[b], s) for (a, b), s in sorted(found.items())]


def force_layout(nodes: DataFrame, edges: DataFrame, ticks: int = TICKS, forces: Forces = Forces()) -> DataFrame:
    """(scope_id, node_id, x, y) of nodes (scope_id, node_id) and edges (scope_id, node_a_id, node_b_id, strength)."""
    links = edges.select(F.col("scope_id").alias("s"), "node_a_id", "node_b_id", F.col("strength").cast("double").alias("strength"))

    def place(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(left["node_id"].to_numpy())
        right = right.sort_values(["node_a_id", "node_b_id", "strength"])
        pos = simulate(ids, canonical_edges(ids, right[["node_a_id", "node_b_id", "strength"]].itertuples(index=False)), ticks, forces)
        return pd.DataFrame({"scope_id": key[0], "node_id": ids, "x": pos[:, 0], "y": pos[:, 1]}) if len(ids) else pd.DataFrame({"scope_id": [], "node_id": [], "x": [], "y": []})

    # Scopes are small in bytes and long in work: many more partitions than scopes keep two from falling into one task.
    own = cut(nodes.select("scope_id", "node_id"))
    tasks = min(max(1, 64 * own.select("scope_id").distinct().count()), TASKS)
    own, links = own.repartition(tasks, "scope_id"), links.repartition(tasks, "s")
    return own.groupBy("scope_id").cogroup(links.groupBy("s")).applyInPandas(place, "scope_id long, node_id long, x double, y double")


def bounds(placed: DataFrame) -> DataFrame:
    """Least and greatest places; zeros without nodes."""
    return placed.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max))])


def sliced(placed: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Nodes inside a rectangle, its edges included."""
    if x0 > x1 or y0 > y1:
        raise ValueError("bounds must not be reversed")
    return placed.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def sliced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges (scope_id, node_a_id, node_b_id, ...) both of whose ends a slice keeps (scope_id, node_id)."""
    own = kept.select("scope_id", "node_id")
    for end in ("node_a_id", "node_b_id"):
        edges = edges.join(own.withColumnRenamed("node_id", end), ["scope_id", end], "left_semi")
    return edges


def focus(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, focus_id, edge_id): each node with itself and its neighbours, and the edge that is lit with them (null: itself).

    Rows, not sets: a hub's neighbours stay spread.
    """
    name = F.concat_ws(":", F.col("node_a_id").cast("string"), F.col("node_b_id").cast("string")).alias("edge_id")
    both = edges.select(F.col("node_a_id").alias("node_id"), F.col("node_b_id").alias("focus_id"), name).union(edges.select("node_b_id", "node_a_id", name))
    return nodes.select("node_id", F.col("node_id").alias("focus_id"), F.lit(None).cast("string").alias("edge_id")).union(both).distinct()


def branch_layout(children: DataFrame, width: float = L.DESKTOP_WIDTH, passes: int = 80) -> DataFrame:
    """(parent_id, id, x, y, diameter): bubbles heaviest first on rings, then pushed apart until none overlap or `passes` are over."""
    own = children.withColumn("diameter", L.bubble(F.col("descendants"), F.lit(width))["diameter"].cast("double"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["descendants", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        d, n = pdf["diameter"].to_numpy(), len(pdf)
        pos, index, ring, radius = np.zeros((n, 2)), 1, 1, d[0] / 2 if n else 0.0
        while index < n:
            take = min(6 * ring, n - index)
            radius += d[index : index + take].max() + 44 if ring == 1 else d[index : index + take].max() + 22
            step = 2 * np.pi / (6 * ring)
            angle = -np.pi / 2 + (step / 2 if ring % 2 == 0 else 0) + step * np.arange(take)
            pos[index : index + take] = np.stack([np.cos(angle), np.sin(angle)], axis=1) * radius
            index, ring = index + take, ring + 1
        left, right = np.triu_indices(n, 1)
        for _ in range(passes):
            gap = pos[right] - pos[left]
            length = np.hypot(gap[:, 0], gap[:, 1])
            need = (d[left] + d[right]) / 2 - length
            bad = need > 1e-9
            if not bad.any():
                break
            push = np.where(length[bad, None] > 0, gap[bad] / np.maximum(length[bad, None], 1e-12), [[1.0, 0.0]]) * need[bad, None] / 2
            np.add.at(pos, left[bad], -push)
            np.add.at(pos, right[bad], push)
        return pd.DataFrame({"parent_id": pdf["parent_id"], "id": pdf["id"], "x": np.round(pos[:, 0], 6), "y": np.round(pos[:, 1], 6), "diameter": d})

    return own.select("parent_id", "id", "descendants", "diameter").groupBy("parent_id").applyInPandas(place, "parent_id long, id long, x double, y double, diameter double")


def request_size(payload: Column) -> Column:
    """Bytes of a payload struct as JSON."""
    return F.octet_length(F.to_json(payload)).cast("long")


def packed_batches(items: DataFrame, most_items: int = 1000, most_bytes: int = 900 * 1024) -> DataFrame:
    """(queue, item_id, batch): greedy batches of items (queue, item_id, bytes) in id order; state runs along a queue's rows, which are never gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, batch, n, size = None, 0, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.queue != queue:
                    queue, batch, n, size = row.queue, 0, 0, 0
                if n and (n >= most_items or size + row.bytes > most_bytes):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + row.bytes
                out.append((row.queue, row.item_id, batch))
            yield pd.DataFrame(out, columns=["queue", "item_id", "batch"])

    return items.select("queue", "item_id", "bytes").repartition("queue").sortWithinPartitions("queue", "item_id").mapInPandas(run, "queue string, item_id long, batch long")
