"""Force layouts of scopes of any size: every tick is a Spark step over a grid of cells.

Charges: a scope's square is halved into cells until one holds some `OCCUPANCY` nodes.  A node meets the nodes of the cells around its
own pair by pair, and of all farther cells only the sums of the largest that lie far enough away for their size; how far
follows from the opening angle.  Angle 0 has one cell, so all pairs are exact.  Nodes of a cell meet in parts of bounded size.

Unlike `layout.simulate`, which moves the ends of one link or collision before it looks at the next, a tick here looks at the places
that all nodes had when it began, as no order runs through a cluster; pair forces are the same.  Every tick is cut from the one
before by a checkpoint.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import layout as L
from cardloom.operators.layout import TASKS, TICKS, TILE, Forces
from cardloom.sources.versioned import cut

#: Nodes that a cell holds on average, at most.
OCCUPANCY = 64
#: Nodes of a side that meet in one task.  A node travels once for every part of its scope, so large parts keep the shuffle small; memory is a tile.
PART = 16384
_ROWS = "scope_id long, cx long, cy long, tp int, sp int, kind int, node_id long, x double, y double, mass double"


def _unit(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Direction from the lower to the higher id of two nodes in one place."""
    angle = (low * 31 + high * 17) * L.GOLDEN_ANGLE
    return np.stack([np.cos(angle), np.sin(angle)], axis=-1)


def repulsion(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, weight: np.ndarray | None = None, own: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """What points (u, v) do to points (x, y) and, if they have no weights, these to them, at a charge of 1: d / max(d^2, 1) summed over the pairs.

    With own both are the same points, and each pair is met once.  Pairs in one place are left out and returned by their indices.  Memory
    is a tile, whatever the number of points.
    """
    left, right, same = np.zeros((len(x), 2)), np.zeros((len(u), 2)), []
    a, b = np.stack([x, y, np.ones(len(x))], axis=1), np.stack([u, v, np.ones(len(u))], axis=1)
    if weight is not None:
        b *= weight[:, None]
    dx, dy = np.empty((2, min(TILE[0], len(x)), min(TILE[1], len(u))))
    for lo in range(0, len(x), TILE[0]):
        hi = min(lo + TILE[0], len(x))
        for at in range(lo if own else 0, len(u), TILE[1]):
            to = min(at + TILE[1], len(u))
            d, f = dx[: hi - lo, : to - at], dy[: hi - lo, : to - at]
            np.subtract(u[None, at:to], x[lo:hi, None], out=d)
            np.subtract(v[None, at:to], y[lo:hi, None], out=f)
            np.multiply(d, d, out=d)
            np.multiply(f, f, out=f)
            np.add(f, d, out=f)
            if own and at < hi:  # of the tiles on the diagonal the upper half
                f[np.arange(lo, hi)[:, None] >= np.arange(at, to)[None]] = np.inf
            if f.size and f.min() == 0:
                r, c = np.nonzero(f == 0)
                same.extend(zip((r + lo).tolist(), (c + at).tolist(), strict=True))
                f[r, c] = np.inf
            np.maximum(f, 1, out=f)
            np.reciprocal(f, out=f)
            s = f @ b[at:to]
            left[lo:hi, 0] += s[:, 0] - x[lo:hi] * s[:, 2]
            left[lo:hi, 1] += s[:, 1] - y[lo:hi] * s[:, 2]
            if weight is not None:
                continue
            s = f.T @ a[lo:hi]
            right[at:to, 0] += s[:, 0] - u[at:to] * s[:, 2]
            right[at:to, 1] += s[:, 1] - v[at:to] * s[:, 2]
    return (left + right if own else left), right, same


def _grid(placed: DataFrame, occupancy: int, one_cell: bool) -> DataFrame:
    """placed (scope_id, node_id, x, y) with its leaf cell cx, cy, the number of halvings `depth`, and `parts`."""
    box = placed.groupBy("scope_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"), F.count("*").alias("n"))
    depth = F.lit(0) if one_cell else F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / occupancy) / math.log(4)))
    rows = placed.join(box.withColumn("depth", depth.cast("int")), "scope_id")
    at = lambda c, c0: F.least(F.floor((F.col(c) - F.col(c0)) / F.col("side") * F.pow(F.lit(2.0), F.col("depth"))), F.pow(F.lit(2.0), F.col("depth")) - 1).cast("long")
    rows = rows.withColumns({"cx": at("x", "x0"), "cy": at("y", "y0")})
    fullest = rows.groupBy("scope_id", "cx", "cy").agg(F.count("*").alias("m")).groupBy("scope_id").agg(F.ceil(F.max("m") / PART).cast("int").alias("parts"))
    return rows.join(fullest, "scope_id").select("scope_id", "node_id", "x", "y", "cx", "cy", "depth", "parts")


def _explode_range(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def charges(placed: DataFrame, angle: float = 0.5, charge: float = -180.0, alpha: float = 1.0, occupancy: int = OCCUPANCY) -> DataFrame:
    """(scope_id, node_id, fx, fy): what all other nodes of its scope do to each node of (scope_id, node_id, x, y)."""
    if not 0 <= angle < 1:
        raise ValueError("the opening angle lies from 0 to below 1")
    rows = cut(_grid(placed, occupancy, angle == 0))
    if angle == 0:
        return _all_pairs(rows, charge * alpha)
    reach = math.ceil(1 / angle)
    part = lambda: F.pmod(F.xxhash64("node_id"), F.col("parts")).cast("int")
    every = lambda: _explode_range(F.lit(0), F.col("parts") - 1)
    target = rows.select("scope_id", "cx", "cy", part().alias("tp"), every().alias("sp"), F.lit(0).alias("kind"), "node_id", "x", "y", F.lit(1.0).alias("mass"))
    edge = F.pow(F.lit(2.0), F.col("depth")).cast("long") - 1
    around = lambda c: _explode_range(F.greatest(F.col(c) - reach, F.lit(0).cast("long")), F.least(F.col(c) + reach, F.col("edge")))
    near = rows.withColumn("edge", edge).withColumn("nx", around("cx")).withColumn("ny", around("cy"))
    near = near.select("scope_id", F.col("nx").alias("cx"), F.col("ny").alias("cy"), every().alias("tp"), part().alias("sp"), F.lit(1).alias("kind"), "node_id", "x", "y", F.lit(1.0).alias("mass"))
    both = target.unionByName(near)
    leaves = rows.groupBy("scope_id", "cx", "cy").agg(F.first("depth").alias("depth"), F.first("parts").alias("parts"), F.count("*").alias("mass"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    levels = leaves.withColumn("level", _explode_range(F.lit(1), F.greatest(F.col("depth"), F.lit(1)))).filter("level <= depth").withColumn("scale", F.pow(F.lit(2.0), F.col("depth") - F.col("level")).cast("long"))
    up = lambda c: F.floor(F.col(c) / F.col("scale")).cast("long")
    sums = levels.groupBy("scope_id", "level", up("cx").alias("jx"), up("cy").alias("jy")).agg(F.sum("mass").cast("double").alias("mass"), (F.sum("sx") / F.sum("mass")).alias("x"), (F.sum("sy") / F.sum("mass")).alias("y"))
    # Far cells of a level: those around the parent's place that the next finer level does not look at.
    own = levels.withColumns({"ux": up("cx"), "uy": up("cy")})
    wide = lambda c: _explode_range(F.greatest(2 * (F.floor(F.col(c) / 2) - reach), F.lit(0)).cast("long"), (2 * (F.floor(F.col(c) / 2) + reach) + 1).cast("long"))
    own = own.withColumn("jx", wide("ux")).withColumn("jy", wide("uy")).filter((F.abs(F.col("jx") - F.col("ux")) > reach) | (F.abs(F.col("jy") - F.col("uy")) > reach))
    far = own.select("scope_id", "level", "jx", "jy", "cx", "cy", "parts").join(sums, ["scope_id", "level", "jx", "jy"])
    far = far.select("scope_id", "cx", "cy", every().alias("tp"), F.lit(0).alias("sp"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("node_id"), "x", "y", "mass")
    both = both.unionByName(far)

    def meet(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        ids, x, y, mass = (table[c].to_numpy() for c in ("node_id", "x", "y", "mass"))
        a, b = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
        named = np.where(kind == 2, -1, np.nan_to_num(ids.astype(float), nan=-1)).astype(np.int64)
        total, _, same = repulsion(x[a], y[a], x[b], y[b], mass[b])
        for i, j in same:
            p, q = named[a[i]], named[b[j]]
            if kind[b[j]] == 1 and p != q:
                total[i] += _unit(np.float64(min(p, q)), np.float64(max(p, q))) * (1 if p < q else -1)
        total *= charge * alpha
        return pa.table({"scope_id": table["scope_id"].take(pa.array(a)), "node_id": pa.array(named[a]), "fx": total[:, 0], "fy": total[:, 1]})

    met = both.select(*[c.split()[0] for c in _ROWS.split(", ")]).groupBy("scope_id", "cx", "cy", "tp", "sp").applyInArrow(meet, "scope_id long, node_id long, fx double, fy double")
    return met.groupBy("scope_id", "node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _all_pairs(rows: DataFrame, force: float) -> DataFrame:
    """The charges of nodes (scope_id, node_id, x, y, parts) pair by pair: two parts meet once, for both."""
    part = F.pmod(F.xxhash64("node_id"), F.col("parts")).cast("int")
    both = rows.withColumn("p", part).withColumn("q", _explode_range(F.lit(0), F.col("parts") - 1))
    both = both.select("scope_id", F.least("p", "q").alias("tp"), F.greatest("p", "q").alias("sp"), (F.col("p") > F.col("q")).cast("int").alias("kind"), F.col("node_id").cast("long").alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def meet(table: pa.Table) -> pa.Table:
        ids, x, y, kind = (table[c].to_numpy() for c in ("node_id", "x", "y", "kind"))
        a = np.flatnonzero(kind == 0)
        own = table["tp"][0].as_py() == table["sp"][0].as_py()
        b = a if own else np.flatnonzero(kind == 1)
        left, right, same = repulsion(x[a], y[a], x[b], y[b], own=own)
        back = left if own else right
        for i, j in same:
            p, q = ids[a[i]], ids[b[j]]
            if p != q:
                push = _unit(np.float64(min(p, q)), np.float64(max(p, q))) * (1 if p < q else -1)
                left[i] += push
                back[j] -= push
        at, total = (a, left) if own else (np.concatenate([a, b]), np.concatenate([left, right]))
        total *= force
        return pa.table({"scope_id": table["scope_id"].take(pa.array(at)), "node_id": pa.array(ids[at]), "fx": total[:, 0], "fy": total[:, 1]})

    # The groups are small in bytes and long in work: a fixed number of partitions keeps them apart.
    groups = rows.groupBy("scope_id").agg(F.first("parts").cast("long").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("n")).first()["n"] or 0
    both = both.repartition(min(max(1, 8 * int(groups)), TASKS), "scope_id", "tp", "sp")
    met = both.groupBy("scope_id", "tp", "sp").applyInArrow(meet, "scope_id long, node_id long, fx double, fy double")
    return met.groupBy("scope_id", "node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _direction(dx: Column, dy: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """dx, dy and their length; of two nodes in one place a direction from their ids, length 1."""
    length = F.sqrt(dx * dx + dy * dy)
    angle = (low * 31 + high * 17) * F.lit(L.GOLDEN_ANGLE)
    return F.when(length == 0, F.cos(angle)).otherwise(dx), F.when(length == 0, F.sin(angle)).otherwise(dy), F.when(length == 0, 1.0).otherwise(length)


def _pushes(pairs: DataFrame, factor: Column) -> DataFrame:
    """(scope_id, node_id, fx, fy) of pairs (scope_id, a, b, dx, dy): a moves along by half the factor, b against it."""
    fx, fy = F.col("dx") * factor / 2, F.col("dy") * factor / 2
    ends = F.explode(F.array(F.struct(F.col("a").alias("node_id"), fx.alias("fx"), fy.alias("fy")), F.struct(F.col("b").alias("node_id"), (-fx).alias("fx"), (-fy).alias("fy"))))
    return pairs.select("scope_id", ends.alias("e")).select("scope_id", "e.*").groupBy("scope_id", "node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _moved(state: DataFrame, pushes: DataFrame) -> DataFrame:
    """state with the pushes added to its velocities."""
    rows = state.join(pushes, ["scope_id", "node_id"], "left")
    return rows.withColumns({"vx": F.col("vx") + F.coalesce("fx", F.lit(0.0)), "vy": F.col("vy") + F.coalesce("fy", F.lit(0.0))}).drop("fx", "fy")


def tick(state: DataFrame, links: DataFrame, alpha: float, angle: float, forces: Forces = Forces()) -> DataFrame:
    """state (scope_id, node_id, x, y, vx, vy) one tick later; links are (scope_id, a, b, strength), a < b, each once."""
    ahead = state.select("scope_id", "node_id", (F.col("x") + F.col("vx")).alias("px"), (F.col("y") + F.col("vy")).alias("py"))
    end = lambda name: ahead.select("scope_id", F.col("node_id").alias(name), F.col("px").alias(f"{name}x"), F.col("py").alias(f"{name}y"))
    pairs = links.join(end("a"), ["scope_id", "a"]).join(end("b"), ["scope_id", "b"])
    dx, dy, length = _direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("a"), F.col("b"))
    pairs = pairs.withColumns({"dx": dx, "dy": dy, "length": length})
    wanted = forces.link_distance - forces.link_distance_by_strength * F.col("strength")
    state = _moved(state, _pushes(pairs, (F.col("length") - wanted) / F.col("length") * alpha * (forces.link_pull + forces.link_pull_by_strength * F.col("strength"))))
    state = _moved(state, charges(state.select("scope_id", "node_id", "x", "y"), angle, forces.charge, alpha))
    # Collisions: nodes nearer than two radii, found among neighbouring squares of that side.
    least = 2 * forces.radius
    if least:
        ahead = state.select("scope_id", "node_id", (F.col("x") + F.col("vx")).alias("px"), (F.col("y") + F.col("vy")).alias("py"))
        square = lambda c: F.floor(F.col(c) / least).cast("long")
        own = ahead.select("scope_id", square("px").alias("gx"), square("py").alias("gy"), F.col("node_id").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"))
        step = lambda c: _explode_range(F.col(c) - 1, F.col(c) + 1)
        other = ahead.select("scope_id", square("px").alias("hx"), square("py").alias("hy"), F.col("node_id").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by")).withColumn("gx", step("hx")).withColumn("gy", step("hy"))
        pairs = own.join(other, ["scope_id", "gx", "gy"]).filter("a < b")
        dx, dy, length = _direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("a"), F.col("b"))
        near = pairs.withColumn("d2", F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)).filter(F.col("d2") < least * least).withColumns({"dx": dx, "dy": dy, "length": length})
        state = _moved(state, _pushes(near, -(F.lit(least) - F.col("length")) / F.col("length") * forces.collide * alpha))
    over = F.lit(0.0)
    if forces.boundary and forces.boundary_radius:
        away = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
        over = F.greatest(away - forces.boundary_radius, F.lit(0.0)) / F.greatest(away, F.lit(1e-300)) * forces.boundary * alpha
    speed = lambda v, p: (F.col(v) - F.col(p) * (forces.center * alpha) - F.col(p) * over) * forces.friction
    state = state.withColumns({"vx": speed("vx", "x"), "vy": speed("vy", "y")})
    return cut(state.withColumns({"x": F.col("x") + F.col("vx"), "y": F.col("y") + F.col("vy")}))


def force_layout(nodes: DataFrame, edges: DataFrame, ticks: int = TICKS, angle: float = 0.5, forces: Forces = Forces()) -> DataFrame:
    """(scope_id, node_id, x, y) of nodes (scope_id, node_id, side) and edges (scope_id, node_a_id, node_b_id, strength) after so many ticks from the spiral."""
    from cardloom.operators.layout import seeded

    one = nodes.groupBy("scope_id", "node_id").agg(F.min("side").alias("side"))
    state = cut(seeded(one).select("scope_id", "node_id", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")))
    ends = edges.filter("node_a_id <> node_b_id").select("scope_id", F.least("node_a_id", "node_b_id").alias("a"), F.greatest("node_a_id", "node_b_id").alias("b"), F.struct("node_a_id", "node_b_id", F.col("strength").cast("double").alias("strength")).alias("e"))
    links = cut(ends.groupBy("scope_id", "a", "b").agg(F.min("e").alias("e")).select("scope_id", "a", "b", "e.strength"))
    alpha, decay = 1.0, 1 - forces.alpha_min ** (1 / 300)
    for _ in range(ticks):
        alpha -= alpha * decay
        state = tick(state, links, alpha, angle, forces)
    return state.select("scope_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
