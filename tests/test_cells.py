"""Layouts by cells against pairwise arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cardloom.functions import layout as L
from cardloom.operators import cells
from cardloom.operators.layout import Forces


def pairwise(ids, pos, charge, alpha):
    out = np.zeros_like(pos)
    for i in range(len(ids)):
        for j in range(len(ids)):
            if i == j:
                continue
            d = pos[j] - pos[i]
            square = float(d @ d)
            if square == 0:
                angle = (min(ids[i], ids[j]) * 31 + max(ids[i], ids[j]) * 17) * L.GOLDEN_ANGLE
                d, square = np.array([math.cos(angle), math.sin(angle)]) * (1 if ids[i] < ids[j] else -1), 1.0
            out[i] += d * charge * alpha / max(square, 1)
    return out


def placed(seed, n):
    rng = np.random.default_rng(seed)
    pos = np.concatenate([rng.normal(0, 120, (n // 2, 2)), rng.normal(400, 30, (n - n // 2, 2))])
    pos[3] = pos[4]
    return np.arange(n) * 7 + 1, pos


def frame(spark, scopes):
    return spark.createDataFrame([(s, int(i), float(x), float(y)) for s, (ids, pos) in scopes.items() for i, (x, y) in zip(ids, pos, strict=True)], "scope_id long, node_id long, x double, y double")


@pytest.mark.parametrize(("angle", "most"), [(0, 1e-9), (0.5, 0.02), (0.9, 0.06)])
def test_charges(spark, monkeypatch, angle, most):
    monkeypatch.setattr(cells, "PART", 50)
    scopes = {1: placed(1, 300), 2: placed(2, 6), 3: (np.array([5]), np.zeros((1, 2)))}
    got = {(r["scope_id"], r["node_id"]): (r["fx"], r["fy"]) for r in cells.charges(frame(spark, scopes), angle, alpha=0.7, occupancy=4).collect()}
    for s, (ids, pos) in scopes.items():
        want = pairwise(ids, pos, -180.0, 0.7)
        have = np.array([got[s, i] for i in ids])
        assert np.sqrt(np.square(have - want).sum(1).mean()) <= most * max(np.sqrt(np.square(want).sum(1).mean()), 1)


def test_ticks_of_whole_layouts(spark):
    rng, forces = random.Random(4), Forces(boundary_radius=60.0, boundary=0.3)
    ids = sorted(rng.sample(range(1, 400), 24))
    edges = [(1, a, b, round(rng.random(), 3)) for a, b in (rng.sample(ids, 2) for _ in range(30))]
    nodes = spark.createDataFrame([(1, i, "inner") for i in ids] + [(2, 9, "inner")], "scope_id long, node_id long, side string")
    got = {r["node_id"]: (r["x"], r["y"]) for r in cells.force_layout(nodes, spark.createDataFrame(edges, "scope_id long, node_a_id long, node_b_id long, strength double"), 2, 0, forces).collect()}
    links = {}
    for _, a, b, s in sorted(edges, key=lambda e: e[1:]):
        links.setdefault((min(a, b), max(a, b)), s)
    k = np.arange(len(ids))
    radius = L.SEED_RADIUS + np.sqrt(k + 1) * L.SEED_STEP
    pos = np.round(np.stack([np.cos(k * L.GOLDEN_ANGLE) * radius, np.sin(k * L.GOLDEN_ANGLE) * radius], axis=1), 6)
    vel, at, alpha = np.zeros_like(pos), {v: i for i, v in enumerate(ids)}, 1.0
    for _ in range(2):
        alpha -= alpha * (1 - forces.alpha_min ** (1 / 300))
        ahead, push = pos + vel, np.zeros_like(pos)
        for (a, b), s in links.items():
            d = ahead[at[b]] - ahead[at[a]]
            length = np.hypot(*d)
            f = d * (length - (forces.link_distance - forces.link_distance_by_strength * s)) / length * alpha * (forces.link_pull + forces.link_pull_by_strength * s) / 2
            push[at[a]] += f
            push[at[b]] -= f
        vel = vel + push + pairwise(ids, pos, forces.charge, alpha)
        ahead, push, least = pos + vel, np.zeros_like(pos), 2 * forces.radius
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                d = ahead[j] - ahead[i]
                length = np.hypot(*d)
                if length < least:
                    f = d * (least - length) / length * forces.collide * alpha / 2
                    push[i] -= f
                    push[j] += f
        vel = vel + push
        away = np.hypot(*pos.T)
        vel = (vel - pos * forces.center * alpha - pos * (np.maximum(away - forces.boundary_radius, 0) / away * forces.boundary * alpha)[:, None]) * forces.friction
        pos = pos + vel
    assert np.allclose([got[i] for i in ids], pos, atol=2e-5) and got[9] == pytest.approx(got[9])


def test_edges_of_charges(spark):
    none = spark.createDataFrame([], "scope_id long, node_id long, x double, y double")
    assert cells.charges(none).count() == 0
    with pytest.raises(ValueError, match="opening angle"):
        cells.charges(none, 1.5)


def test_charges_meet_in_tiles_and_each_pair_of_parts_once(spark, monkeypatch):
    monkeypatch.setattr(cells, "TILE", (5, 16))
    monkeypatch.setattr(cells, "PART", 40)
    ids, pos = placed(3, 130)
    x, y = pos.T
    left, right, same = cells.repulsion(x[:70], y[:70], x[70:], y[70:])
    both, _, own = cells.repulsion(x, y, x, y, own=True)
    assert same == [] and own == [(3, 4)]
    a, b, c = cells.repulsion(x[:70], y[:70], x[:70], y[:70], own=True), cells.repulsion(x[70:], y[70:], x[70:], y[70:], own=True), both
    assert np.concatenate([a[0] + left, b[0] + right]) == pytest.approx(c, abs=1e-9)
    got = {r["node_id"]: (r["fx"], r["fy"]) for r in cells.charges(frame(spark, {1: (ids, pos)}), 0).collect()}
    assert np.array([got[i] for i in ids]) == pytest.approx(pairwise(ids, pos, -180.0, 1.0), abs=1e-7)
