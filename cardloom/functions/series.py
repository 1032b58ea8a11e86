"""Sums over all pairs of many points in a plane, to the precision of doubles, in time that grows like n log n.

Points are complex numbers; what w does to z at a distance from 1 is 1 / (z - w).  Medians cut the points into groups, each into four
smaller ones.  Two groups that lie far apart for their size meet by power series, in both directions; a series is cut where its
remainder is below `ERROR` of each pair's share, which is less than the rounding of a plain sum.  The smallest groups that lie nearer are met
point by point.
"""

from __future__ import annotations

import math

import numpy as np

#: Radii of two groups over the distance of their middles, at most, when they meet by series; what a series leaves out, at most.
REACH, ERROR = 0.5, 4e-15
#: Points of the smallest groups, at most.
LEAF = 48
#: Pairs of groups whose series, and pairs of points whose distances are held at a time.
BATCH, TILE = 1024, 16384

_TERMS = 1 + math.ceil(math.log(ERROR * (1 - REACH)) / math.log(REACH))
_BINOMIALS = np.array([[math.comb(k + m, k) for m in range(_TERMS)] for k in range(_TERMS)], dtype=float)
_KIDS = np.array([(i, j) for i in range(4) for j in range(4)]).T


def _grouped(z: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The points' indices, put into 2 ** depth groups of one size one after the other, and their weights: to fill the groups some come twice, with weight 0."""
    size = -(-len(z) // 2**depth) << depth
    index = np.concatenate([np.arange(len(z)), np.linspace(0, len(z) - 1, size - len(z)).astype(int)])
    x, y, order = z.real[index], z.imag[index], np.arange(size)[None]
    for _ in range(depth):
        a, b, half = x[order], y[order], order.shape[1] // 2
        along = np.where((np.ptp(a, axis=1) >= np.ptp(b, axis=1))[:, None], a, b)
        order = np.take_along_axis(order, np.argpartition(along, half, axis=1), axis=1).reshape(-1, half)
    order = order.ravel()
    return index[order], (order < len(z)).astype(float)


def _powers(step: np.ndarray, terms: int) -> np.ndarray:
    out = np.empty((terms, len(step)), complex)
    out[0] = 1
    for k in range(1, terms):
        np.multiply(out[k - 1], step, out=out[k])
    return out


def _far(own: np.ndarray, middle: np.ndarray, radius: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The series around each group of what the others do to it, of pairs a, b of groups and the series of the groups' own points."""
    into = np.zeros_like(own)
    ratio = (radius[a] + radius[b]) / np.abs(middle[b] - middle[a])
    order = np.argsort(ratio)
    for lo in range(0, len(a), BATCH):
        at = order[lo : lo + BATCH]
        worst = max(ratio[at[-1]], 1e-9)
        terms = min(_TERMS, 1 + math.ceil(math.log(ERROR * (1 - worst)) / math.log(worst)))
        i, j = a[at], b[at]
        away = 1 / (middle[j] - middle[i])
        u, v = _powers(radius[i] * away, terms), _powers(-radius[j] * away, terms)
        for g, h, s, t, d in ((i, j, u, v, away), (j, i, v, u, -away)):
            met = own[:terms].take(g, axis=1)
            met *= s
            met = (_BINOMIALS[:terms, :terms] @ met.view(float)).view(complex)
            met *= t
            met *= d
            for row, more in zip(into, met, strict=False):
                np.add.at(row, h, more)
    return into


def _near(x: np.ndarray, y: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What points of groups (rows of x and y) do to each other, of pairs a <= b of groups, point by point; nearer than 1 they count as at 1."""
    out, m = np.zeros((2, *x.shape)), x.shape[1]
    order, most = np.lexsort((b, a)), max(1, TILE // (m * m))
    b, starts, room, one = b[order], np.searchsorted(a[order], np.arange(len(x) + 1)), np.empty((4, most * m * m)), np.ones(most * m * m)
    for g in range(len(x)):
        for lo in range(starts[g], starts[g + 1], most):
            to = b[lo : min(lo + most, starts[g + 1])]
            dx, dy, f, s = (r[: len(to) * m * m].reshape(m, -1) for r in room)
            np.subtract(x[g, :, None], x[to].ravel(), out=dx)
            np.subtract(y[g, :, None], y[to].ravel(), out=dy)
            np.square(dx, out=f)
            np.square(dy, out=s)
            f += s
            np.maximum(f, one[: f.size].reshape(f.shape), out=f)
            w, other = weight[to].ravel(), int(to[0] == g)
            for k, d in enumerate((dx, dy)):
                d /= f
                out[k, g] += d @ w
                out[k, to[other:]] -= (weight[g] @ d).reshape(-1, m)[other:]
    return (out[0] - 1j * out[1]).ravel()


def inverse_distances(z: np.ndarray) -> np.ndarray:
    """For each point the sum of 1 / (z - w) over the others, nearer than 1 as conj(z - w); points in the same place do nothing to each other."""
    depth = max(0, math.ceil(math.log2(max(len(z), 1) / LEAF)))
    index, weight = _grouped(z, depth)
    p, total = z[index], np.zeros(len(index), complex)
    a, b = (np.zeros(1, int),) * 2 if depth % 2 == 0 else (np.array([0, 0, 1]), np.array([0, 1, 1]))
    for level in range(depth % 2, depth + 1, 2):
        groups = p.reshape(2**level, -1)
        x, y = groups.real, groups.imag
        middle = (x.min(1) + x.max(1) + 1j * (y.min(1) + y.max(1))) / 2
        off = groups - middle[:, None]
        radius = np.abs(off).max(1)
        gap, both = np.abs(middle[b] - middle[a]), radius[a] + radius[b]
        far = (both <= REACH * gap) & (gap - both >= 1)
        if far.any():
            radius = np.maximum(radius, 1e-9)  # one place
            off /= radius[:, None]
            own, power = np.empty((_TERMS, len(groups)), complex), weight.reshape(off.shape).astype(complex)
            for k in range(_TERMS):
                own[k] = power.sum(1)
                power *= off
            series = _far(own, middle, radius, a[far], b[far])
            power[:] = 0
            for k in reversed(range(_TERMS)):
                power *= off
                power += series[k][:, None]
            total += power.ravel()
        a, b = a[~far], b[~far]
        if level < depth:
            a, b = ((4 * g[:, None] + k).ravel() for g, k in zip((a, b), _KIDS, strict=True))
            a, b = a[a <= b], b[a <= b]
    total += _near(p.real.reshape(2**depth, -1), p.imag.reshape(2**depth, -1), weight.reshape(2**depth, -1), a, b)
    out = np.empty_like(z)
    out[index[weight > 0]] = total[weight > 0]
    return out
