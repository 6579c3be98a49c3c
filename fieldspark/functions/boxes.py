"""Many upright boxes at once, with NumPy: areas and outlines of what the boxes of each group cover together.

Boxes are four arrays (x0, y0, x1, y1), group by group, ``start`` has the first box of each group. A group's distinct
coordinates make a small grid, whose cells are covered or not; groups of as many boxes are worked out together, the group
as the last axis.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Boxes of a group at most; more are for the sweep.
MOST = 64
#: Lines of a grid's axis, to which groups are rounded up, and cells of the grids worked out together.
LINES, CELLS = (4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 2 * MOST), 1_000_000
Boxes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Rings(NamedTuple):
    """Rings in order of their groups: group, sign (1 outer, -1 hole), area, first corner of each and of none, corners."""

    group: np.ndarray
    sign: np.ndarray
    area: np.ndarray
    first: np.ndarray
    xs: np.ndarray
    ys: np.ndarray


def of_groups(chosen: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n boxes are the chosen groups', and where among these each group starts."""
    many = np.diff(np.append(start, n))
    own = many[chosen]
    return np.flatnonzero(np.repeat(chosen, many)), np.cumsum(own) - own


def _ranked(low: np.ndarray, high: np.ndarray, tiny: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of boxes by groups: numbers of their two ends among their group's distinct ones, how many these are, and the distinct
    ones. What is no more than ``tiny`` apart is one."""
    ends, n = np.concatenate([low, high]), low.shape[1]
    rank = np.zeros(ends.shape, np.int16)
    for a, own in enumerate(ends - tiny):
        for b, other in enumerate(ends):
            if a != b:
                rank[a] += other < own
    group = np.arange(n)
    place = rank * np.int64(n) + group
    number = np.zeros(ends.shape, np.int16)
    number.ravel()[place] = 1
    for k in range(1, len(ends)):
        number[k] += number[k - 1]
    rank = number.ravel()[place] - 1
    lines = np.zeros(ends.shape)
    lines.ravel()[rank * np.int64(n) + group] = ends
    return rank[: len(low)], rank[len(low) :], number[-1], lines


def _grids(box: Boxes, start: np.ndarray, least: int, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, covered cells, x and y of lines) of groups of ``least`` boxes or more: cells are column by row by group, from
    1 on, with empty ones around. What is no more than ``near`` times a group's extent apart is one line."""
    many = np.diff(np.append(start, len(box[0])))
    for k in np.unique(many[many >= least]).tolist():
        of_size = np.flatnonzero(many == k)
        x0, y0, x1, y1 = (b[start[of_size] + np.arange(k)[:, None]] for b in box)
        tiny = near * np.maximum(x1.max(0) - x0.min(0), y1.max(0) - y0.min(0))
        c0, c1, nx, xs = _ranked(x0, x1, tiny)
        r0, r1, ny, ys = _ranked(y0, y1, tiny)
        lines = np.array(LINES)[np.searchsorted(LINES, np.maximum(nx, ny))]
        for s in np.unique(lines).tolist():
            alike, w = np.flatnonzero(lines == s), s + 1
            for at in range(0, len(alike), CELLS // (w * w)):
                g = alike[at : at + CELLS // (w * w)]
                own = np.arange(len(g))
                a0, a1, b0, b1 = ((c[:, g] + 1) * np.int64(f * len(g)) for c, f in ((c0, w), (c1, w), (r0, 1), (r1, 1)))
                full = np.zeros(w * w * len(g), np.int8)
                for c, r, d in ((a0, b0 + own, 1), (a1, b1 + own, 1), (a0, b1 + own, -1), (a1, b0 + own, -1)):
                    np.add.at(full, (c + r).ravel(), np.int8(d))
                full = full.reshape(w, w, len(g))
                for c in range(1, w):
                    full[c] += full[c - 1]
                for r in range(1, w):
                    full[:, r] += full[:, r - 1]
                yield of_size[g], full > 0, xs[:s, g], ys[:s, g]


def union_areas(box: Boxes, start: np.ndarray) -> np.ndarray:
    """Area that each group's boxes cover together; no group is larger than ``MOST``."""
    n = len(box[0])
    out = np.zeros(len(start))
    many = np.diff(np.append(start, n))
    one = start[many == 1]
    out[many == 1] = (box[2][one] - box[0][one]) * (box[3][one] - box[1][one])
    two = start[many == 2]
    p, q = [b[two] for b in box], [b[two + 1] for b in box]
    shared = np.maximum(np.minimum(p[2], q[2]) - np.maximum(p[0], q[0]), 0) * np.maximum(np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]), 0)
    out[many == 2] = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - shared
    for g, full, x, y in _grids(box, start, 3, 0.0):
        s, high = len(x), np.diff(y, axis=0)
        across = np.stack([(high * full[c, 1 : len(high) + 1]).sum(0) for c in range(1, s)])
        out[g] = (np.diff(x, axis=0) * across).sum(0)
    return out


def _walked(after: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges with the one after each: number of its ring and how many edges it lies behind the first one; groups of rings.
    A ring of each of n groups is walked around at once, then another."""
    ring, behind, groups, rings = np.full(len(after), -1), np.empty(len(after), np.int64), [], 0
    left = np.arange(len(after))
    while len(left):
        first = np.full(n, -1)
        first[group[left]] = left
        root = first[first >= 0]
        own = np.arange(rings, rings + len(root))
        groups.append(group[root])
        rings, at, k = rings + len(root), root, 0
        while len(at):
            ring[at], behind[at] = own, k
            at, k = after[at], k + 1
            on = at != root
            if not on.all():
                at, own, root = at[on], own[on], root[on]
        left = left[ring[left] < 0]
    return ring, behind, np.concatenate(groups) if groups else np.zeros(0, np.int64)


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places along the first axis where runs begin and end: of each run the place on the other axes, the first and the
    last one."""
    since, found = np.zeros(start[0].size, np.int64), ([], [], [])
    for k in range(len(start)):
        over = np.flatnonzero(end[k])
        for own, x in zip(found, (over, since[over], np.full(len(over), k))):
            own.append(x)
        since[np.flatnonzero(start[k])] = k
    return tuple(np.concatenate(x) for x in found)


def _traced(full: np.ndarray, x: np.ndarray, y: np.ndarray) -> Rings:
    """Rings around the covered cells of grids, the covered side on their left: level edges begin and end at corners, upright
    ones lead from each to the next. Where cells touch at a corner only, rings turn left, and so touch there too. Corners are
    numbered by column, row and group."""
    s, n = len(full) - 1, full.shape[2]
    empty = ~full
    above, below, left, right = full[:, 1:] & empty[:, :-1], full[:, :-1] & empty[:, 1:], full[:-1] & empty[1:], full[1:] & empty[:-1]
    ahead = lambda m: m[1:] & ~m[:-1]
    back = lambda m: m[:-1] & ~m[1:]
    flip = lambda m: m.swapaxes(0, 1)
    east, west, north, south = ahead(above), back(below), flip(ahead(flip(left))), flip(back(flip(right)))
    (e, e0, e1), (w, w1, w0) = _runs(east, back(above)), _runs(ahead(below), west)
    (u, u0, u1), (d, d1, d0) = _runs(flip(north), back(flip(left))), _runs(ahead(flip(right)), flip(south))
    to_north, to_south, of_east, of_west = (np.empty(s * s * n, np.int64) for _ in range(4))
    column = (np.arange(s)[:, None] * (s * n) + np.arange(n)).ravel()  # of upright runs' places, which are column and group
    to_north[column[u] + u0 * n], to_south[column[d] + d0 * n] = column[u] + u1 * n, column[d] + d1 * n
    of_east[e0 * (s * n) + e], of_west[w0 * (s * n) + w] = np.arange(len(e)), np.arange(len(e), len(e) + len(w))
    east, west, north, south = (np.ascontiguousarray(m).ravel() for m in (east, west, north, south))
    end = np.concatenate([e1 * (s * n) + e, w1 * (s * n) + w])
    up = np.concatenate([north[end[: len(e)]], ~south[end[len(e) :]]])
    then = np.where(up, to_north[end], to_south[end])
    after = np.where(np.where(up, west[then], ~east[then]), of_west[then], of_east[then])
    line = np.concatenate([e, w])  # row and group
    group = np.tile(np.arange(n), s)[line]
    ring, behind, of_group = _walked(after, group, n)
    xa, xb, at = x.ravel()[np.concatenate([e0, w0]) * n + group], x.ravel()[np.concatenate([e1, w1]) * n + group], y.ravel()[line]
    order = np.argsort(of_group, kind="stable")
    area = np.bincount(ring, (xa - xb) * (at - y[0, group]), len(order))[order]
    offset = np.concatenate([[0], 2 * np.cumsum(np.bincount(ring, minlength=len(order))[order])])
    place = np.empty(len(order), np.int64)
    place[order] = offset[:-1]
    place = place[ring] + 2 * behind
    xs, ys = np.empty(offset[-1]), np.empty(offset[-1])
    xs[place], xs[place + 1], ys[place], ys[place + 1] = xa, xb, at, at
    return Rings(of_group[order], np.where(area > 0, 1, -1).astype(np.int32), np.abs(area), offset, xs, ys)


def outlines(box: Boxes, start: np.ndarray, near: float = 1e-9) -> Iterator[tuple[np.ndarray, Rings]]:
    """(groups, rings around what each of them covers, by number among these groups). What is no more than ``near`` times a
    group's extent apart is one line; boxes no wider than that are left out. No group is larger than ``MOST``."""
    x0, y0, x1, y1 = box
    many = np.diff(np.append(start, len(x0)))
    one = np.flatnonzero(many == 1)
    x0, y0, x1, y1 = (b[start[one]] for b in box)
    w, h = x1 - x0, y1 - y0
    good = np.minimum(w, h) > near * np.maximum(w, h)
    x0, y0, x1, y1 = (b[good] for b in (x0, y0, x1, y1))
    if len(x0):
        yield one[good], Rings(np.arange(len(x0)), np.ones(len(x0), np.int32), (w * h)[good], np.arange(0, 4 * len(x0) + 1, 4), np.stack([x0, x1, x1, x0], 1).ravel(), np.stack([y0, y0, y1, y1], 1).ravel())
    for g, full, x, y in _grids(box, start, 2, near):
        yield g, _traced(full, x, y)
