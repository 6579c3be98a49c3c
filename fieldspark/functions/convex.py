"""Many convex polygons at once, with NumPy: cut to each other, their areas, and areas of unions.

Polygons are an array of corners, counter-clockwise, by row; shorter rows repeat their last corner, and ``n`` has how many
count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Polygons of a group up to which unions are summed by their intersections.
MOST = 8


def rows(polygons: Sequence[tuple[Sequence[float], Sequence[float]] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Corners and how many of them of polygons as ``geometry.convex`` gives them; None has none."""
    n = np.array([len(p[0]) if p else 0 for p in polygons], int)
    out = np.zeros((len(n), max(1, n.max(initial=0)), 2))
    for k, p in enumerate(polygons):
        if p:
            out[k, : n[k], 0], out[k, : n[k], 1] = p
            out[k, n[k] :] = out[k, n[k] - 1]
    return out, n


def _halved(p: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of each row lies left of the line from a to b."""
    u = b - a
    side = u[:, :1] * (p[:, :, 1] - a[:, 1:]) - u[:, 1:] * (p[:, :, 0] - a[:, :1])
    own = np.arange(p.shape[1]) < n[:, None]
    inside = side >= 0
    if (inside | ~own).all():
        return p, n
    before = np.concatenate([side[:, -1:], side[:, :-1]], 1)
    crossed, kept = own & (inside != (before >= 0)), own & inside
    place = np.cumsum(crossed.astype(np.int32) + kept, 1) - 1
    many = place[:, -1] + 1
    out = np.zeros((len(p), max(1, many.max(initial=0)), 2))
    r, c = np.nonzero(crossed)
    from_ = p[r, c - 1]
    t = before[r, c] / (before[r, c] - side[r, c])
    out[r, place[r, c] - kept[r, c]] = from_ + t[:, None] * (p[r, c] - from_)
    r, c = np.nonzero(kept)
    out[r, place[r, c]] = p[r, c]
    last = out[np.arange(len(out)), np.maximum(many - 1, 0)]
    rest = np.arange(out.shape[1]) >= many[:, None]
    return np.where(rest[:, :, None], last[:, None], out), many


def clipped(p: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of p within the row of q beside it."""
    for k in range(q.shape[1]):
        p, n = _halved(p, n, q[:, k - 1], q[:, k])
    return p, n


def areas(p: np.ndarray) -> np.ndarray:
    d = p - p[:, :1]
    return np.abs((d[:, :-1, 0] * d[:, 1:, 1] - d[:, 1:, 0] * d[:, :-1, 1]).sum(1)) / 2


def boxes(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p.min(1), p.max(1)], 1)


def upright(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows are boxes: four corners, of which neighbours differ in one coordinate."""
    if p.shape[1] < 4:
        return np.zeros(len(p), bool)
    moved = p[:, :4] != p[:, [1, 2, 3, 0]]
    return (n == 4) & (moved[..., 0] ^ moved[..., 1]).all(1)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether boxes beside each other share an area."""
    return (a[:, 0] < b[:, 2]) & (b[:, 0] < a[:, 2]) & (a[:, 1] < b[:, 3]) & (b[:, 1] < a[:, 3])


def union_areas(p: np.ndarray, n: np.ndarray, q: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Area that the rows of one group cover together, by group (0 up, in order): ``p`` holds what is left of the group's
    polygon within each row of ``q``. A row adds its area, less what earlier rows of its group cover of it, and so on."""
    out = np.zeros(int(group[-1]) + 1 if len(group) else 0)
    first = np.searchsorted(group, group)
    box, row, sign = boxes(p), np.flatnonzero((n > 2) & (areas(p) > 0)), 1
    p, n = p[row], n[row]
    while len(row):
        np.add.at(out, group[row], sign * areas(p))
        many = row - first[row]
        at = np.repeat(np.arange(len(row)), many)
        other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[row][at]
        near = meet(boxes(p)[at], box[other])
        at, other = at[near], other[near]
        p, n = clipped(p[at], n[at], q[other])
        left = (n > 2) & (areas(p) > 0)
        p, n, row, sign = p[left], n[left], other[left], -sign
    return out
