"""Polygons cut along a grid, regions of overlaps as directed edges, edges stitched into closed rings.

Rings get corners wherever they cross a grid line before they are cut, worked out once for each edge from its lesser end,
so neighbouring cells, and neighbouring polygons with an edge in common, have the same corners on their common line. A
region's edges have it on their left; at every point as many edges end as begin, whatever rounding does, so they close.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np

from fieldspark.functions.geometry import _crossing_heights, _ring

Point = tuple[float, float]
Edge = tuple[float, float, float, float]
#: Of a cell's side: how near to a line a corner counts as on it.
NEAR = 1e-9
#: Edges across a slab from which arrays sort them.
MANY = 24


def _crossings(p: Point, q: Point, axis: int, size: float) -> list[tuple[float, Point]]:
    """Where the edge from p to q, p < q, crosses the lines of one axis, with the part of the way."""
    a, b = p[axis], q[axis]
    lo, hi = math.floor(min(a, b) / size) + 1, math.ceil(max(a, b) / size) - 1
    out = []
    for k in range(lo, hi + 1):
        line = k * size
        if not min(a, b) < line < max(a, b):
            continue
        t = (line - a) / (b - a)
        other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
        near = round(other / size) * size
        other = near if abs(other - near) < NEAR * size else other
        out.append((t, (line, other) if axis == 0 else (other, line)))
    return out


def noded(points: Sequence[Point], size: float) -> list[Point]:
    """The ring with a corner at each crossing of a line of the grid."""
    out: list[Point] = []
    for a, b in zip(points, [*points[1:], points[0]]):
        p, q = (a, b) if a <= b else (b, a)
        between = [x for _, x in sorted(_crossings(p, q, 0, size) + _crossings(p, q, 1, size))]
        for x in [a, *(between if a <= b else reversed(between))]:
            if not out or out[-1] != x:
                out.append(x)
    return out


def _half(points: list[Point], axis: int, line: float, low: bool) -> list[Point]:
    """What lies on one side of a line; none if that has no area."""
    sign = 1 if low else -1
    side = [sign * (line - p[axis]) for p in points]
    if max(side, default=0) <= 0:
        return []
    if min(side) >= 0:
        return points
    out = []
    for k, p in enumerate(points):
        before = side[k - 1]
        if (before > 0 > side[k]) or (before < 0 < side[k]):
            q = points[k - 1]
            t = before / (before - side[k])
            other = q[1 - axis] + t * (p[1 - axis] - q[1 - axis])
            out.append((line, other) if axis == 0 else (other, line))
        if side[k] >= 0:
            out.append(p)
    return out


def split(rings: Sequence, size: float) -> Iterator[tuple[int, int, list[dict]]]:
    """(column, row, rings) of the polygon within each cell of the grid that it has an area in."""
    parts = []
    for ring in rings:
        x, y = _ring(ring)
        if len(x) > 3:
            parts.append((ring["sign"], list(zip(x[:-1].tolist(), y[:-1].tolist()))))
    if not parts:
        return

    def span(parts: list, axis: int) -> tuple[int, int]:
        values = [p[axis] for _, points in parts for p in points]
        lo = math.floor(min(values) / size)
        return lo, max(lo + 1, math.ceil(max(values) / size))

    spans = [span(parts, 0), span(parts, 1)]
    if any(b - a > 1 for a, b in spans):
        parts = [(s, noded(points, size)) for s, points in parts]
    todo = [(parts, *spans[0], *spans[1])]
    while todo:
        parts, a, b, c, d = todo.pop()
        if b - a <= 1 and d - c <= 1:
            yield a, c, [{"sign": s, "xs": [p[0] for p in points], "ys": [p[1] for p in points]} for s, points in parts]
            continue
        axis = 0 if b - a >= d - c else 1
        lo, hi = (a, b) if axis == 0 else (c, d)
        m = (lo + hi) // 2
        for low in (True, False):
            kept = [(s, got) for s, points in parts if len(got := _half(points, axis, m * size, low)) > 2]
            if kept:
                x, y = (lo, m) if low else (m, hi)
                todo.append((kept, x, y, c, d) if axis == 0 else (kept, a, b, x, y))


def _edges(polygons: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the lower end first, level ones left out, and their polygon's number."""
    rows, owner = [], []
    for k, rings in enumerate(polygons):
        for ring in rings:
            x, y = _ring(ring)
            if len(x) < 4:
                continue
            e = np.stack([x[:-1], y[:-1], x[1:], y[1:]], 1)
            e = e[e[:, 1] != e[:, 3]]
            down = e[:, 1] > e[:, 3]
            e[down] = e[down][:, [2, 3, 0, 1]]
            rows.append(e)
            owner.append(np.full(len(e), k))
    return (np.concatenate(rows), np.concatenate(owner)) if rows else (np.zeros((0, 4)), np.zeros(0, int))


def _x(edge: Sequence[float], y: float) -> float:
    x1, y1, x2, y2 = edge
    return x1 if y == y1 else x2 if y == y2 else x1 + (y - y1) * ((x2 - x1) / (y2 - y1))


def slabs(sides: Sequence[Sequence[Sequence]]) -> Iterator[tuple[float, float, list[tuple[int, int]], list]]:
    """(low, high, pairs of left and right edges, edges): stretches inside some polygon of every side, between all heights
    of corners and crossings, so that within a slab no edges cross."""
    polygons = [rings for side in sides for rings in side]
    of_side = [k for k, side in enumerate(sides) for _ in side]
    edges, owner = _edges(polygons)
    if not len(edges):
        return
    heights = np.unique(np.concatenate([edges[:, 1], edges[:, 3], _crossing_heights(edges)]))
    order = np.argsort(edges[:, 1], kind="stable")
    starts, listed, owners = edges[order, 1].tolist(), edges.tolist(), owner.tolist()
    x1, y1 = edges[:, 0], edges[:, 1]
    slope = (edges[:, 2] - x1) / (edges[:, 3] - y1)
    active: list[int] = []
    at = 0
    for low, high in zip(heights[:-1].tolist(), heights[1:].tolist()):
        while at < len(order) and starts[at] <= low:
            active.append(int(order[at]))
            at += 1
        active = [e for e in active if listed[e][3] >= high]
        mid = (low + high) / 2
        inside, counts, pairs, left = set(), [0] * len(sides), [], None
        if len(active) > MANY:
            own = np.array(active)
            across = own[np.lexsort((own, x1[own] + (mid - y1[own]) * slope[own]))].tolist()
        else:
            across = [e for _, e in sorted((_x(listed[e], mid), e) for e in active)]
        for e in across:
            k = owners[e]
            was = all(counts)
            if k in inside:
                inside.discard(k)
                counts[of_side[k]] -= 1
            else:
                inside.add(k)
                counts[of_side[k]] += 1
            now = all(counts)
            if now and not was:
                left = e
            elif was and not now:
                pairs.append((left, e))
        yield low, high, pairs, listed


def overlap_area(sides: Sequence[Sequence[Sequence]]) -> float:
    """Area inside some polygon of every side."""
    return sum((high - low) * ((_x(e[r], low) - _x(e[l], low)) + (_x(e[r], high) - _x(e[l], high))) / 2 for low, high, pairs, e in slabs(sides) for l, r in pairs)


def _level(events: list[tuple[float, int]], y: float) -> Iterator[Edge]:
    """Level edges at a height: west where the region is below only, east where it is above only."""
    count, before = 0, None
    for x, d in sorted(events):
        if count and x > before:
            for _ in range(abs(count)):
                yield (x, y, before, y) if count > 0 else (before, y, x, y)
        count += d
        before = x


def region_edges(sides: Sequence[Sequence[Sequence]]) -> list[Edge]:
    """Directed edges around what is inside some polygon of every side. Along one polygon's edge there is one."""
    out: list[Edge] = []
    runs: dict[tuple[int, int], list[float]] = {}
    events: list[tuple[float, int]] = []
    top, listed = None, []

    def close(key: tuple[int, int]) -> None:
        (e, up), (low, high) = key, runs.pop(key)
        a, b = (_x(listed[e], low), low), (_x(listed[e], high), high)
        out.append((*a, *b) if up else (*b, *a))

    for low, high, pairs, listed in slabs(sides):
        if top is not None and top != low:
            out.extend(_level(events, top))
            events = []
        for l, r in pairs:
            events += [(_x(listed[l], low), -1), (_x(listed[r], low), 1)]
        out.extend(_level(events, low))
        events, top = [], high
        for l, r in pairs:
            events += [(_x(listed[l], high), 1), (_x(listed[r], high), -1)]
        now = {(e, up) for pair in pairs for e, up in zip(pair, (0, 1))}
        for key in [k for k in runs if k not in now or runs[k][1] != low]:
            close(key)
        for key in now:
            runs[key] = [runs[key][0], high] if key in runs else [low, high]
    if top is not None:
        out.extend(_level(events, top))
    for key in list(runs):
        close(key)
    return out


def box_edges(boxes: Sequence[Sequence[float]]) -> list[Edge]:
    """Directed edges around what upright boxes (x0, y0, x1, y1) cover together, cut at all their corners' lines."""
    xs, ys = sorted({b[k] for b in boxes for k in (0, 2)}), sorted({b[k] for b in boxes for k in (1, 3)})
    column, row = {x: k for k, x in enumerate(xs)}, {y: k for k, y in enumerate(ys)}
    full = {(i, j) for x0, y0, x1, y1 in boxes for i in range(column[x0], column[x1]) for j in range(row[y0], row[y1])}
    out: list[Edge] = []
    for i, j in full:
        x0, y0, x1, y1 = xs[i], ys[j], xs[i + 1], ys[j + 1]
        if (i, j - 1) not in full:
            out.append((x0, y0, x1, y0))
        if (i + 1, j) not in full:
            out.append((x1, y0, x1, y1))
        if (i, j + 1) not in full:
            out.append((x1, y1, x0, y1))
        if (i - 1, j) not in full:
            out.append((x0, y1, x0, y0))
    return out


def seam_rest(edges: Sequence[Edge], axis: int) -> list[Edge]:
    """Of edges on one line, up it and down it from the cells on either side, those that have no other against them."""
    events: list[tuple[float, int]] = []
    for e in edges:
        a, b = e[1 - axis], e[3 - axis]
        events += [(min(a, b), 1 if b > a else -1), (max(a, b), -1 if b > a else 1)]
    line, out = edges[0][axis], []
    for x1, y1, x2, _ in _level(events, line):  # a count above 0 is west there, and means up here
        a, b = x2, x1
        out += [(line, a, line, b) if axis == 0 else (a, line, b, line)]
    return out


def stitched(edges: Sequence[Edge], near: float = 1e-9) -> list[dict]:
    """Closed rings of directed edges, the region on their left: sign 1 around it, -1 around a hole.

    Where several edges leave a corner, the leftmost is taken, so rings touch there and do not cross. Corners on a straight
    line between their neighbours, and within ``near`` times the extent of them, are left out.
    """
    count: Counter = Counter()
    for e in edges:
        a, b = e[:2], e[2:]
        if a != b:
            if count[b, a] > 0:
                count[b, a] -= 1
            else:
                count[a, b] += 1
    leaving: dict[Point, list[Point]] = {}
    for (a, b), n in count.items():
        if n > 0:
            leaving.setdefault(a, []).extend([b] * n)
    if not leaving:
        return []
    xs, ys = zip(*leaving)
    tiny = near * max(max(xs) - min(xs), max(ys) - min(ys))
    rings = []
    for start in list(leaving):
        while leaving.get(start):
            ring, at, came = [start], start, None
            while True:
                ways = leaving[at]
                k = 0
                if came is not None and len(ways) > 1:
                    back = math.atan2(came[1] - at[1], came[0] - at[0])
                    k = min(range(len(ways)), key=lambda i: (back - math.atan2(ways[i][1] - at[1], ways[i][0] - at[0])) % (2 * math.pi) or 2 * math.pi)
                came, at = at, ways.pop(k)
                if at == start:
                    break
                ring.append(at)
            ring = _plain(ring, tiny)
            if len(ring) > 2:
                area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip([(x - ring[0][0], y - ring[0][1]) for x, y in ring], [(x - ring[0][0], y - ring[0][1]) for x, y in [*ring[1:], ring[0]]])) / 2
                if abs(area) > tiny * tiny:
                    rings.append({"sign": 1 if area > 0 else -1, "xs": [p[0] for p in ring], "ys": [p[1] for p in ring]})
    return rings


def rings_of(polygons: Sequence[list[Point]], near: float = 1e-9) -> list[dict]:
    """Rings of polygons that lie apart, counter-clockwise, as ``stitched`` has them."""
    out = []
    for points in polygons:
        xs, ys = zip(*points)
        ring = _plain(points, near * max(max(xs) - min(xs), max(ys) - min(ys)))
        if len(ring) > 2:
            out.append({"sign": 1, "xs": [p[0] for p in ring], "ys": [p[1] for p in ring]})
    return out


def _plain(ring: list[Point], tiny: float) -> list[Point]:
    """The ring without corners that tell nothing."""
    out: list[Point] = []
    for p in ring:
        if not out or math.dist(out[-1], p) > tiny:
            out.append(p)
    while len(out) > 1 and math.dist(out[-1], out[0]) <= tiny:
        out.pop()
    kept: list[Point] = []
    for k, p in enumerate(out):
        a, b = kept[-1] if kept else out[k - 1], out[(k + 1) % len(out)]
        wide = math.dist(a, b)
        if wide <= tiny or abs((p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])) > tiny * wide or (p[0] - a[0]) * (b[0] - p[0]) + (p[1] - a[1]) * (b[1] - p[1]) < 0:
            kept.append(p)
    return kept
