"""Plane geometry on rings, with NumPy: measures, point tests, projections, areas of unions cut by a polygon.

A polygon is a list of rings, each a mapping or row with ``sign`` (1 outer, -1 hole), ``xs`` and ``ys``; rings may or
may not repeat their first point. Inside is what an odd number of rings encloses.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np

#: The GRS80 ellipsoid, and the equal-area conic of the conterminous United States (degrees).
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257222101
PARALLEL_1, PARALLEL_2, LATITUDE_0, LONGITUDE_0 = 29.5, 45.5, 23.0, -96.0
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _ring(ring) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = np.asarray(ring["xs"], float), np.asarray(ring["ys"], float)
    if len(xs) and (xs[0] != xs[-1] or ys[0] != ys[-1]):
        xs, ys = np.append(xs, xs[0]), np.append(ys, ys[0])
    return xs, ys


def edges(rings: Iterable) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of all rings, level ones left out."""
    parts = [np.stack([x[:-1], y[:-1], x[1:], y[1:]], 1) for x, y in map(_ring, rings) if len(x) > 1]
    out = np.concatenate(parts) if parts else np.zeros((0, 4))
    return out[out[:, 1] != out[:, 3]]


def measures(rings: Sequence) -> tuple[float, float, float]:
    """Area (holes taken off) and centroid of a polygon; NaN centroid without an area."""
    area = cx = cy = 0.0
    for ring in rings:
        x, y = _ring(ring)
        if len(x) < 4:
            continue
        x0, y0 = x[0], y[0]
        u, v = x - x0, y - y0
        cross = u[:-1] * v[1:] - u[1:] * v[:-1]
        a = cross.sum() / 2
        s = ring["sign"] * (1 if a >= 0 else -1)
        area += s * a
        cx += s * (((u[:-1] + u[1:]) * cross).sum() / 6 + a * x0)
        cy += s * (((v[:-1] + v[1:]) * cross).sum() / 6 + a * y0)
    return (area, cx / area, cy / area) if area > 0 else (0.0, math.nan, math.nan)


def bounds(rings: Sequence) -> tuple[float, float, float, float]:
    xs, ys = np.concatenate([np.asarray(r["xs"], float) for r in rings]), np.concatenate([np.asarray(r["ys"], float) for r in rings])
    return float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max())


def contains(edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie within, by crossings to the right; lower and left borders count as inside."""
    odd = np.zeros(np.shape(x), bool)
    for x1, y1, x2, y2 in edge:
        hit = (y1 <= y) != (y2 <= y)
        odd ^= hit & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))
    return odd


def inside_grid(edge: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """``contains`` for a grid of rising ``xs`` by any ``ys``: rows by columns. Each edge crosses a row once; a point is
    inside when an odd number of crossings lie to its right."""
    crossed = np.zeros((len(ys), len(xs) + 1), np.int32)
    rows = np.argsort(ys, kind="stable")
    low, high = np.minimum(edge[:, 1], edge[:, 3]), np.maximum(edge[:, 1], edge[:, 3])
    a, b = np.searchsorted(ys[rows], low, "left"), np.searchsorted(ys[rows], high, "left")
    which = np.repeat(np.arange(len(edge)), b - a)
    row = rows[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]]
    x1, y1, x2, y2 = edge[which].T
    at = x1 + (ys[row] - y1) * ((x2 - x1) / (y2 - y1))
    np.add.at(crossed, (row, np.searchsorted(xs, at, "left")), 1)
    return (crossed[:, ::-1].cumsum(1)[:, ::-1][:, 1:] % 2).astype(bool)


def _crossing_heights(edge: np.ndarray, once: bool = False) -> np.ndarray:
    """Heights at which two edges cross; ``once``: the first ones found will do.

    Edges are sorted by their lower end, and each meets only those that begin below its upper end, in blocks.
    """
    low, high = np.minimum(edge[:, 1], edge[:, 3]), np.maximum(edge[:, 1], edge[:, 3])
    order = np.argsort(low, kind="stable")
    edge, low, high = edge[order], low[order], high[order]
    x1, y1, x2, y2 = edge.T
    dx, dy = x2 - x1, y2 - y1
    end = np.searchsorted(low, high, "right")
    out = []
    step = max(1, 65_536 // max(1, len(edge)))
    for at in range(0, len(edge), step):
        rows = np.arange(at, min(len(edge), at + step))
        n = np.maximum(end[rows] - rows - 1, 0)
        b = np.repeat(rows, n)
        a = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + b + 1
        near = (np.minimum(x1[a], x2[a]) <= np.maximum(x1[b], x2[b])) & (np.maximum(x1[a], x2[a]) >= np.minimum(x1[b], x2[b]))
        a, b = a[near], b[near]
        den = dx[b] * dy[a] - dy[b] * dx[a]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x1[a] - x1[b]) * dy[a] - (y1[a] - y1[b]) * dx[a]) / den
            u = ((x1[a] - x1[b]) * dy[b] - (y1[a] - y1[b]) * dx[b]) / den
        ok = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append(y1[b][ok] + t[ok] * dy[b][ok])
        if once and ok.any():
            break
    return np.concatenate(out) if out else np.zeros(0)


def _spans(edge: np.ndarray, low: float, high: float) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Stretches inside a polygon at the middle of a slab: from, to, and the edges on either side."""
    mid = (low + high) / 2
    hit = edge[np.minimum(edge[:, 1], edge[:, 3]) <= low]
    hit = hit[np.maximum(hit[:, 1], hit[:, 3]) >= high]
    if not len(hit):
        return []
    x = hit[:, 0] + (mid - hit[:, 1]) * (hit[:, 2] - hit[:, 0]) / (hit[:, 3] - hit[:, 1])
    order = np.argsort(x, kind="stable")
    x, hit = x[order], hit[order]
    return [(x[k], x[k + 1], hit[k], hit[k + 1]) for k in range(0, len(x) - 1, 2)]


def _covered(field_edges: np.ndarray, pieces: Sequence[np.ndarray], whole: np.ndarray):
    """Slabs (low, high) and the stretches of the field that any piece covers in each."""
    low = max(field_edges[:, [1, 3]].min(), min(p[:, [1, 3]].min() for p in pieces))
    high = min(field_edges[:, [1, 3]].max(), max(p[:, [1, 3]].max() for p in pieces))
    whole = whole[(np.minimum(whole[:, 1], whole[:, 3]) < high) & (np.maximum(whole[:, 1], whole[:, 3]) > low)]
    heights = np.unique(np.concatenate([whole[:, 1], whole[:, 3], _crossing_heights(whole)]))
    heights = heights[(heights >= low) & (heights <= high)]
    for low, high in zip(heights[:-1], heights[1:]):
        own = _spans(field_edges, low, high)
        if not own or high - low <= 0:
            continue
        union: list[list] = []
        for a, b, left, right in sorted((s for p in pieces for s in _spans(p, low, high)), key=lambda s: s[:2]):
            if union and a <= union[-1][1]:
                if b > union[-1][1]:
                    union[-1][1], union[-1][3] = b, right
            else:
                union.append([a, b, left, right])
        for a, b, left, right in own:
            for c, d, l2, r2 in union:
                lo, hi = max(a, c), min(b, d)
                if hi > lo:
                    yield low, high, lo, hi, left if a >= c else l2, right if b <= d else r2


def convex(rings: Sequence) -> tuple[list[float], list[float]] | None:
    """Corners, counter-clockwise, of a polygon of one convex ring; None for others."""
    if len(rings) != 1:
        return None
    x, y = _ring(rings[0])
    if len(x) < 4:
        return None
    dx, dy = np.diff(x), np.diff(y)
    turn = dx * np.roll(dy, -1) - dy * np.roll(dx, -1)
    around = np.abs(np.arctan2(turn, dx * np.roll(dx, -1) + dy * np.roll(dy, -1)).sum())
    if not (abs(around - 2 * np.pi) < 1e-6 and ((turn >= 0).all() or (turn <= 0).all())):
        return None
    step = 1 if turn.sum() > 0 else -1
    return x[:-1][::step].tolist(), y[:-1][::step].tolist()


def _cut(ring, corners: tuple[list[float], list[float]]) -> list[tuple[float, float]]:
    """Corners of what is left of a ring within a convex polygon, cut along every side."""
    cx, cy = corners
    x, y = _ring(ring)
    points = list(zip(x[:-1].tolist(), y[:-1].tolist()))
    for k in range(len(cx)):
        ax, ay = cx[k - 1], cy[k - 1]
        ux, uy = cx[k] - ax, cy[k] - ay
        if not points:
            break
        out = []
        px, py = points[-1]
        before = ux * (py - ay) - uy * (px - ax)
        for qx, qy in points:
            side = ux * (qy - ay) - uy * (qx - ax)
            if (side >= 0) != (before >= 0):
                t = before / (before - side)
                out.append((px + t * (qx - px), py + t * (qy - py)))
            if side >= 0:
                out.append((qx, qy))
            px, py, before = qx, qy, side
        points = out
    return points


def clipped_area(field: Sequence, corners: tuple[list[float], list[float]]) -> float:
    """Area of a polygon within a convex one: each ring is cut, holes are taken off."""
    total = 0.0
    for ring in field:
        points, area = _cut(ring, corners), 0.0
        if points:
            ox, oy = points[0]
            for (px, py), (qx, qy) in zip(points, points[1:]):
                area += (px - ox) * (qy - oy) - (qx - ox) * (py - oy)
        total += ring["sign"] * abs(area) / 2
    return total


def apart(boxes: list[tuple[float, float, float, float]]) -> bool:
    """Whether no two boxes share an area; for few of them."""
    return len(boxes) <= 64 and not any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for k, a in enumerate(boxes) for b in boxes[:k])


def covered_area(field: Sequence, pieces: Sequence[Sequence]) -> float:
    """Area of ``field`` that the union of ``pieces`` covers; less than a billionth of the field counts as touching.

    Convex pieces that don't overlap cut the field side by side. Otherwise the plane is cut at the heights of all
    corners and crossings, so that within a slab no edges cross and the covered width at mid height times the slab's
    height is exact.
    """
    box = bounds(field) if len(field) else (0.0, 0.0, 0.0, 0.0)
    boxes = [bounds(p) for p in pieces if len(p)]
    near = [k for k, b in enumerate(boxes) if b[0] < box[2] and box[0] < b[2] and b[1] < box[3] and box[1] < b[3]]
    pieces = [p for p in pieces if len(p)]
    pieces, boxes = [pieces[k] for k in near], [boxes[k] for k in near]
    if not pieces:
        return 0.0
    if apart(boxes) and all(corners := [convex(p) for p in pieces]):
        area = sum(clipped_area(field, c) for c in corners)
    else:
        f, p = edges(field), [e for e in map(edges, pieces) if len(e)]
        if not len(f) or not p:
            return 0.0
        area = sum((high - low) * (hi - lo) for low, high, lo, hi, _, _ in _covered(f, p, np.concatenate([f, *p])))
    return float(area) if area > 1e-9 * measures(field)[0] else 0.0


def covered_pieces(field: Sequence, pieces: Sequence[Sequence]) -> list[dict]:
    """The covered part as disjoint rings: the convex pieces that a convex field is cut along, or trapezoids."""
    pieces = [p for p in pieces if len(p)]
    if pieces and convex(field) and apart([bounds(p) for p in pieces]) and all(corners := [convex(p) for p in pieces]):
        parts = [[*zip(*points)] for c in corners if len(points := _cut(field[0], c)) > 2]
        return [{"sign": 1, "xs": list(xs), "ys": list(ys)} for xs, ys in parts]
    f, p = edges(field), [e for e in map(edges, pieces) if len(e)]
    if not len(f) or not p:
        return []

    def at(edge: np.ndarray, y: float) -> float:
        return float(edge[0] + (y - edge[1]) * (edge[2] - edge[0]) / (edge[3] - edge[1]))

    out = []
    for low, high, _, _, left, right in _covered(f, p, np.concatenate([f, *p])):
        xs = [at(left, low), at(right, low), at(right, high), at(left, high)]
        out.append({"sign": 1, "xs": xs, "ys": [float(low), float(low), float(high), float(high)]})
    return out


def is_simple(rings: Sequence) -> bool:
    """Whether a polygon is valid: see ``validity.fault``."""
    from fieldspark.functions.validity import fault

    return fault(rings) is None


def _q(sin: np.ndarray) -> np.ndarray:
    es = _E * sin
    return (1 - _E2) * (sin / (1 - es * es) + np.arctanh(es) / _E)


def _conformal(lat: np.ndarray) -> np.ndarray:
    """Tangent of the conformal latitude of latitudes in radians; infinite at the poles."""
    t = np.tan(lat)
    s = _E * t / np.hypot(1, t)  # the sine times the eccentricity, never 1
    sigma = np.sinh(_E * np.arctanh(s))
    return t * np.hypot(1, sigma) - sigma * np.hypot(1, t)


def _conic() -> tuple[float, float, float]:
    p1, p2, p0 = (math.radians(p) for p in (PARALLEL_1, PARALLEL_2, LATITUDE_0))
    m1, m2 = (math.cos(p) / math.sqrt(1 - _E2 * math.sin(p) ** 2) for p in (p1, p2))
    q1, q2, q0 = (float(_q(np.array(math.sin(p)))) for p in (p1, p2, p0))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return n, c, SEMI_MAJOR * math.sqrt(c - n * q0) / n


def albers_forward(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to metres of the equal-area conic."""
    n, c, rho0 = _conic()
    rho = SEMI_MAJOR * np.sqrt(c - n * _q(np.sin(np.radians(lat)))) / n
    theta = n * np.radians(np.asarray(lon, float) - LONGITUDE_0)
    return rho * np.sin(theta), rho0 - rho * np.cos(theta)


def albers_inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres to degrees; the latitude by Newton steps on its authalic function."""
    n, c, rho0 = _conic()
    x, y = np.asarray(x, float), rho0 - np.asarray(y, float)
    q = (c - (np.hypot(x, y) * n / SEMI_MAJOR) ** 2) / n
    lat = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(12):
        s = np.sin(lat)
        es = 1 - _E2 * s * s
        lat = lat + es * es / (2 * np.cos(lat)) * (q - _q(s)) / (1 - _E2)
    return LONGITUDE_0 + np.degrees(np.arctan2(x, y)) / n, np.degrees(lat)


def _krueger() -> tuple[float, float]:
    """The third flattening and the radius of the rectifying sphere, scaled."""
    n = FLATTENING / (2 - FLATTENING)
    return n, 0.9996 * SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def utm_forward(lon: np.ndarray, lat: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to metres of a northern transverse Mercator zone, by Krueger's series to the fourth order."""
    n, radius = _krueger()
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    d = np.radians(np.asarray(lon, float) - (6 * zone - 183))
    t = _conformal(np.radians(np.asarray(lat, float)))
    xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(t, np.cos(d)))
    east, north = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        east, north = east + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta), north + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500_000 + radius * east, radius * north


def utm_inverse(x: np.ndarray, y: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Metres of a northern transverse Mercator zone to degrees: Krueger's inverse series to the fourth order, and Newton
    steps from the conformal to the geodetic latitude."""
    n, radius = _krueger()
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    north, east = np.asarray(y, float) / radius, (np.asarray(x, float) - 500_000) / radius
    xi, eta = north.copy(), east.copy()
    for j, b in enumerate(beta, 1):
        xi, eta = xi - b * np.sin(2 * j * north) * np.cosh(2 * j * east), eta - b * np.cos(2 * j * north) * np.sinh(2 * j * east)
    want = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    t = want / (1 - _E2)
    for _ in range(6):
        got = _conformal(np.arctan(t))
        t = t + (want - got) * (1 + (1 - _E2) * t * t) / ((1 - _E2) * np.hypot(1, t) * np.hypot(1, got))
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(np.arctan(t))


def densified(x: np.ndarray, y: np.ndarray, move, within: float, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """A closed ring's corners, with more of them where the image of an edge's middle is farther than ``within`` from the
    middle of its ends' images, so that straight edges stay where they are after ``move``."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    for _ in range(rounds):
        u, v = move(x, y)
        mx, my = (x + np.roll(x, -1)) / 2, (y + np.roll(y, -1)) / 2
        mu, mv = move(mx, my)
        far = np.hypot(mu - (u + np.roll(u, -1)) / 2, mv - (v + np.roll(v, -1)) / 2) > within
        if not far.any():
            break
        at = np.flatnonzero(far) + 1
        x, y = np.insert(x, at, mx[far]), np.insert(y, at, my[far])
    return x, y
