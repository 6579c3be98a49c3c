"""Exact cosine near-duplicates by dual traversal of cover trees.

Distances are angles between unit vectors, a metric. Farthest-first centres of a bounded sample deal all vectors of a
length to cells, large cells to several chunks. Each chunk's cover tree is built once: nested levels of centres whose
radii halve, every vector below a centre, every node with its covering radius. A chunk goes to the chunks whose cells
are close enough, and two trees are traversed together, level by level: a pair of nodes is pruned when its centres are
further apart than both covering radii and the threshold, is linked whole when even its farthest vectors are within
the threshold, and else is followed to its children, down to single vectors, whose cosine decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldspark.llm.common import components, lean_worker, written

#: Least cosine of a link.
COSINE = 0.95
#: Vectors in a chunk, about; most cells; vectors that the centres are chosen from, about.
CHUNK, CELLS, SAMPLE = 4096, 4096, 32_768
#: Radius of a tree's first level; levels halve it until a quarter of the threshold's angle.
TOP = 1.6
#: Pairs of nodes that are looked at together, and from how many children's pairs a product of matrices is quicker.
BLOCK, DENSE = 1 << 21, 2048
#: Angles are rounded outwards by this much before anything is pruned; single-precision screening leaves this much.
SLACK, COARSE = 1e-6, 1e-4
NODES = "sig binary, raw binary, m long, d int"
TREES = "chunk int, cell int, sigs array<binary>, raw binary, weights array<long>, starts array<array<int>>, centres array<array<int>>, radii array<array<double>>"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def radii(reach: float) -> list[float]:
    """Radii of a tree's levels for links within ``reach``."""
    out = [TOP]
    while out[-1] > max(reach / 4, 1e-6):
        out.append(out[-1] / 2)
    return out


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Places of up to ``most`` centres; each next one is the row farthest from those before, so that every prefix is a
    net of its own covering radius."""
    centres = [0]
    near = x @ x[0]
    while len(centres) < most:
        far = int(near.argmin())
        if near[far] >= 1 - 1e-9:
            break
        np.maximum(near, x @ x[far], out=near)
        centres.append(far)
    return np.array(centres)


@dataclass
class Level:
    starts: np.ndarray  #: first vector of each node, and the end of the last
    centre: np.ndarray  #: place of each node's centre
    radius: np.ndarray  #: covering radius: the largest angle from the centre to a vector below it

    def children(self, below: Level) -> np.ndarray:
        """First child of each node in the level below, and the end of the last node's."""
        return np.searchsorted(below.starts, self.starts)


@dataclass
class Tree:
    x: np.ndarray  #: unit vectors in tree order, so that each node's are neighbours
    weights: np.ndarray
    levels: list[Level]  #: the last one has each vector as a node

    def __post_init__(self) -> None:
        n = len(self.x)
        self.levels = [*self.levels, Level(np.arange(n + 1), np.arange(n), np.zeros(n))]
        self.children = [a.children(b) for a, b in zip(self.levels, self.levels[1:])]
        self.single = self.x.astype(np.float32)
        self.sums = [np.add.reduceat(self.weights, l.starts[:-1]) for l in self.levels]


def build(x: np.ndarray, reach: float) -> tuple[np.ndarray, list[Level], int]:
    """Order of the rows of ``x`` (at least one), the levels of their cover tree over that order, and the number of pairs
    that were compared.

    Nested: a level has the centres of the level above. Separated: its centres are further apart than its radius.
    Covering: each has a parent, the nearest centre above, within that level's radius, as each row has below the last.

    A new centre p below a centre c can only be the nearest one of rows below centres c' that are no further from c than
    c's covering radius and twice that of c', so it is compared with these rows alone.
    """
    n, x32, looked = len(x), x.astype(np.float32), 0
    best, label = np.full(n, -2, np.float32), np.zeros(n, np.int64)  # nearest centre so far
    found: list[int] = []
    parents = []
    live, live_x, listed = np.arange(n), x32, 0  # rows that were no centres when there were ``listed``
    for r in radii(reach):
        least, above, had = np.float32(np.cos(r)), label.copy(), len(found)
        todo = np.flatnonzero(best < least)
        close = None
        if len(todo) and had > 1:
            cover = np.zeros(had)
            np.maximum.at(cover, above, np.where(best > 1, 0.0, angle(best.astype(np.float64)) + 1e-3))
            centres = x32[found]
            looked += had * (had - 1) // 2
            close = angle((centres @ centres.T).astype(np.float64)) <= cover[:, None] + 2 * cover + 1e-3
            order = np.argsort(above, kind="stable")
            ends = np.searchsorted(above[order], np.arange(had + 1))
            sizes = np.diff(ends)
        for p in todo.tolist():
            if best[p] < least:
                if len(found) - listed >= 256:
                    live = live[best[live] <= 1]
                    live_x, listed = x32[live], len(found)
                rows, some = live, live_x
                if close is not None:
                    own = np.flatnonzero(close[above[p]])
                    if sizes[own].sum() < len(live) // 2:
                        rows = np.concatenate([order[ends[c] : ends[c + 1]] for c in own.tolist()])
                        some = x32[rows]
                near = some @ x32[p]
                looked += len(near)
                nearer = near > best[rows]
                label[rows[nearer]] = len(found)
                best[rows[nearer]] = near[nearer]
                label[p] = len(found)
                best[p] = 2  # a centre stays its own nearest one
                found.append(p)
        parents.append(np.concatenate([np.arange(had), above[found[had:]]]).astype(np.int64))
    centres = np.array(found)
    labels = [label]
    for parent in parents[:0:-1]:
        labels.insert(0, parent[labels[0]])
    order = np.lexsort(labels[::-1])
    place, levels = np.argsort(order), []
    for l in labels:
        at = l[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        far = angle(np.einsum("ij,ij->i", x[order], x[centres[at]]))
        levels.append(Level(np.append(starts, n), place[centres[at[starts]]], np.maximum.reduceat(far, starts)))
    return order, levels, looked


def merge(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of ``u[k]`` and ``v[k]`` in ``root``, where each place names the least of its set."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


class Meeting:
    """Links between the vectors of two trees, or within one."""

    def __init__(self, a: Tree, b: Tree | None, cosine: float = COSINE) -> None:
        self.a, self.own = a, b is None
        self.b = a if b is None else b
        self.cosine, self.reach = cosine, float(angle(np.array(cosine)))
        self.shift = 0 if self.own else len(a.x)
        self.counts = np.zeros(self.shift + len(self.b.x), np.int64)
        self.root = np.arange(len(self.counts))
        self.joined = [[np.zeros(len(l.centre), bool) for l in t.levels] for t in (self.a, self.b)]
        #: Pairs of nodes that were compared, pairs of single vectors among them.
        self.compared = self.decided = 0

    def run(self) -> Meeting:
        top = self._pairs(0, np.array([0]), np.array([len(self.a.levels[0].centre)]), np.array([0]), np.array([len(self.b.levels[0].centre)]))
        stack = [(0, *block) for block in top]
        while stack:
            l, i, j = stack.pop()
            i, j = self._settle(l, i, j)
            if not len(i):
                continue
            ca, cb = self.a.children[l], self.b.children[l]
            stack += [(l + 1, *block) for block in self._pairs(l + 1, ca[i], ca[i + 1], cb[j], cb[j + 1])]
        for tree, shift, joined in ((self.a, 0, self.joined[0]), (self.b, self.shift, self.joined[1])):
            for level, on in zip(tree.levels[:-1], joined):
                at = np.flatnonzero(on)
                size = level.starts[at + 1] - level.starts[at]
                first = np.repeat(level.starts[at], size)
                merge(self.root, first + shift, _runs(level.starts[at], size) + shift)
        return self

    def edges(self) -> np.ndarray:
        """(place, least place of its set), where they differ."""
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.stack([at, self.root[at]], 1)

    def _pairs(self, l: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the nodes [a0, a1) with [b0, b1) of a level that single precision can't prune; within one tree each
        unordered pair once."""
        out = []
        size = (a1 - a0) * (b1 - b0)
        large = size >= DENSE
        for p, q, r, s in zip(a0[large].tolist(), a1[large].tolist(), b0[large].tolist(), b1[large].tolist()):
            step = max(1, BLOCK // (s - r))
            for at in range(p, q, step):
                end = min(q, at + step)
                lo = max(r, at) if self.own else r  # the halves below the diagonal are looked at from the other side
                if lo >= s:
                    continue
                i, j = np.nonzero(self._screen(l, at, end, lo, s))
                i, j = i + at, j + lo
                out.append((i, j))
        a0, a1, b0, b1 = (v[~large] for v in (a0, a1, b0, b1))
        ends = np.cumsum(size[~large])
        k = 0
        while k < len(a0):
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK // 16, "right")))
            part = slice(k, upto)
            wide = b1[part] - b0[part]
            rows = np.repeat(np.arange(k, upto), size[~large][part])
            inner = np.arange(len(rows)) - np.repeat(ends[part] - size[~large][part] - (ends[k - 1] if k else 0), size[~large][part])
            out.append((a0[rows] + inner // wide[rows - k], b0[rows] + inner % wide[rows - k]))
            k = upto
        if self.own:
            out = [(i[i <= j], j[i <= j]) for i, j in out]
        return [(i.astype(np.int32), j.astype(np.int32)) for i, j in out if len(i)]

    def _screen(self, l: int, p: int, q: int, r: int, s: int) -> np.ndarray:
        """Whether pairs of nodes may be within reach: x.y >= cos(ra + rb + reach), by one product of matrices, as
        cos(a + b) = cos a cos b - sin a sin b. Nodes too wide for that stay."""
        a, b = self.a.levels[l], self.b.levels[l]
        ra, rb = a.radius[p:q], b.radius[r:s] + self.reach
        left = np.concatenate([self.a.single[a.centre[p:q]], np.stack([-np.cos(ra), np.sin(ra)], 1).astype(np.float32)], 1)
        right = np.concatenate([self.b.single[b.centre[r:s]], np.stack([np.cos(rb), np.sin(rb)], 1).astype(np.float32)], 1)
        self.compared += (q - p) * (s - r)
        near = left @ right.T >= -COARSE
        most = (np.pi - self.reach) / 2
        near[ra > most] = True
        near[:, rb - self.reach > most] = True
        return near

    def _cosines(self, l: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.a.levels[l].centre, self.b.levels[l].centre
        rows, cols = int(i.max()) - int(i.min()) + 1, int(j.max()) - int(j.min()) + 1
        if 8 * len(i) >= rows * cols:  # most of a block: one product
            return (self.a.x[a[i.min() : i.max() + 1]] @ self.b.x[b[j.min() : j.max() + 1]].T)[i - i.min(), j - j.min()]
        step = 1 << 15
        return np.concatenate([np.einsum("ij,ij->i", self.a.x[a[i[k : k + step]]], self.b.x[b[j[k : k + step]]]) for k in range(0, len(i), step)])

    def _settle(self, l: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts the pairs that are linked whole, and returns those to follow to their children."""
        a, b = self.a.levels[l], self.b.levels[l]
        cosines = self._cosines(l, i, j)
        last = l + 1 == len(self.a.levels)
        if last:
            whole, go = cosines >= self.cosine, np.zeros(len(i), bool)
            if self.own:
                whole &= i != j
            self.decided += len(i)
        else:
            between, both = angle(cosines), a.radius[i] + b.radius[j]
            whole = between + both <= self.reach - SLACK
            go = ~whole & (between - both <= self.reach + SLACK)
        if whole.any():
            self._link(l, i[whole], j[whole])
        return i[go], j[go]

    def _link(self, l: int, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.a.levels[l], self.b.levels[l]
        wa, wb = self.a.sums[l], self.b.sums[l]
        self.counts[: len(self.a.x)] += np.repeat(np.bincount(i, wb[j], len(wa)).astype(np.int64), np.diff(a.starts))
        self.joined[0][l][i] = True
        self.joined[1][l][j] = True
        if self.own:
            same = i == j
            self.counts -= np.repeat(np.bincount(i[same], minlength=len(wa)), np.diff(a.starts)) * self.a.weights
            i, j = i[~same], j[~same]
        self.counts[self.shift :] += np.repeat(np.bincount(j, wa[i], len(wb)).astype(np.int64), np.diff(b.starts))
        merge(self.root, a.starts[i], b.starts[j] + self.shift)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def links(x: np.ndarray, weights: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of ``x``: summed weights of the rows linked to each, and the least place of its component."""
    order, levels, _ = build(x, float(angle(np.array(cosine))))
    met = Meeting(Tree(x[order], weights[order], levels), None, cosine).run()
    counts, least = np.zeros(len(x), np.int64), np.full(len(x), len(x))
    counts[order] = met.counts
    np.minimum.at(least, met.root, order)
    out = np.zeros(len(x), np.int64)
    out[order] = least[met.root]
    return counts, out


def _vectors(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, d (length), raw and sig (null where a vector links with nothing), and the raw components' type."""
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
            ends = np.concatenate([[0], np.cumsum(size)])
            odd, some = (np.concatenate([[0], np.cumsum(v)])[ends] for v in (~np.isfinite(flat), flat != 0))
            good = (np.diff(odd) == 0) & (np.diff(some) > 0)
            with np.errstate(over="ignore"):
                data = flat.astype(kind).tobytes()
            raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(data)])
            good &= np.asarray(pc.is_valid(batch.column("vec_id")))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "d": pa.array(size, pa.int32()), "raw": pc.if_else(pa.array(good), raw, pa.scalar(None, pa.binary()))})

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, d int, raw binary")
    return rows.withColumn("sig", F.unhex(F.md5("raw"))), kind


def _opened(raw: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))


def _centres(nodes: DataFrame, kind: str) -> list[tuple[int, np.ndarray]]:
    """For each length of vector its centres, from about ``SAMPLE`` vectors of all lengths, chosen by hash."""
    sizes = {r["d"]: r["count"] for r in nodes.groupBy("d").count().collect()}  # a row for each length
    total = sum(sizes.values())
    drawn: dict[int, list[bytes]] = {}
    places = 1 << 30
    for r in nodes.where(F.pmod(F.hash("sig"), F.lit(places)) < int(min(1.0, SAMPLE / max(total, 1)) * places)).select("d", "sig", "raw").collect():
        drawn.setdefault(r["d"], []).append((bytes(r["sig"]), bytes(r["raw"])))
    out = []
    for d, n in sorted(sizes.items()):
        cells = max(1, min(CELLS, -(-n // CHUNK)))
        own = [raw for _, raw in sorted(drawn.get(d, []))]
        if not own:  # a length too rare for the sample has one cell around any vector
            own = [bytes(nodes.where(F.col("d") == d).agg(F.min("raw")).first()[0])]
        x = _opened(own, kind)
        out.append((d, x[farthest_first(x, cells)]))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Null, zero and non-finite vectors, and rows with a null id, link with nothing; vectors of different lengths don't
    link with each other. Equal vectors are one node with a weight, linked with each other. An empty table has no rows.
    """
    rows, kind = _vectors(vectors)
    rows = written(rows, "vectors")
    nodes = rows.where("sig is not null").groupBy("sig").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("m"), F.first("d").alias("d"))
    nodes = written(nodes, "nodes")
    centres = _centres(nodes, kind)
    if not centres:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    offset = dict(zip((d for d, _ in centres), np.cumsum([0, *(len(c) for _, c in centres)]).tolist()))
    by_length = dict(centres)
    reach = float(angle(np.array(cosine)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                size, raw = np.asarray(batch.column("d")), batch.column("raw").to_pylist()
                cell, far = np.zeros(len(raw), np.int32), np.zeros(len(raw))
                for d in np.unique(size).tolist():
                    own = np.flatnonzero(size == d)
                    a = _opened([raw[k] for k in own.tolist()], kind) @ by_length[d].T
                    best = a.argmax(1)
                    cell[own], far[own] = best + offset[d], angle(a[np.arange(len(own)), best])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sig", "raw", "m")), pa.array(cell), pa.array(far)], names=["sig", "raw", "m", "cell", "far"])

    dealt = written(nodes.mapInArrow(assign, "sig binary, raw binary, m long, cell int, far double"), "cells")
    every = sum(len(c) for _, c in centres)
    radius, chunks = np.zeros(every), np.zeros(every, np.int64)
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        radius[r["cell"]], chunks[r["cell"]] = r["far"], -(-r["n"] // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            salt = np.array([int.from_bytes(s[:6], "big") for s in batch.column("sig").to_pylist()], np.int64)
            chunk = first[cell] + salt % np.maximum(chunks[cell], 1)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), *(batch.column(c) for c in ("cell", "sig", "raw", "m"))], names=["chunk", "cell", "sig", "raw", "m"])

    def plant(group: pa.Table) -> pa.Table:
        lean_worker()
        group = group.sort_by("sig")
        raw = group.column("raw").to_pylist()
        order, levels, _ = build(_opened(raw, kind), reach)
        order = order.tolist()
        sigs, weights = group.column("sig").to_pylist(), group.column("m").to_pylist()
        return pa.table({
            "chunk": group.column("chunk").slice(0, 1), "cell": group.column("cell").slice(0, 1), "sigs": pa.array([[sigs[k] for k in order]], pa.list_(pa.binary())),
            "raw": pa.array([b"".join(raw[k] for k in order)], pa.binary()), "weights": pa.array([[weights[k] for k in order]], pa.list_(pa.int64())),
            "starts": pa.array([[l.starts.tolist() for l in levels]], pa.list_(pa.list_(pa.int32()))), "centres": pa.array([[l.centre.tolist() for l in levels]], pa.list_(pa.list_(pa.int32()))),
            "radii": pa.array([[l.radius.tolist() for l in levels]], pa.list_(pa.list_(pa.float64()))),
        })

    def plant_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if len(b)], schema=pa.schema([("chunk", pa.int32()), ("cell", pa.int32()), ("sig", pa.binary()), ("raw", pa.binary()), ("m", pa.int64())]))
        for chunk in pc.unique(rows.column("chunk")).to_pylist():
            yield from plant(rows.filter(pc.equal(rows.column("chunk"), chunk))).to_batches()

    kept = "chunk int, cell int, sig binary, raw binary, m long"
    numbered = dealt.drop("far").mapInArrow(number, kept)
    trees = written(numbered.repartitionById(int(first[-1]), F.col("chunk")).mapInArrow(plant_all, TREES), "trees")  # a task for each chunk

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                chunk, cell = row.column("chunk")[0].as_py(), row.column("cell")[0].as_py()
                d = next(d for d in reversed(offset) if offset[d] <= cell)
                lo, own = offset[d], by_length[d]
                apart = angle(own @ own[cell - lo])
                near = np.flatnonzero(apart - radius[lo : lo + len(own)] - radius[cell] <= reach + SLACK) + lo
                for other in np.concatenate([np.arange(first[c], first[c + 1]) for c in near.tolist()]).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([min(chunk, other)], pa.int32()), pa.array([max(chunk, other)], pa.int32()), *row.columns], names=["a", "b", *row.schema.names])

    def planted(row: pa.Table) -> tuple[Tree, list[bytes]]:
        raw, sigs = row.column("raw")[0].as_py(), row.column("sigs")[0].as_py()
        x = unit(np.frombuffer(raw, kind).reshape(len(sigs), -1))
        parts = (row.column(c)[0].as_py() for c in ("starts", "centres", "radii"))
        levels = [Level(np.array(s), np.array(c), np.array(r)) for s, c, r in zip(*parts)]
        return Tree(x, np.array(row.column("weights")[0].as_py(), np.int64), levels), sigs

    def compare(group: pa.Table) -> pa.Table:
        lean_worker()
        group = group.sort_by("chunk")
        a, sigs = planted(group.slice(0, 1))
        b, more = planted(group.slice(1, 1)) if len(group) > 1 else (None, [])
        met, sigs = Meeting(a, b, cosine).run(), sigs + more
        hit, edges = np.flatnonzero(met.counts).tolist(), met.edges()
        return pa.table({
            "sig": pa.array([sigs[i] for i in hit] + [sigs[i] for i in edges[:, 0].tolist()], pa.binary()),
            "other": pa.array([None] * len(hit) + [sigs[j] for j in edges[:, 1].tolist()], pa.binary()),
            "n": pa.array(met.counts[hit].tolist() + [0] * len(edges), pa.int64()),
        })

    sent = trees.mapInArrow(send, f"a int, b int, {TREES}")
    found = written(sent.groupBy("a", "b").applyInArrow(compare, "sig binary, other binary, n long"), "links")
    joined = components(found.where("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "sig")
    counts = nodes.select("sig", "m").join(found.where("n > 0").groupBy("sig").agg(F.sum("n").alias("n")), "sig", "left")
    named = rows.drop("raw", "d").join(counts, "sig", "left").join(joined, "sig", "left").withColumn("c", F.coalesce("component", "sig"))
    least = written(named.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("least")), "least")  # so that the join can split large components
    out = named.join(least, "c", "left").select("vec_id", F.coalesce(F.coalesce("n", F.lit(0)) + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
