"""Overlays of two sides of polygons by the cells of a grid, of which a polygon touches 1.4 on average.

Field by map unit: a field no larger than a cell stays whole, in the cell of its lower left corner, finer where fields are
crowded, and soils go to every cell with a field whose bounds they meet. Fields and map units of a cell are dealt to blocks,
so that polygons stacked on each other become many tasks too; a block's pairs are overlaid at once and final. Larger
fields, and all for outlines over all fields, are cut to cells. Cells with more than ``CORNERS`` corners are cut again,
unless their polygons are about as large as they are. What lies on cells' borders cancels between neighbours, and the edges
left over close to outlines.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import boxes, convex, geometry, outlines
from fieldspark.functions import expressions as E
from fieldspark.operators import checks
from fieldspark.operators.spatial import _RINGS, EQUAL_AREA, RINGS, bounds_join, require_srid, with_measures
from fieldspark.sources.scratch import landed

#: Cells that a polygon touches on average: few, so that few pairs come apart into several cells.
CELLS = 1.4
#: Corners of both sides in a cell, from which it is cut again; how often, and into how many halvings at once, at most.
CORNERS, ROUNDS, HALVINGS = 4000, 4, 6
#: Width and height of a cell's polygons together, in cells, up to which it is cut again.
REACH = 0.5
#: Polygons of a side in a block, levels of cells for whole fields at most, pairs overlaid at once, and of upright boxes alone.
BLOCK, LEVELS, PAIRS, PLAIN = 1000, 12, 100_000, 1_000_000
CELL = ["level", "cx", "cy"]
_BOUNDS = ["xmin", "ymin", "xmax", "ymax"]
_HOME = ["home_level", "home_x", "home_y"]
_PARTS = T.ArrayType(T.StructType([T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("corners", T.LongType()), T.StructField("reach", T.DoubleType()), T.StructField("rings", _RINGS)]))
_ENDS = ("x1", "y1", "x2", "y2")
_EDGE = [T.StructField(n, T.DoubleType()) for n in _ENDS]
#: A row with an area, or with an edge: of a seam if it lies on a cell's border, in the line's axis and place, and along it.
_FOUND = T.ArrayType(T.StructType([T.StructField("field_id", T.StringType()), T.StructField("mukey", T.StringType()), T.StructField("area", T.DoubleType()), T.StructField("axis", T.IntegerType()), T.StructField("line", T.DoubleType()), T.StructField("along", T.LongType()), *_EDGE]))
_EDGES = T.ArrayType(T.StructType(_EDGE))


def grid_size(*sides: DataFrame) -> float:
    """The size of cells of which a polygon (with bounds) touches ``CELLS`` on average over both sides."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    every = None
    for df in sides:
        one = df.agg(F.count("xmin").alias("n"), F.sum(w + h).alias("b"), F.sum(w * h).alias("c"))
        every = one if every is None else every.unionByName(one)
    n, b, c = every.agg(F.sum("n"), F.sum("b"), F.sum("c")).first()
    if not n or not b:
        return 1.0
    more = (CELLS - 1) * n  # CELLS * n = n + b / size + c / size ** 2
    return (b + math.sqrt(b * b + 4 * more * c)) / (2 * more)


def _cut(size: float):
    @F.pandas_udf(_PARTS)
    def run(rings: pd.Series, level: pd.Series) -> pd.Series:
        out = []
        for r, k in zip(rings, level):
            side = size / 2 ** int(k)
            found = []
            for x, y, parts in outlines.split(r, side) if r is not None else ():
                x0, y0, x1, y1 = geometry.bounds(parts)
                found.append({"cx": x, "cy": y, "corners": sum(len(p["xs"]) for p in parts), "reach": (x1 - x0 + y1 - y0) / side, "rings": parts})
            out.append(found)
        return pd.Series(out)

    return run


def cut(df: DataFrame, size: float, level: Column | None = None) -> DataFrame:
    """``df`` once for each cell (level, cx, cy) that its rings have an area in, with the rings within it and their corners."""
    more = [c for c in df.columns if c not in ("rings", "corners", "reach", *CELL)]
    return df.withColumn("level", (F.lit(0) if level is None else level).cast("int")).select(*more, "level", F.explode(_cut(size)("rings", "level")).alias("_c")).select(*more, "level", "_c.*")


def cut_evenly(df: DataFrame, size: float) -> DataFrame:
    """``cut``, and crowded cells again, into as many as their corners call for. Polygons that lie on each other can't be
    parted: where they reach through much of a cell it stays, and there is a limit to the rounds."""
    out = landed(cut(df, size), "cells")
    for _ in range(ROUNDS):
        full = out.groupBy(*CELL).agg(F.sum("corners").alias("_n"), F.avg("reach").alias("_reach")).where(f"_n > {CORNERS} and _reach <= {REACH}")
        step = F.least(F.ceil(F.log2(F.col("_n") / CORNERS) / 2), F.floor(-F.log2(F.col("_reach"))), F.lit(HALVINGS))
        full = landed(full.select(*CELL, step.cast("int").alias("_step")), "full")
        if not full.limit(1).count():
            break
        again = cut(out.join(full, CELL), size, F.col("level") + F.col("_step")).drop("_step")
        out = landed(out.join(full, CELL, "left_anti").unionByName(again), "cells")
    return out


def _measured(fields: DataFrame, soils: DataFrame) -> tuple[DataFrame, DataFrame]:
    """side (0: field, 1: soil), key, area, rings and bounds of both sides' polygons."""
    for df, name, key in ((fields, "fields", "field_id"), (soils, "soils", "mukey")):
        checks.require_columns(df, [key], name)
        require_srid(df, EQUAL_AREA, name)
    left = with_measures(fields.select(F.lit(0).alias("side"), F.col("field_id").cast("string").alias("key"), "rings"))
    right = with_measures(soils.select(F.lit(1).alias("side"), F.trim(F.col("mukey").cast("string")).alias("key"), "rings")).where("area > 0")
    return landed(left, "fields"), landed(right, "soils")


def _cells(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    return cut_evenly(left.unionByName(right).select("side", "key", "area", "rings"), size)


def _sides(fields: DataFrame, soils: DataFrame, size: float | None) -> tuple[DataFrame, float]:
    """side (0: field, 1: soil), key, area of the whole polygon, and cells of both sides' polygons."""
    left, right = _measured(fields, soils)
    size = size or grid_size(left, right)
    return _cells(left, right, size), size


def _area(field: list, soils: list[tuple]) -> float:
    """Area of a field's rings that polygons, with their bounds and corners if they are convex, cover together."""
    if len(field) == 1 and all(c is not None for _, _, c in soils) and geometry.apart([b for _, b, _ in soils]):
        return sum(geometry.clipped_area(field[0], c) for _, _, c in soils)
    return outlines.overlap_area([field, [p for p, _, _ in soils]])


def _meeting(fields: dict[str, list], soils: dict[str, list[tuple]]) -> dict[tuple[str, str], list[tuple]]:
    """For each field and map unit of a cell that meet by bounds the map unit's polygons that meet the field."""
    owner = [key for key, parts in fields.items() for _ in parts]
    each = [(mukey, s) for mukey, own in soils.items() for s in own]
    a, b = (np.array(x).reshape(-1, 4) for x in ([geometry.bounds(p) for parts in fields.values() for p in parts], [s[1] for _, s in each]))
    out: dict[tuple[str, str], list[tuple]] = {}
    for i in range(len(a)):
        near = (a[i, 0] < b[:, 2]) & (b[:, 0] < a[i, 2]) & (a[i, 1] < b[:, 3]) & (b[:, 1] < a[i, 3])
        for j in np.flatnonzero(near).tolist():
            mukey, s = each[j]
            own = out.setdefault((owner[i], mukey), [])
            if not any(s is x for x in own):
                own.append(s)
    return out


def _with_seams(edges: list, size: float, level: int, x: int, y: int):
    """((axis, line, along), edge) of a cell's edges: nulls for those that lie on no border of it."""
    side = size / 2 ** int(level)
    lines = ((x * side, (x + 1) * side), (y * side, (y + 1) * side))
    for e in edges:
        axis = 0 if e[0] == e[2] and e[0] in lines[0] else 1 if e[1] == e[3] and e[1] in lines[1] else None
        yield ((axis, e[axis], int(y if axis == 0 else x) >> int(level)) if axis is not None else (None, None, None)), e


def _overlaid(size: float, areas: bool):
    """By cell: areas of each field and map unit that meet, or edges of what the map unit's polygons share with the field."""

    @F.pandas_udf(_FOUND)
    def run(members: pd.Series, level: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        out = []
        for rows, k, x, y in zip(members, level, cx, cy):
            found = []
            fields: dict[str, list] = {}
            soils: dict[str, list[tuple]] = {}
            for r in rows:
                if r["side"]:
                    soils.setdefault(r["key"], []).append((r["rings"], geometry.bounds(r["rings"]), geometry.convex(r["rings"])))
                else:
                    fields.setdefault(r["key"], []).append(r["rings"])
            for (field_id, mukey), near in _meeting(fields, soils).items():
                if not areas:
                    edges = outlines.region_edges([fields[field_id], [p for p, _, _ in near]])
                    found += [(field_id, mukey, None, *seam, *e) for seam, e in _with_seams(edges, size, k, x, y)]
                elif (area := _area(fields[field_id], near)) > 0:
                    found.append((field_id, mukey, area) + (None,) * 7)
            out.append([dict(zip(_FOUND.elementType.names, f)) for f in found])
        return pd.Series(out)

    return run


def _found(cells: DataFrame, size: float, areas: bool) -> DataFrame:
    rows = cells.groupBy(*CELL).agg(F.collect_set(F.struct("side", "key", "rings")).alias("m"), F.min("side").alias("a"), F.max("side").alias("b")).where("a < b")
    return rows.select(F.explode(_overlaid(size, areas)("m", *CELL)).alias("_f")).select("_f.*")


def _seam_rest():
    @F.pandas_udf(_EDGES)
    def run(axis: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_ENDS, e)) for e in outlines.seam_rest([tuple(e[n] for n in _ENDS) for e in own], int(a))] for a, own in zip(axis, edges)])

    return run


def _stitched():
    @F.pandas_udf(_RINGS)
    def run(edges: pd.Series) -> pd.Series:
        return pd.Series([outlines.stitched([tuple(e[n] for n in _ENDS) for e in own]) for own in edges])

    return run


def _outlines(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rings of edges by ``keys``; a row's edges are those of its outline alone."""
    edge = F.struct(*_ENDS)
    seams = found.where("axis is not null").groupBy(*keys, "axis", "line", "along").agg(F.collect_list(edge).alias("e"))
    left = seams.select(*keys, F.explode(_seam_rest()("axis", "e")).alias("e"))
    inner = found.where("x1 is not null and axis is null").select(*keys, edge.alias("e"))
    rings = inner.unionByName(left).groupBy(*keys).agg(F.collect_list("e").alias("e")).select(*keys, _stitched()("e").alias("rings"))
    return rings.where(F.size("rings") > 0)


def _homes(fields: DataFrame, size: float) -> DataFrame:
    """Whole fields no larger than a cell with their home: the cell of their lower left corner at the first level at which
    it has no more than ``BLOCK`` fields, or the last one whose cells are twice their own size."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(size * 2.0 ** -LEVELS))
    fields = fields.withColumn("_last", F.greatest(F.lit(0), F.least(F.floor(F.log2(size / side)) - 1, F.lit(LEVELS))).cast("int"))
    each = fields.select("key", "xmin", "ymin", "_last", F.explode(F.sequence(F.lit(0), "_last")).alias("home_level"))
    for c in "xy":
        each = each.withColumn(f"home_{c}", F.floor(F.col(f"{c}min") * F.pow(F.lit(2.0), F.col("home_level")) / size))
    full = each.groupBy(*_HOME).agg(F.count(F.lit(1)).alias("_n"))
    fit = each.join(full, _HOME).where(f"_n <= {BLOCK} or home_level = _last")
    best = fit.groupBy("key").agg(F.min(F.struct(*_HOME)).alias("_h"))
    return fields.drop("_last").join(best.select("key", "_h.*"), "key")


def _plain(df: DataFrame) -> DataFrame:
    """``df`` (rings, bounds) without the rings of upright boxes, whose bounds tell all, so that blocks get less."""
    ring = F.get("rings", F.lit(0))
    x, y = ([F.get(ring[c], F.lit(k)) for k in range(5)] for c in ("xs", "ys"))
    turns = [(a[0] == a[1]) & (b[1] == b[2]) & (a[2] == a[3]) & (b[3] == b[0]) for a, b in ((x, y), (y, x))]
    closed = (F.size(ring["xs"]) == 4) | ((F.size(ring["xs"]) == 5) & (x[4] == x[0]) & (y[4] == y[0]))
    box = (F.size("rings") == 1) & (ring["sign"] == 1) & closed & (turns[0] | turns[1]) & (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    return df.withColumn("rings", F.when(~F.coalesce(box, F.lit(False)), F.col("rings")))


def _pairs(left: DataFrame, right: DataFrame, size: float, run, schema: str) -> DataFrame:
    """What ``run`` makes of the fields and soils of each block of a home, over all homes."""
    left, right = _plain(left), _plain(right)
    at = landed(_homes(left, size), "homes")
    homes = at.groupBy(*_HOME).agg(*[F.min(c).alias(c) for c in _BOUNDS[:2]], *[F.max(c).alias(c) for c in _BOUNDS[2:]], F.ceil(F.count(F.lit(1)) / BLOCK).alias("field_blocks"))
    soils = right.select("key", "rings", *_BOUNDS, F.array(*_BOUNDS).alias("box"))
    met = landed(bounds_join(homes, soils, size).drop(*_BOUNDS), "met")
    blocks = landed(met.groupBy(*_HOME).agg(F.max("field_blocks").alias("field_blocks"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("soil_blocks")), "blocks")
    n = blocks.agg(F.sum(F.col("field_blocks") * F.col("soil_blocks"))).first()[0] or 1
    by = [*_HOME, "field_block", "soil_block"]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in their block of one side, once for each of the other side's."""
        df = df.withColumn(f"{own}_block", F.pmod(F.xxhash64("key"), F.col(f"{own}_blocks"))).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)))
        parts = max(left.sparkSession.sparkContext.defaultParallelism, min(int(n), 4096))
        return df.drop("field_blocks", "soil_blocks").repartition(parts, *by)

    fields = at.select(*_HOME, "key", "area", "rings", F.array(*_BOUNDS).alias("box")).join(blocks, _HOME)
    soils = met.drop("field_blocks").join(blocks, _HOME)
    return dealt(fields, "field", "soil").groupBy(*by).cogroup(dealt(soils, "soil", "field").groupBy(*by)).applyInArrow(run, schema)


class _Side:
    """A block's polygons of one side, in order of their keys: bounds, whether they are upright boxes (without rings), and
    rings and corners, as far as they are asked for."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("key").combine_chunks()
        self.rows, self.key = rows, rows.column("key")
        self.box = np.ascontiguousarray(_flat(rows.column("box")).to_numpy().reshape(-1, 4).T)
        self.upright = rows.column("rings").is_null().to_numpy()

    @cached_property
    def rings(self) -> list:
        drawn = zip(self.rows.column("rings").to_pylist(), self.box.T.tolist())
        return [[{"sign": 1, "xs": [a, c, c, a], "ys": [b, b, d, d]}] if r is None else r for r, (a, b, c, d) in drawn]

    @cached_property
    def convex(self) -> list:
        return [geometry.convex(r) for r in self.rings]

    @cached_property
    def corners(self) -> tuple[np.ndarray, np.ndarray]:
        return convex.rows(self.convex)

    def soil(self, k: int) -> tuple:
        return self.rings[k], tuple(self.box[:, k].tolist()), self.convex[k]


def _flat(lists: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([x.flatten() for x in lists.chunks]) if lists.num_chunks else pa.array([], pa.float64())


def _met(fields: _Side, soils: _Side):
    """(field, soil, first of each group) of the pairs that meet by bounds, in groups of a field and a map unit; so many
    fields at once that there are about ``PAIRS``, or ``PLAIN`` of boxes alone."""
    number = np.asarray(soils.key.combine_chunks().dictionary_encode().indices) if soils.rows.num_rows else np.zeros(0, int)
    step = max(1, (PLAIN if fields.upright.all() and soils.upright.all() else PAIRS) // max(1, len(number)))
    b = soils.box
    for at in range(0, fields.rows.num_rows, step):
        a = fields.box[:, at : at + step, None]
        i, j = np.nonzero((a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3]))
        if len(i):
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (number[j[1:]] != number[j[:-1]])]))
            yield i + at, j, new


def _boxed(fields: _Side, soils: _Side, i: np.ndarray, j: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, boxes.Boxes]:
    """Groups of upright boxes alone, no more than ``boxes.MOST`` each; where these start among their pairs, and what the
    pairs have in common."""
    upright = fields.upright[i] & soils.upright[j]
    plain = (np.ones(len(new), bool) if upright.all() else np.logical_and.reduceat(upright, new)) & (np.diff(np.append(new, len(i))) <= boxes.MOST)
    pair, start = (slice(None), new) if plain.all() else boxes.of_groups(plain, new, len(i))
    i, j = i[pair], j[pair]
    return plain, start, tuple(f(a.take(i), b.take(j)) for f, a, b in zip((np.maximum, np.maximum, np.minimum, np.minimum), fields.box, soils.box))


def _clips(fields: _Side, soils: _Side, i: np.ndarray, j: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups whose polygons are all convex and few, their pairs, group of each pair from 0, and corners of what the pairs
    have in common."""
    many = np.diff(np.append(new, len(i)))
    (p, n), (q, m) = fields.corners, soils.corners
    fast = np.logical_and.reduceat((n[i] > 0) & (m[j] > 0), new) & (many <= convex.MOST)
    pair = np.flatnonzero(np.repeat(fast, many))
    group = np.repeat(np.arange(fast.sum()), many[fast])
    p, n = convex.clipped(p[i[pair]], n[i[pair]], q[j[pair]])
    return fast, pair, group, p, n


_AREAS = "field_id string, mukey string, overlap_area_m2 double, field_area_m2 double"
_CLIPPED = f"mukey string, field_id string, area double, rings {RINGS}"
_RING_LISTS = pa.list_(pa.struct([("sign", pa.int32()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))]))


def _table(schema: str, kinds: list, chunks: list[list]) -> pa.Table:
    """Columns of a schema, each a list of arrays or of arrays of chunks."""
    flat = [[c for x in own for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])] for own in chunks]
    return pa.table([pa.chunked_array(x, k) for x, k in zip(flat, kinds)], names=[c.split()[0] for c in schema.split(", ", len(kinds) - 1)])


def _block_areas(fields: pa.Table, soils: pa.Table) -> pa.Table:
    """Areas of each field and map unit of a block."""
    a, b = _Side(fields), _Side(soils)
    whole, out = a.rows.column("area"), [[], [], [], []]
    for i, j, new in _met(a, b):
        plain, start, shared = _boxed(a, b, i, j, new)
        area = np.zeros(len(new))
        area[plain] = boxes.union_areas(shared, start)
        if not plain.all():
            area[~plain] = _other_areas(a, b, i, j, new, ~plain)
        kept = np.flatnonzero(area > 0)
        f, s = pa.array(i[new[kept]]), pa.array(j[new[kept]])
        for column, x in zip(out, (a.key.take(f), b.key.take(s), pa.array(area[kept]), whole.take(f))):
            column.append(x)
    return _table(_AREAS, [pa.string(), pa.string(), pa.float64(), pa.float64()], out)


def _other_areas(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Areas of the chosen groups, which are not of boxes alone."""
    own, new = boxes.of_groups(chosen, new, len(i))
    i, j = i[own], j[own]
    fast, pair, group, p, n = _clips(a, b, i, j, new)
    area = np.zeros(len(new))
    area[fast] = convex.union_areas(p, n, b.corners[0][j[pair]], group)
    ends = np.append(new, len(i))
    for g in np.flatnonzero(~fast).tolist():
        area[g] = _area([a.rings[i[new[g]]]], [b.soil(k) for k in j[ends[g] : ends[g + 1]].tolist()])
    return area


def _ring_lists(n: int, rings: boxes.Rings) -> tuple[np.ndarray, pa.Array]:
    """Areas, holes taken off, and lists of the rings of groups 0 to n - 1."""
    corners = pa.array(rings.first, pa.int32())
    own = pa.StructArray.from_arrays([pa.array(rings.sign, pa.int32()), pa.ListArray.from_arrays(corners, pa.array(rings.xs)), pa.ListArray.from_arrays(corners, pa.array(rings.ys))], ["sign", "xs", "ys"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(rings.group, minlength=n))])
    return np.bincount(rings.group, rings.sign * rings.area, n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)


def _block_outlines(fields: pa.Table, soils: pa.Table) -> pa.Table:
    """Outlines of each map unit within each field of a block, and their areas."""
    a, b = _Side(fields), _Side(soils)
    out = [[], [], [], []]

    def add(i: np.ndarray, j: np.ndarray, area, rings: pa.Array) -> None:
        for column, x in zip(out, (b.key.take(pa.array(j, pa.int64())), a.key.take(pa.array(i, pa.int64())), pa.array(area, pa.float64()), rings)):
            column.append(x)

    for i, j, new in _met(a, b):
        plain, start, shared = _boxed(a, b, i, j, new)
        first = new[plain]
        for g, rings in boxes.outlines(shared, start):
            area, lists = _ring_lists(len(g), rings)
            some = np.flatnonzero(np.bincount(rings.group, minlength=len(g)))
            lists = lists if len(some) == len(g) else lists.take(pa.array(some))
            add(i[first[g[some]]], j[first[g[some]]], area[some], lists)
        if not plain.all():
            kept, rings = _other_outlines(a, b, i, j, new, ~plain)
            area = [sum(r["sign"] * geometry.measures([r | {"sign": 1}])[0] for r in own) for own in rings]
            add(i[new[kept]], j[new[kept]], area, pa.array(rings, _RING_LISTS))
    return _table(_CLIPPED, [pa.string(), pa.string(), pa.float64(), _RING_LISTS], out)


def _other_outlines(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, list]:
    """Those of the chosen groups, which are not of boxes alone, that have an outline, with its rings. Convex pieces whose
    bounds are apart are rings as they are, others are swept."""
    own, new = boxes.of_groups(chosen, new, len(i))
    i, j = i[own], j[own]
    fast, pair, group, p, n = _clips(a, b, i, j, new)
    good = (n > 2) & (convex.areas(p) > 0)
    bounds, of_group = convex.boxes(p), np.searchsorted(group, np.arange(fast.sum() + 1))
    ends, at, rings, kept = np.append(new, len(i)), -1, [], []
    for g, quick in enumerate(fast.tolist()):
        js = j[ends[g] : ends[g + 1]].tolist()
        if quick:
            at += 1
            own = [k for k in range(of_group[at], of_group[at + 1]) if good[k]]
            js = j[pair[own]].tolist()
        if not js:
            continue
        if quick and (len(own) == 1 or not any((bounds[k, :2] <= bounds[m, 2:]).all() and (bounds[m, :2] <= bounds[k, 2:]).all() for x, k in enumerate(own) for m in own[:x])):
            found = outlines.rings_of([list(map(tuple, p[k, : n[k]].tolist())) for k in own])
        else:
            found = outlines.stitched(outlines.region_edges([[a.rings[i[new[g]]]], [b.rings[k] for k in js]]))
        if found:
            kept.append(g)
            rings.append(found)
    return np.flatnonzero(chosen)[kept], rings


def _parted(left: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Fields of one polygon no larger than a cell, and all others that have bounds."""
    several = left.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    rows = left.where("xmin is not null").withColumn("_small", (F.col("xmax") - F.col("xmin") <= size) & (F.col("ymax") - F.col("ymin") <= size))
    rows = landed(rows.join(several.where("_n = 1").drop("_n").withColumn("_one", F.lit(True)), "key", "left").withColumn("_small", F.col("_small") & F.coalesce("_one", F.lit(False))).drop("_one"), "parted")
    return rows.where("_small").drop("_small"), rows.where("not _small").drop("_small")


def _overlaps(met: DataFrame) -> DataFrame:
    out = met.where("overlap_area_m2 > 1e-9 * field_area_m2")
    return out.select("field_id", "mukey", "overlap_area_m2", "field_area_m2", (F.col("overlap_area_m2") / F.col("field_area_m2")).alias("field_fraction"))


def field_soil_overlap(fields: DataFrame, soils: DataFrame, size: float | None = None) -> DataFrame:
    """field_id, mukey, overlap_area_m2, field_area_m2, field_fraction of the whole field, above 0 only.

    Pieces of one mukey count together, where they overlap once. Both sides must be in the equal-area projection. Less
    than a billionth of the field counts as touching.
    """
    left, right = _measured(fields, soils)
    size = size or grid_size(left, right)
    small, large = _parted(left, size)
    out = _pairs(small, right, size, _block_areas, _AREAS)
    if large.limit(1).count():
        cells = _cells(large, right, size)
        met = _found(cells, size, True).where("area is not null").groupBy("field_id", "mukey").agg(F.sum("area").alias("overlap_area_m2"))
        whole = cells.where("side = 0").groupBy(F.col("key").alias("field_id")).agg(F.max("area").alias("field_area_m2"))
        out = out.unionByName(met.join(whole, "field_id"))
    return _overlaps(out)


def clipped_soils(fields: DataFrame, soils: DataFrame, size: float | None = None) -> DataFrame:
    """mukey, field_id, area, rings: the outline of each map unit within each field, its polygons dissolved."""
    left, right = _measured(fields, soils)
    size = size or grid_size(left, right)
    small, large = _parted(left, size)
    out = _pairs(small, right, size, _block_outlines, _CLIPPED)
    if large.limit(1).count():
        outline = _outlines(landed(_found(_cells(large, right, size), size, False), "edges"), ["mukey", "field_id"])
        out = out.unionByName(outline.withColumn("area", E.rings_area(F.col("rings"))))
    return out


def _together(size: float):
    """By cell: edges of what each map unit's polygons share with all fields, which are dissolved first."""

    def run(fields: pa.Table, soils: pa.Table) -> pa.Table:
        found = []
        if fields.num_rows and soils.num_rows:
            k, x, y = (soils.column(c)[0].as_py() for c in CELL)
            whole = outlines.stitched(outlines.region_edges([fields.column("rings").to_pylist()]), 0.0)
            own: dict[str, list] = {}
            for key, rings in zip(soils.column("key").to_pylist(), soils.column("rings").to_pylist()):
                own.setdefault(key, []).append(rings)
            for mukey, pieces in own.items() if whole else ():
                found += [(mukey, *seam, *e) for seam, e in _with_seams(outlines.region_edges([[whole], pieces]), size, k, x, y)]
        columns = list(zip(*found)) or [()] * 8
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["mukey", "axis", "line", "along", *_ENDS])

    return run


def _dissolved(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    cells = _cells(left, right, size)
    n = max(left.sparkSession.sparkContext.defaultParallelism, min(4096, cells.select(*CELL).distinct().count()))
    side = lambda k: cells.where(f"side = {k}").select(*CELL, "key", "rings").repartition(n, *CELL).groupBy(*CELL)
    edges = side(0).cogroup(side(1)).applyInArrow(_together(size), "mukey string, axis int, line double, along long, x1 double, y1 double, x2 double, y2 double")
    return landed(_outlines(landed(edges, "edges"), ["mukey"]), "outlines")


def dissolved(fields: DataFrame, soils: DataFrame, size: float | None = None) -> DataFrame:
    """mukey, rings: one row a map unit, the outline of what it covers of all fields together, without the borders between
    fields or between its own polygons.

    A map unit that overlaps a field and has no outline is refused; overlaps are worked out of those without one only.
    """
    left, right = _measured(fields, soils)
    units = _dissolved(left, right, size or grid_size(left, right))
    rest = landed(soils.join(units.select(F.col("mukey").alias("_k")), F.trim(F.col("mukey").cast("string")) == F.col("_k"), "left_anti"), "rest")
    return require_survivors(field_soil_overlap(fields, rest, size), units) if rest.limit(1).count() else units


def dissolved_soils(fields: DataFrame, soils: DataFrame, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Overlaps as of ``field_soil_overlap``, and outlines as of ``dissolved``."""
    return field_soil_overlap(fields, soils, size), dissolved(fields, soils, size)


def require_survivors(overlaps: DataFrame, clipped: DataFrame) -> DataFrame:
    """``clipped``, in which every map unit of ``overlaps`` must be left."""
    checks.require_reference(overlaps.where("mukey <> ''"), clipped, "mukey", "clipped soils")
    return clipped
