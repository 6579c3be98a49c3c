"""Polygons: projection, measures, selection on a grid, joins and overlaps.

Polygon rows have ``srid`` and ``rings array<struct<sign:int,xs:array<double>,ys:array<double>>>``. A srid that an
operator does not expect is refused, never guessed.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import geometry, validity
from fieldspark.operators import checks
from fieldspark.operators.crops import rank_first

RINGS = "array<struct<sign:int,xs:array<double>,ys:array<double>>>"
_RINGS = T.ArrayType(T.StructType([T.StructField("sign", T.IntegerType()), T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType()))]))
_NUMBERS = ("area", "cx", "cy", "xmin", "ymin", "xmax", "ymax")
_MEASURES = T.StructType([*[T.StructField(n, T.DoubleType()) for n in _NUMBERS], T.StructField("simple", T.BooleanType())])
LONLAT, EQUAL_AREA = 4326, 5070
#: Most corners of a region that tests of single polygons take with them.
REGION_CORNERS = 1_000_000


def require_srid(df: DataFrame, srid: int, label: str) -> DataFrame:
    checks.require_columns(df, ["srid", "rings"], label)
    return checks.require_rules(df, {f"srid must be {srid}": F.coalesce(F.col("srid") == srid, F.lit(False))}, label)


#: Northern zones of the transverse Mercator grid are this plus the zone's number, 1 to 60.
UTM_NORTH = 32_600


def known_srid(srid: int) -> bool:
    return srid in (LONLAT, EQUAL_AREA) or UTM_NORTH < srid <= UTM_NORTH + 60


def _move(srid: int, to: int):
    """Function of coordinates from one reference system to another by way of longitude and latitude."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if srid == EQUAL_AREA:
            x, y = geometry.albers_inverse(x, y)
        elif srid != LONLAT:
            x, y = geometry.utm_inverse(x, y, srid - UTM_NORTH)
        if to == EQUAL_AREA:
            return geometry.albers_forward(x, y)
        return (x, y) if to == LONLAT else geometry.utm_forward(x, y, to - UTM_NORTH)

    return run


def _reprojected(to: int, within: float | None):
    """Moves a batch's rings, all coordinates of one reference system at once."""

    @F.pandas_udf(_RINGS)
    def run(rings: pd.Series, srid: pd.Series) -> pd.Series:
        out = rings.copy()
        for known in srid.dropna().unique():
            if int(known) == to:
                continue
            move, own = _move(int(known), to), [k for k in srid.index[srid == known] if rings[k] is not None]
            flat = [x for k in own for x in rings[k]]
            if not flat:
                continue
            corners = [(np.asarray(x["xs"], float), np.asarray(x["ys"], float)) for x in flat]
            if within is not None:
                corners = [geometry.densified(x, y, move, within) if len(x) > 1 else (x, y) for x, y in corners]
            ends = np.cumsum([len(x) for x, _ in corners])[:-1]
            xs, ys = move(np.concatenate([x for x, _ in corners]), np.concatenate([y for _, y in corners]))
            moved = ({"sign": x["sign"], "xs": a, "ys": b} for x, a, b in zip(flat, np.split(xs, ends), np.split(ys, ends)))
            for k in own:
                out[k] = [next(moved) for _ in rings[k]]
        return out

    return run


def reproject(df: DataFrame, srid: int, within: float | None = None) -> DataFrame:
    """Polygons in ``srid``: longitude/latitude, the equal-area conic, or a northern zone of the transverse Mercator grid
    (32601 to 32660); each row may come from any of these. Rows already there stay.

    With ``within``, edges get corners between their ends, so that what was straight is nowhere farther than that (in
    units of the target) from where it was; without it only the corners move.
    """
    zone = F.col("srid").between(UTM_NORTH + 1, UTM_NORTH + 60)
    checks.require_rules(df, {"unknown srid": F.coalesce(F.col("srid").isin(LONLAT, EQUAL_AREA) | zone, F.lit(False))}, "polygons")
    if not known_srid(srid):
        raise checks.CheckError(f"unknown srid {srid}")
    return df.withColumn("rings", _reprojected(srid, within)("rings", "srid")).withColumn("srid", F.lit(srid))


def _measured(simple: bool):
    @F.pandas_udf(_MEASURES)
    def run(rings: pd.Series) -> pd.DataFrame:
        out = []
        for r in rings:
            if r is None or not len(r) or not all(len(x["xs"]) for x in r):
                out.append((None,) * 7 + (False,))
            else:
                area, cx, cy = geometry.measures(r)
                out.append((area, *(None if np.isnan(c) else c for c in (cx, cy)), *geometry.bounds(r), simple and geometry.is_simple(r)))
        return pd.DataFrame(out, columns=[*_NUMBERS, "simple"])

    return run


def with_measures(df: DataFrame, simple: bool = False) -> DataFrame:
    """Adds area, centroid (cx, cy), bounds and, if asked for, ``simple``: whether the polygon is valid; null measures and
    false for missing or empty polygons."""
    out = df.withColumn("_m", _measured(simple)("rings")).select("*", "_m.*").drop("_m")
    return out if simple else out.drop("simple")


def validity_findings(df: DataFrame, key: str) -> DataFrame:
    """rule, key (as text) of each polygon that isn't valid: the first fault that ``validity.fault`` finds. A polygon is
    tried by itself; its corners are in one row anyway."""

    @F.pandas_udf("string")
    def found(rings: pd.Series) -> pd.Series:
        return pd.Series([validity.fault(r) for r in rings], dtype=object)

    return df.select(found("rings").alias("rule"), F.col(key).cast("string").alias("key")).where("rule is not null")


def eligible(df: DataFrame, flag: str, key: str, ordinal: str) -> DataFrame:
    """Flagged valid polygons with an area, then the first row of each key by ``ordinal``, the order in the source."""
    good = with_measures(df.where((F.col(flag) == 1) & F.col("rings").isNotNull()), simple=True).where("simple and area > 0")
    return rank_first(good, [key], [F.col(ordinal)])


def within_region(df: DataFrame, region: DataFrame, least: float = 0.95) -> DataFrame:
    """Measured polygons whose centroid lies in the one-row ``region`` and whose area does to ``least``; adds
    inside_fraction. The region is one polygon of at most ``REGION_CORNERS`` corners, which the tests carry with them."""
    found = region.select("rings", F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["xs"])).alias("corners"))
    corners = [r["corners"] for r in found.select("corners").limit(2).collect()]
    if len(corners) != 1:
        raise checks.CheckError("region: expected one polygon")
    if (corners[0] or 0) > REGION_CORNERS:
        raise checks.CheckError(f"region: more than {REGION_CORNERS} corners")
    whole = [r.asDict() for r in found.first()["rings"]]
    sides = geometry.edges(whole)

    @F.pandas_udf("double")
    def inside(rings: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        ok = geometry.contains(sides, cx.to_numpy(float), cy.to_numpy(float))
        return pd.Series([geometry.covered_area(r, [whole]) / geometry.measures(r)[0] if k else -1.0 for r, k in zip(rings, ok)], dtype=float)

    return df.where("area > 0").withColumn("inside_fraction", inside("rings", "cx", "cy")).where(F.col("inside_fraction") >= least)


def grid_cell(x: Column, lo: Column, hi: Column, n: int, from_top: bool = False) -> Column:
    """Cell 0 to n - 1 of a coordinate between bounds, truncated and clamped."""
    part = (hi - x) if from_top else (x - lo)
    return F.least(F.greatest((part / ((hi - lo) / n)).cast("int"), F.lit(0)), F.lit(n - 1))


def select_on_grid(points: DataFrame, bounds: tuple[float, float, float, float], n: int, key: str, prefix: str) -> DataFrame:
    """Of points (cx, cy) the nearest to its cell's centre in each of n x n cells, rows counted from the top.

    Equally near ones: the least key as text. Ids are the prefix and the row-major number with two digits or more.
    Cells without points are refused.
    """
    xmin, ymin, xmax, ymax = map(F.lit, bounds)
    rows = points.withColumn("grid_row", grid_cell(F.col("cy"), ymin, ymax, n, from_top=True)).withColumn("grid_col", grid_cell(F.col("cx"), xmin, xmax, n))
    mx, my = xmin + (F.col("grid_col") + 0.5) * ((xmax - xmin) / n), ymax - (F.col("grid_row") + 0.5) * ((ymax - ymin) / n)
    d2 = F.pow(F.col("cx") - mx, 2) + F.pow(F.col("cy") - my, 2)
    best = rank_first(rows.withColumn("_d", d2), ["grid_row", "grid_col"], [F.col("_d"), F.col(key).cast("string")]).drop("_d")
    checks.require_count(best, n * n, f"populated grid cells of {n} x {n}")
    number = (F.col("grid_row") * n + F.col("grid_col") + 1).cast("string")
    return best.withColumn("field_id", F.concat(F.lit(prefix), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))


def cell_size(df: DataFrame) -> float:
    """The smallest size of cells: the lower quartile of the bounds' longer sides, 1 where that is 0 or nothing."""
    size = df.agg(F.percentile_approx(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), 0.25)).first()[0]
    return float(size) if size else 1.0


def with_level(df: DataFrame, size: float) -> DataFrame:
    """Adds ``level``: the least k from 0 such that bounds are at most ``size`` times 2 to the k wide and high."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return df.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(size)) / size))).cast("int"))


def cells(df: DataFrame, size: float, levels: list[int]) -> DataFrame:
    """Rows with bounds and ``level``, once for each cell (cell_level, cell_x, cell_y) that they touch at each of
    ``levels`` from their own on: four cells a level at most, however large the bounds are."""
    at = df.withColumn("cell_level", F.explode(F.array(*map(F.lit, levels)))).where("cell_level >= level")
    side = F.lit(size) * F.pow(F.lit(2.0), F.col("cell_level"))
    for c in "xy":
        at = at.withColumn(f"cell_{c}", F.explode(F.sequence(F.floor(F.col(f"{c}min") / side), F.floor(F.col(f"{c}max") / side))))
    return at


def bounds_join(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of rows whose bounds meet, each once: an equi-join by cell at the level of the larger one, kept in the cell
    of the lower left corner of both bounds' intersection. Columns of the right side but bounds must differ from those
    of the left."""
    names = ["xmin", "ymin", "xmax", "ymax"]
    left, right = (with_level(df.dropna(subset=names), size) for df in (left, right))
    levels = sorted(r[0] for r in left.select("level").distinct().unionByName(right.select("level").distinct()).distinct().collect())  # few: they double
    if not levels:
        levels = [0]
    other = cells(right, size, levels).withColumnsRenamed({n: f"_{n}" for n in [*names, "level"]})
    meet = (F.col("xmin") <= F.col("_xmax")) & (F.col("_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("_ymax")) & (F.col("_ymin") <= F.col("ymax"))
    side = F.lit(size) * F.pow(F.lit(2.0), F.col("cell_level"))
    corner = (F.floor(F.greatest("xmin", "_xmin") / side) == F.col("cell_x")) & (F.floor(F.greatest("ymin", "_ymin") / side) == F.col("cell_y"))
    met = cells(left, size, levels).join(other, ["cell_level", "cell_x", "cell_y"]).where(meet & corner & (F.col("cell_level") == F.greatest("level", "_level")))
    return met.drop("cell_level", "cell_x", "cell_y", "level", *[f"_{n}" for n in [*names, "level"]])


def overlap_table(fields: DataFrame, overlaps: DataFrame, mapunits: DataFrame) -> DataFrame:
    """Overlaps with map unit names; fields without any stay, with mukey "", no names and 0 area and fraction.

    ``fields``: field_id, field_area_m2. An overlap whose mukey has no map unit is refused.
    """
    checks.require_reference(overlaps, mapunits, "mukey", "overlaps")
    named = overlaps.join(mapunits.select("mukey", "musym", "muname"), "mukey", "left").select("field_id", "mukey", "musym", "muname", "overlap_area_m2", "field_area_m2", "field_fraction")
    bare = fields.join(overlaps, "field_id", "left_anti").select("field_id", F.lit("").alias("mukey"), F.lit("").alias("musym"), F.lit("").alias("muname"), F.lit(0.0).alias("overlap_area_m2"), "field_area_m2", F.lit(0.0).alias("field_fraction"))
    return named.unionByName(bare)


def uncovered(overlaps: DataFrame) -> DataFrame:
    """field_id and covered fraction of fields that soils do not cover wholly."""
    return overlaps.groupBy("field_id").agg(F.sum("field_fraction").alias("covered"), F.count_distinct("mukey").alias("mapunits")).where(F.col("covered") < 1 - 1e-9)


def total_bounds(df: DataFrame) -> DataFrame:
    """One row: the bounds around all rows' bounds."""
    return df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
