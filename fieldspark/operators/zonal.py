"""Zonal statistics over pixel rows or tiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geometry
from fieldspark.functions.expressions import clear_class, finite
from fieldspark.operators import checks


def class_counts(pixels: DataFrame, zones: Sequence[str], code: str, valid: Column) -> DataFrame:
    """Pixels by zone, class and validity: the partial counts that majority classes are made from."""
    return pixels.select(*zones, F.col(code).alias("code"), F.coalesce(valid, F.lit(False)).alias("valid")).groupBy(*zones, "code", "valid").agg(F.count(F.lit(1)).alias("n"))


def majority_class(counts: DataFrame, zones: Sequence[str], least_coverage: float = 0.70) -> DataFrame:
    """Zone, total_pixels, valid_pixels, coverage_fraction, majority_code, majority_fraction from ``class_counts``.

    The most frequent valid class, of equally frequent ones the lowest, where the share of valid pixels reaches
    ``least_coverage`` and there are any; else null, with a null fraction.
    """
    n, ok = F.col("n"), F.col("valid") & F.col("code").isNotNull()
    merged = counts.groupBy(*zones, "code", "valid").agg(F.sum("n").alias("n"))
    z = merged.groupBy(*zones).agg(F.sum(n).alias("total_pixels"), F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("valid_pixels"), F.min(F.when(ok, F.struct((-n).alias("m"), F.col("code").alias("c")))).alias("top"))
    z = z.withColumn("coverage_fraction", F.when(F.col("total_pixels") > 0, F.col("valid_pixels") / F.col("total_pixels")).otherwise(0.0))
    kept = (F.col("coverage_fraction") >= least_coverage) & (F.col("valid_pixels") > 0)
    return z.select(*zones, "total_pixels", "valid_pixels", "coverage_fraction", F.when(kept, F.col("top.c")).alias("majority_code"), F.when(kept, -F.col("top.m") / F.col("valid_pixels")).alias("majority_fraction"))


def categorical_summary(pixels: DataFrame, zones: Sequence[str], code: str, valid: Column, least_coverage: float = 0.70) -> DataFrame:
    return majority_class(class_counts(pixels, zones, code, valid), zones, least_coverage)


def continuous_summary(pixels: DataFrame, zones: Sequence[str], value: str, valid: Column) -> DataFrame:
    """Zone, mean, exact median, valid_pixels, total_pixels, coverage_fraction; only valid finite values count."""
    v = F.col(value).cast("double")
    rows = pixels.select(*zones, F.when(F.coalesce(valid, F.lit(False)) & finite(v), v).alias("v"))
    z = rows.groupBy(*zones).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.count("v").alias("valid_pixels"), F.count(F.lit(1)).alias("total_pixels"))
    return z.withColumn("coverage_fraction", F.col("valid_pixels") / F.col("total_pixels"))


def raster_profile(pixels: DataFrame, raster: str, code: str) -> DataFrame:
    """Pixels of each class in each raster."""
    return pixels.groupBy(raster, code).agg(F.count(F.lit(1)).alias("pixels"))


def crop_history(counts: DataFrame, labels: DataFrame, least_coverage: float = 0.70) -> DataFrame:
    """One row for each (field_id, year) of class counts (field_id, year, code, n), with the class's name.

    Background 0 is invalid, declared no-data (null) is left out of the total. A class without a label is refused.
    """
    seen = counts.where("code is not null")
    checks.require_reference(seen.where("code <> 0").select("code"), labels, "code", "class labels")
    rows = majority_class(seen.withColumn("valid", F.col("code") != 0), ["field_id", "year"], least_coverage)
    return rows.join(labels.withColumnRenamed("code", "majority_code"), "majority_code", "left").select(
        "field_id", "year", F.col("majority_code").alias("cdl_code"), F.col("name").alias("cdl_name"), "majority_fraction", "coverage_fraction", "valid_pixels", "total_pixels"
    )


def tile_cells(polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """Polygons (with bounds) by the tiles (raster_id, tile_x, tile_y) that their bounds touch.

    ``grids`` has a row for each raster: raster_id, srid, x0, y0 (top left), pixel_size, tile_size in pixels, tiles_x,
    tiles_y. Raster and polygon must have the same srid.
    """
    side = F.col("pixel_size") * F.col("tile_size")
    spans = {"tile_x": (F.col("xmin") - F.col("x0"), F.col("xmax") - F.col("x0"), F.col("tiles_x")), "tile_y": (F.col("y0") - F.col("ymax"), F.col("y0") - F.col("ymin"), F.col("tiles_y"))}
    out = polygons.join(grids, "srid")
    for name, (lo, hi, n) in spans.items():
        a, b = F.greatest(F.lit(0), F.floor(lo / side).cast("int")), F.least(n - 1, F.floor(hi / side).cast("int"))
        out = out.withColumn(name, F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))))
    return out.select("raster_id", "tile_x", "tile_y", "field_id", "rings")


def zonal_counts(tiles: DataFrame, polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """raster_id, year, field_id, code, n: pixels whose centre lies in a polygon, counted within each tile.

    ``tiles``: raster_id, year, tile_x, tile_y, origin_x, origin_y (top left), pixel_size, width, height, values (row
    by row, null for no data). Tiles meet only polygons whose bounds touch them; no pixel leaves its tile.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                side = geometry.edges(r.rings)
                xs = r.origin_x + (np.arange(r.width) + 0.5) * r.pixel_size
                ys = r.origin_y - (np.arange(r.height) + 0.5) * r.pixel_size
                if not len(side):
                    continue
                cols = np.flatnonzero((xs >= side[:, [0, 2]].min()) & (xs <= side[:, [0, 2]].max()))
                rows = np.flatnonzero((ys >= side[:, [1, 3]].min()) & (ys <= side[:, [1, 3]].max()))
                if not len(cols) or not len(rows):
                    continue
                inside = geometry.inside_grid(side, xs[cols], ys[rows])
                values = np.asarray(r.values_, float).reshape(r.height, r.width)[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1][inside]
                none = np.isnan(values)
                for code, n in zip(*np.unique(values[~none].astype(np.int64), return_counts=True)):
                    out.append((r.raster_id, r.year, r.field_id, int(code), int(n)))
                if none.any():
                    out.append((r.raster_id, r.year, r.field_id, None, int(none.sum())))
            yield pd.DataFrame(out, columns=["raster_id", "year", "field_id", "code", "n"]).astype({"code": "Int32"})

    pairs = tiles.withColumnRenamed("values", "values_").join(tile_cells(polygons, grids), ["raster_id", "tile_x", "tile_y"])
    return pairs.mapInPandas(count, "raster_id string, year int, field_id string, code int, n long")


def nearest_resample(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], value: str, outside: int = 0) -> DataFrame:
    """Adds ``value`` of the coarse cell under each fine pixel's centre (x, y); ``outside`` where there is none.

    ``coarse``: keys, row, col, x0, y0, pixel_size (of its grid) and ``value``. Rows of ``keys`` that name different grids
    are refused.
    """
    where = ("x0", "y0", "pixel_size")
    grid = coarse.groupBy(*keys).agg(*[F.min(c).alias(c) for c in where], *[F.max(c).alias(f"_{c}") for c in where])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in where]
    grid = grid.select(*keys, *[F.when(F.assert_true(same[0] & same[1] & same[2], F.lit("a grid has rows that differ in origin or pixel size")).isNull(), F.col(c)).alias(c) for c in where])
    at = fine.join(grid, list(keys), "left").withColumn("_col", F.floor((F.col("x") - F.col("x0")) / F.col("pixel_size"))).withColumn("_row", F.floor((F.col("y0") - F.col("y")) / F.col("pixel_size"))).drop("x0", "y0", "pixel_size")
    cells = coarse.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(value))
    return at.join(cells, [*keys, "_row", "_col"], "left").drop("_row", "_col").withColumn(value, F.coalesce(value, F.lit(outside)))


def clear_fraction(pixels: DataFrame, scene: str, scene_class: str, in_field: Column) -> DataFrame:
    """Share of clear classes among each scene's field pixels; 0 for a scene without any."""
    z = pixels.groupBy(scene).agg(F.count_if(in_field).alias("n"), F.count_if(in_field & clear_class(F.col(scene_class))).alias("k"))
    return z.select(scene, F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("valid_fraction"))
