"""Satellite bands: grid gates, masks, scene choice, index by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.expressions import clear_class, has_data, ndvi
from fieldspark.operators import checks, zonal
from fieldspark.operators.places import global_places


def grid_findings(bands: DataFrame) -> DataFrame:
    """scene_id, bands, grids of the scenes in ``bands`` (scene_id, band, width, height, srid, x0, y0, pixel_size) whose red
    and nir rows don't have one grid, or that lack one of the two."""
    grid = F.struct("width", "height", "srid", "x0", "y0", "pixel_size")
    return bands.where(F.col("band").isin("red", "nir")).groupBy("scene_id").agg(F.count_distinct("band").alias("bands"), F.count_distinct(grid).alias("grids")).where("bands < 2 or grids > 1")


def require_same_grids(bands: DataFrame) -> DataFrame:
    """``bands``, in which ``grid_findings`` finds nothing."""
    if bad := sorted(r.scene_id for r in grid_findings(bands).limit(5).collect()):
        raise checks.CheckError(f"bands: red and nir grids differ in {', '.join(bad)}")
    return bands


def scene_order(scenes: DataFrame, region: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` from 1 by cloud cover (null last), time stamp and id, within each ``region``, which is one search's
    scenes; without regions the whole catalogue is ordered by ranges, as it may be of any size."""
    order = [F.asc_nulls_last("cloud_cover"), F.asc("datetime"), F.asc("scene_id")]
    if not region:
        return global_places(scenes, order, "rank").withColumn("rank", F.col("rank").cast("int"))
    return scenes.withColumn("rank", F.row_number().over(Window.partitionBy(*region).orderBy(*order)))


def choose_scenes(scenes: DataFrame, fractions: DataFrame, least: float = 0.70, region: list[str] | None = None) -> DataFrame:
    """Scenes in order with ``valid_fraction`` and ``status``: the first that reaches ``least`` is chosen, those before
    are rejected, those after not tried. Scenes without a fraction have 0."""
    ranked = scene_order(scenes, region).join(fractions, "scene_id", "left").withColumn("valid_fraction", F.coalesce("valid_fraction", F.lit(0.0)))
    first = F.min(F.when(F.col("valid_fraction") >= least, F.col("rank")))
    if region:
        ranked = ranked.withColumn("chosen", first.over(Window.partitionBy(*region)))
    else:
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(first.alias("chosen"))))  # one row
    status = F.when(F.col("rank") < F.coalesce("chosen", F.col("rank") + 1), "rejected").when(F.col("rank") == F.col("chosen"), "chosen").otherwise("untried")
    return ranked.withColumn("status", status).drop("chosen")


def require_scene(chosen: DataFrame, least: float = 0.70) -> DataFrame:
    if not chosen.where("status = 'chosen'").limit(1).count():
        raise checks.CheckError(f"scenes: none meets the {least:.2f} valid-class threshold")
    return chosen


def with_ndvi(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``ndvi`` to pixels (scene_id, red, nir, scl): clear class and data in both bands.

    ``bands``: scene_id, band, scale, offset, nodata; two rows a scene, joined as one.
    """
    wide = bands.groupBy("scene_id").agg(*[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{c}") for b in ("red", "nir") for c in ("scale", "offset", "nodata")])
    rows = pixels.join(wide, "scene_id")
    ok = clear_class(F.col("scl")) & has_data(F.col("red"), F.col("red_nodata")) & has_data(F.col("nir"), F.col("nir_nodata"))
    out = rows.withColumn("ok", ok).withColumn("ndvi", ndvi(F.col("red"), F.col("nir"), F.col("ok"), *[F.col(f"{b}_{c}") for b in ("red", "nir") for c in ("scale", "offset")]))
    return out.drop(*[f"{b}_{c}" for b in ("red", "nir") for c in ("scale", "offset", "nodata")])


def field_ndvi(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """field_id, mean_ndvi, median_ndvi, valid_pixel_count, total_pixel_count, coverage_fraction of field pixels.

    Every pixel in a field counts towards the total; a field without valid ones stays, with null mean and median.
    """
    z = zonal.continuous_summary(with_ndvi(pixels, bands), ["field_id"], "ndvi", F.col("ok"))
    return z.select("field_id", F.col("mean").alias("mean_ndvi"), F.col("median").alias("median_ndvi"), F.col("valid_pixels").alias("valid_pixel_count"), F.col("total_pixels").alias("total_pixel_count"), "coverage_fraction")


def require_valid_pixels(rows: DataFrame) -> DataFrame:
    return checks.require_rules(rows, {"a field has no valid pixel": F.col("valid_pixel_count") > 0}, "field index")
