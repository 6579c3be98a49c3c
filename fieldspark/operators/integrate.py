"""One row for each field from fields, crops, soils and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.expressions import hectares
from fieldspark.operators import checks
from fieldspark.sources.scratch import bucketed

#: Columns of the integrated table, in order, with their types.
INTEGRATED = {
    "field_id": "string", "crop_2023_name": "string", "dominant_soil": "string", "dominant_soil_name": "string", "dominant_soil_mukey": "string", "dominant_soil_overlap_area_ha": "double",
    "mean_ndvi": "double", "ndvi_coverage_fraction": "double", "valid_pixel_count": "long", "total_pixel_count": "long",
}


def dominant_soils(overlaps: DataFrame) -> DataFrame:
    """Each field's map unit of the largest overlap_area_ha, of equal ones the least mukey as text.

    An aggregate of one struct for each field: combined before the shuffle, without a sort.
    """
    checks.require_columns(overlaps, ["field_id", "mukey", "musym", "muname", "overlap_area_ha"], "overlaps")
    row = F.struct((-F.col("overlap_area_ha")).alias("a"), F.col("mukey").cast("string").alias("k"), F.col("musym").alias("s"), F.col("muname").alias("n"))
    z = overlaps.where("overlap_area_ha is not null").groupBy("field_id").agg(F.min(row).alias("t"))
    return z.select("field_id", F.col("t.s").alias("dominant_soil"), F.col("t.n").alias("dominant_soil_name"), F.col("t.k").alias("dominant_soil_mukey"), (-F.col("t.a")).alias("dominant_soil_overlap_area_ha"))


def integrate_fields(fields: DataFrame, crops: DataFrame, soils: DataFrame, index: DataFrame) -> DataFrame:
    """One-to-one join on field_id, in canonical columns; keys must be unique and the same on all sides. Each side is written
    once, in buckets of the key, from which the gate reads and the join is made without a further exchange.

    A null index stays null; optional columns that a side lacks are null; ``coverage_fraction`` of the index becomes
    ``ndvi_coverage_fraction``. Further columns of the fields, such as geometry, are kept behind.
    """
    if "coverage_fraction" in index.columns:
        index = index.withColumnRenamed("coverage_fraction", "ndvi_coverage_fraction")
    sides = [fields, *(df.select("field_id", *[c for c in df.columns if c in INTEGRATED and c != "field_id"]) for df in (crops, soils, index))]
    sides = [bucketed(df, "side", "field_id") for df in sides]
    checks.require_one_to_one(dict(zip(("fields", "crops", "soils", "ndvi"), sides)), "field_id")
    out = sides[0]
    for df in sides[1:]:
        out = out.join(df.drop(*[c for c in df.columns if c in out.columns and c != "field_id"]), "field_id", "left")
    have = set(out.columns)
    main = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in INTEGRATED.items()]
    return out.select(*main, *[c for c in fields.columns if c not in INTEGRATED])


def integrated_dataset(fields: DataFrame, history: DataFrame, overlaps: DataFrame, index: DataFrame, year: int = 2023) -> DataFrame:
    """Integration of one year's crops, dominant soils by hectares and the index."""
    checks.require_columns(history, ["field_id", "year", "cdl_name"], "crop history")
    checks.require_columns(overlaps, ["field_id", "mukey", "musym", "muname", "overlap_area_m2"], "overlaps")
    crops = history.where(F.col("year") == year).select("field_id", F.col("cdl_name").alias("crop_2023_name"))
    return integrate_fields(fields, crops, dominant_soils(overlaps.withColumn("overlap_area_ha", hectares(F.col("overlap_area_m2")))), index)
