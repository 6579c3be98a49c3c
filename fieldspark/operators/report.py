"""Field records, key figures for any selection, captions, rankings of soils and crops."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.expressions import filled, finite, ndvi_band, number_text, soil_label
from fieldspark.operators import checks
from fieldspark.sources.scratch import landed

#: Columns of a field record, names of figures.
RECORD = ("field_id", "area_ha", "crop_2023", "crop_2023_pixels", "soil_type", "soil_name", "mean_ndvi", "ndvi_coverage_fraction", "organic_matter_pct", "ph_h2o", "cec_cmol_kg", "carbon_storage_mg_c_ha")
#: Key figures that are means over the fields of a selection, by record column.
MEANS = {"mean_ndvi": "mean_ndvi", "mean_organic_matter_pct": "organic_matter_pct", "mean_ph": "ph_h2o", "mean_cec_cmol_kg": "cec_cmol_kg", "mean_carbon_storage_mg_c_ha": "carbon_storage_mg_c_ha"}
#: Words of a caption; a template may use n, all, field, area, crop, soil, index, organic_matter and ph, numbers with three
#: decimals at most. ``low``, ``middle`` and ``high`` follow the band of the mean index.
WORDS = {
    "none": "Nothing selected.", "one": "{field}: {area} ha of {crop} on {soil}.", "some": "{n} of {all} fields, {area} ha, mostly {crop}.", "every": "All {n} fields, mostly {crop}.",
    "low": "Index {index}: low.", "middle": "Index {index}: medium.", "high": "Index {index}: high.", "soil": "Organic matter {organic_matter} %, pH {ph}.",
}


def field_records(fields: DataFrame, crops: DataFrame, integrated: DataFrame, index: DataFrame, soil: DataFrame, year: int = 2023) -> DataFrame:
    """One record for each field of ``fields`` (field_id, area_ha); all sides must have just these fields, numbers must
    be finite and texts not empty. The records are written once, and counted against these rules as they are."""
    crops = crops.where(F.col("year") == year).select("field_id", F.col("cdl_name").alias("crop_2023"), F.col("valid_pixels").alias("crop_2023_pixels"))
    integrated = integrated.select("field_id", F.col("dominant_soil").alias("soil_type"), F.col("dominant_soil_name").alias("soil_name"))
    index = index.select("field_id", "mean_ndvi", F.col("coverage_fraction").alias("ndvi_coverage_fraction"))
    soil = soil.select("field_id", "organic_matter_pct", "ph_h2o", "cec_cmol_kg", "carbon_storage_mg_c_ha")
    checks.require_one_to_one({"fields": fields, "crops": crops, "integrated fields": integrated, "field index": index, "soil health": soil}, "field_id")
    out = fields.select("field_id", "area_ha")
    for df in (crops, integrated, index, soil):
        out = out.join(df, "field_id")
    out = out.select(*RECORD)
    rules = {f"non-finite {c}": finite(F.col(c).cast("double")) for c in ("area_ha", "crop_2023_pixels", *RECORD[6:])}
    rules |= {f"empty {c}": ~F.coalesce(F.col(c), F.lit("")).isin("", "nan") for c in ("crop_2023", "soil_type", "soil_name")}
    return checks.landed_by_rules(out, rules | {"non-integral crop_2023_pixels": F.col("crop_2023_pixels") == F.floor("crop_2023_pixels")}, "records")


def dominant_crop(crops: DataFrame, keys: list[str], name: str = "cdl_name", pixels: str = "valid_pixels") -> DataFrame:
    """The class with most pixels for each of ``keys`` (none: one row), of equal ones the first by name."""
    sums = crops.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.sum(pixels).alias("p"))
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("p")).alias("p"), F.col(name).alias("n")))["n"].alias("dominant_crop"))


def key_figures(records: DataFrame) -> DataFrame:
    """Key figures for every selection: soil_type and field_id, each null for all.

    ``GROUPING SETS`` over sums by (field_id, soil_type), and for the dominant crop over sums by crop too, so that the
    records are expanded once, as a row for each field and soil.
    """
    spark = records.sparkSession
    sums = ", ".join(f"avg({c}) AS {k}" for k, c in MEANS.items())
    sets = "GROUPING SETS ((), (soil_type), (field_id), (field_id, soil_type))"
    main = spark.sql(f"SELECT field_id, soil_type, 2 * grouping(field_id) + grouping(soil_type) AS g, count(*) AS field_count, sum(area_ha) AS total_area_ha, {sums}, avg(ndvi_coverage_fraction) * 100 AS ndvi_coverage_pct FROM {{r}} GROUP BY {sets}", r=records)
    crop = spark.sql("SELECT field_id, soil_type, 2 * grouping(field_id) + grouping(soil_type) AS g, crop_2023, sum(crop_2023_pixels) AS p FROM {r} GROUP BY GROUPING SETS ((crop_2023), (soil_type, crop_2023), (field_id, crop_2023), (field_id, soil_type, crop_2023))", r=records)
    best = crop.groupBy("field_id", "soil_type", "g").agg(F.min(F.struct((-F.col("p")).alias("p"), F.col("crop_2023").alias("n")))["n"].alias("dominant_crop_2023"))
    a, b = main.alias("a"), best.alias("b")
    on = (F.col("a.g") == F.col("b.g")) & F.col("a.field_id").eqNullSafe(F.col("b.field_id")) & F.col("a.soil_type").eqNullSafe(F.col("b.soil_type"))
    return a.join(b, on, "left").select("a.field_id", "a.soil_type", "field_count", "total_area_ha", "dominant_crop_2023", "ndvi_coverage_pct", *MEANS)


def select_fields(records: DataFrame, field_id: str | None = None, soil_type: str | None = None) -> DataFrame:
    """Records of a selection; an empty or missing value selects all."""
    out = records
    for c, v in (("field_id", field_id), ("soil_type", soil_type)):
        if v:
            out = out.where(F.col(c) == v)
    return out


def selection_figures(records: DataFrame, field_id: str | None = None, soil_type: str | None = None, words: Mapping[str, str] = WORDS) -> DataFrame:
    """One row of key figures with all_fields and a caption; figures are null and the count 0 where nothing matches."""
    own = select_fields(records, field_id, soil_type)
    top = dominant_crop(own, [], "crop_2023", "crop_2023_pixels")
    one = F.max_by(F.struct("field_id", "area_ha", "crop_2023", "soil_type", "soil_name"), "field_id")
    z = own.agg(F.count(F.lit(1)).alias("field_count"), F.sum("area_ha").alias("total_area_ha"), (F.avg("ndvi_coverage_fraction") * 100).alias("ndvi_coverage_pct"), *[F.avg(c).alias(k) for k, c in MEANS.items()], one.alias("_one"))
    whole = records.agg(F.count(F.lit(1)).alias("all_fields"))
    z = z.crossJoin(top).crossJoin(whole).withColumnRenamed("dominant_crop", "dominant_crop_2023")  # one row each
    return z.withColumn("caption", caption(bool(field_id or soil_type), words)).select("field_count", "all_fields", "total_area_ha", "dominant_crop_2023", "ndvi_coverage_pct", *MEANS, "caption")


def caption(active: bool, words: Mapping[str, str] = WORDS) -> Column:
    """Text on a row of figures with ``_one``, the struct of one of its fields: what is selected, the mean index in its
    band, and the soil. ``active``: whether anything but all fields may be selected."""
    n, mean = F.col("field_count"), F.col("mean_ndvi")
    numbers = {"index": mean, "organic_matter": F.col("mean_organic_matter_pct"), "ph": F.col("mean_ph"), "area": F.when((n == 1) & F.lit(active), F.col("_one.area_ha")).otherwise(F.col("total_area_ha"))}
    values = {k: number_text(v) for k, v in numbers.items()} | {
        "n": n, "all": F.col("all_fields"), "field": F.col("_one.field_id"), "soil": soil_label(F.col("_one.soil_type"), F.col("_one.soil_name")),
        "crop": F.when((n == 1) & F.lit(active), F.col("_one.crop_2023")).otherwise(F.col("dominant_crop_2023")),
    }
    text = {k: filled(t, values) for k, t in words.items()}
    first = F.when(n == 1, text["one"]).otherwise(text["some"]) if active else text["every"]
    band = ndvi_band(mean)
    said = F.when(band == "alert", text["low"]).when(band == "watch", text["middle"]).when(band == "developed", text["high"])
    return F.when(n == 0, text["none"]).otherwise(F.concat_ws(" ", first, said, text["soil"]))


def package_figures(records: DataFrame, weather: DataFrame, scene: DataFrame) -> DataFrame:
    """Key figures over all fields with the one-row weather (mean_anomaly_c, precip_mm) and scene (scene_date), written once,
    as the gate reads them too."""
    one = selection_figures(records).drop("all_fields", "caption")
    w = weather.select(F.col("mean_anomaly_c").alias("t2m_anomaly_c"), "precip_mm")
    return checks.require_finite(landed(one.crossJoin(w).crossJoin(scene.select("scene_date")), "figures"), [*MEANS, "total_area_ha", "ndvi_coverage_pct", "t2m_anomaly_c", "precip_mm"], "key figures")


def index_by(records: DataFrame, key: str, value: str = "mean_ndvi") -> DataFrame:
    """Fields and mean of ``value`` by ``key``."""
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("fields"), F.avg(value).alias("mean"))


def largest_mapunits(overlaps: DataFrame, k: int | None = None) -> DataFrame:
    """Map units by overlap area with their share of all, blank keys left out; with ``k`` the largest ones, ties by key."""
    z = overlaps.where(F.coalesce("mukey", F.lit("")) != "").groupBy("mukey", "musym", "muname").agg(F.sum("overlap_area_m2").alias("area_m2"))
    z = z.crossJoin(F.broadcast(z.agg(F.sum("area_m2").alias("_all")))).withColumn("share", F.col("area_m2") / F.col("_all")).drop("_all")  # one row
    return z if k is None else z.orderBy(F.desc("area_m2"), "mukey").limit(k)
