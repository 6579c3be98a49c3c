"""Queries of the operators over the driver's tables, each beside SQL that says the same.

Stand-ins: a zone or field is a supplier, a class a line number with 7 as background, a horizon a line, a component a
part, a map unit a brand, a site an order status, a polygon a rectangle from two vector components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import expressions as E
from fieldspark.operators import checks, crops, imagery, integrate, overlay, places, report, scan, soil, spatial, weather, zonal
from fieldspark.sources import readers, writers
from fieldspark.sources.scratch import landed, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of places, as sums depend on their order."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def text(c: str) -> Column:
    return F.col(c).cast("string")


# --- zones

@query("""
WITH c AS (SELECT l_suppkey, l_linenumber AS code, count(*) AS n FROM lineitem GROUP BY ALL),
z AS (SELECT l_suppkey, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (code <> 7), 0)::BIGINT AS valid FROM c GROUP BY 1),
t AS (SELECT l_suppkey, code, n FROM c WHERE code <> 7 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, code) = 1)
SELECT z.l_suppkey, total AS total_pixels, valid AS valid_pixels, round(valid / total, 6) AS coverage_fraction,
 CASE WHEN valid / total >= 0.857 THEN code END AS majority_code, CASE WHEN valid / total >= 0.857 THEN round(n / valid, 6) END AS majority_fraction
FROM z LEFT JOIN t USING (l_suppkey)""")
def zon1_majority_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zonal.categorical_summary(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", F.col("l_linenumber") != 7, 0.857))


@query("""
SELECT l_suppkey, round(avg(l_extendedprice) FILTER (l_returnflag <> 'R'), 4) AS mean, round(median(l_extendedprice) FILTER (l_returnflag <> 'R'), 4) AS median,
 count(*) FILTER (l_returnflag <> 'R') AS valid_pixels, count(*) AS total_pixels, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 4) AS coverage_fraction
FROM lineitem GROUP BY 1""")
def zon2_continuous_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zonal.continuous_summary(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_returnflag") != "R"), 4)


def class_history(spark: SparkSession, d: str, least: float = 0.6) -> DataFrame:
    """Majority line number of each supplier and year; 7 is background, 6 of returned lines has no data."""
    lines = table(spark, d, "lineitem")
    code = F.when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), None).when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber"))
    counts = lines.groupBy(text("l_suppkey").alias("field_id"), F.year("l_shipdate").alias("year"), code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    labels = lines.select(F.col("l_linenumber").alias("code"), F.concat(F.lit("class "), text("l_linenumber")).alias("name")).distinct()
    return zonal.crop_history(counts, labels, least)


HISTORY = """
c AS (SELECT l_suppkey::VARCHAR AS field_id, year(l_shipdate)::INT AS year, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS code, count(*) AS n
 FROM lineitem WHERE NOT (l_linenumber = 6 AND l_returnflag = 'R') GROUP BY ALL),
z AS (SELECT field_id, year, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (code <> 0), 0)::BIGINT AS valid FROM c GROUP BY ALL),
t AS (SELECT field_id, year, code, n FROM c WHERE code <> 0 QUALIFY row_number() OVER (PARTITION BY field_id, year ORDER BY n DESC, code) = 1),
history AS (SELECT z.field_id, z.year, CASE WHEN valid / total >= 0.6 AND valid > 0 THEN code END AS cdl_code, CASE WHEN valid / total >= 0.6 AND valid > 0 THEN 'class ' || code END AS cdl_name,
 CASE WHEN valid / total >= 0.6 AND valid > 0 THEN round(n / valid, 6) END AS majority_fraction, round(valid / total, 6) AS coverage_fraction, valid AS valid_pixels, total AS total_pixels
 FROM z LEFT JOIN t USING (field_id, year))"""


@query(f"WITH {HISTORY} SELECT * FROM history")
def zon4_crop_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(class_history(spark, d))


@query("SELECT year(l_shipdate)::INT AS year, l_linenumber, count(*) AS pixels FROM lineitem GROUP BY ALL")
def zon5_raster_profile(spark: SparkSession, d: str) -> DataFrame:
    return zonal.raster_profile(table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate")), "year", "l_linenumber")


YEARS = [1996, 1997, 1998]
_WIDE = ", ".join(f"max(CASE WHEN year = {y} THEN {c} END) AS crop_{y}_{n}" for y in YEARS for n, c in (("code", "cdl_code"), ("name", "cdl_name"), ("fraction", "majority_fraction"), ("coverage", "coverage_fraction")))


@query(f"WITH {HISTORY}, w AS (SELECT field_id, {_WIDE} FROM history GROUP BY 1) SELECT s_suppkey::VARCHAR AS field_id, s_name, w.* EXCLUDE (field_id) FROM supplier JOIN w ON s_suppkey::VARCHAR = w.field_id")
def piv1_join4_wide_history(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "supplier").select(text("s_suppkey").alias("field_id"), "s_name")
    return rounded(crops.join_history(fields, crops.wide_history(class_history(spark, d), YEARS)))


_NAMES = [f"crop_{y}_name" for y in YEARS]


@query(f"""WITH {HISTORY}, w AS (SELECT field_id, {_WIDE} FROM history GROUP BY 1)
SELECT field_id, {" || ' → ' || ".join(f"chr(64 + {n[:-5]}_code)" for n in _NAMES)} AS sequence, {" AND ".join(f"{n} IN ('class 1', 'class 2', 'class 3')" for n in _NAMES)} AS main_only,
 {" AND ".join(f"{a} <> {b}" for a, b in zip(_NAMES, _NAMES[1:]))} AS alternating FROM w WHERE {" AND ".join(f"{n} IS NOT NULL" for n in _NAMES)}""")
def exp9_exp10_rotations(spark: SparkSession, d: str) -> DataFrame:
    wide = crops.wide_history(class_history(spark, d), YEARS).dropna(subset=_NAMES)
    return crops.rotations(wide, YEARS, {f"class {k}": chr(64 + k) for k in range(1, 8)}, ["class 1", "class 2", "class 3"])


@query(f"""WITH {HISTORY}, f AS (SELECT count(*) AS field_count, round(sum(s_acctbal), 4) AS total_area_ha, round(avg(s_acctbal), 4) AS mean_area_ha, round(median(s_acctbal), 4) AS median_area_ha FROM supplier),
h AS (SELECT count(*) AS crop_record_count, count(*) FILTER (cdl_code IS NULL) AS missing_crop_record_count, 0::BIGINT AS duplicate_field_id_count FROM history) SELECT * FROM f, h""")
def agg1_field_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(crops.field_summary(table(spark, d, "supplier").withColumn("area_ha", F.col("s_acctbal")), class_history(spark, d)), 4)


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem" for c in _DESCRIBED))
def agg2_describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(crops.describe(table(spark, d, "lineitem"), _DESCRIBED), 4)


@query(f"WITH {HISTORY} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS missing FROM history" for c in ("field_id", "year", "cdl_code", "cdl_name", "majority_fraction", "coverage_fraction", "valid_pixels", "total_pixels")))
def agg2_missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return crops.missing_counts(class_history(spark, d))


@query("""WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, (max(l_extendedprice) - min(l_extendedprice)) / 8 AS w FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - a) / w), 7)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT g.bin::INT AS bin, round(a + g.bin * w, 4) AS lo, round(a + (g.bin + 1) * w, 4) AS hi, coalesce(n, 0) AS n FROM e, range(8) g(bin) LEFT JOIN c ON c.bin = g.bin""")
def agg3_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(crops.histogram(table(spark, d, "lineitem"), "l_extendedprice"), 4)


@query(f"WITH {HISTORY} SELECT cdl_name, count(*) AS n FROM history WHERE year = 1997 AND cdl_name IS NOT NULL GROUP BY 1")
def agg4_flt5_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return crops.value_counts(class_history(spark, d).where("year = 1997"), "cdl_name")


@query(f"""WITH {HISTORY} SELECT 'crop_history' AS product, count(*) AS rows, count(DISTINCT (field_id, year)) AS distinct_keys, count(*) FILTER (cdl_code IS NULL) AS missing FROM history
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), count(*) FILTER (o_totalprice IS NULL) FROM orders""")
def snk3_product_counts(spark: SparkSession, d: str) -> DataFrame:
    return crops.product_counts({"crop_history": (class_history(spark, d), ["field_id", "year"], ["cdl_code"]), "orders": (table(spark, d, "orders"), ["o_orderkey"], ["o_totalprice"])})


# --- imagery


def scene_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pixels: price and quantity as bands, 1 in 50 quantities as no data, parts as fields, suppliers as scenes."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scene_id"), F.concat(F.lit("F"), F.col("l_partkey") % 200).alias("field_id"), F.col("l_extendedprice").alias("red"), F.col("l_quantity").alias("nir"), F.col("l_linenumber").alias("scl"))


def scene_bands(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("red").alias("band"), F.lit(0.0001).alias("scale"), F.lit(-0.1).alias("offset"), F.lit(None).cast("double").alias("nodata")), F.struct(F.lit("nir").alias("band"), F.lit(0.2).alias("scale"), F.lit(0.1).alias("offset"), F.lit(50.0).alias("nodata")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.inline(pairs))


_PIXELS = """p AS (SELECT 'F' || (l_partkey % 200) AS field_id, l_suppkey, l_linenumber BETWEEN 4 AND 7 AND l_quantity <> 50 AS ok, l_extendedprice * 0.0001 - 0.1 AS r, l_quantity * 0.2 + 0.1 AS n, l_returnflag FROM lineitem),
v AS (SELECT *, CASE WHEN ok AND n + r <> 0 THEN greatest(-1, least(1, (n - r) / (n + r))) END AS ndvi FROM p)"""


@query(f"WITH {_PIXELS} SELECT field_id, round(avg(ndvi), 6) AS mean_ndvi, round(median(ndvi), 6) AS median_ndvi, count(ndvi) AS valid_pixel_count, count(*) AS total_pixel_count, round(count(ndvi) / count(*), 6) AS coverage_fraction FROM v GROUP BY 1")
def zon9_exp1_field_ndvi(spark: SparkSession, d: str) -> DataFrame:
    bands = scene_bands(spark, d)
    return rounded(imagery.require_valid_pixels(imagery.field_ndvi(scene_pixels(spark, d), bands)))


_FRACTIONS = "f AS (SELECT l_suppkey::VARCHAR AS scene_id, CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN count(*) FILTER (l_returnflag = 'N' AND l_linenumber BETWEEN 4 AND 7) / count(*) FILTER (l_returnflag = 'N') ELSE 0 END AS valid_fraction FROM lineitem GROUP BY 1)"


def fractions(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "lineitem").withColumn("scene_id", text("l_suppkey"))
    return zonal.clear_fraction(pixels, "scene_id", "l_linenumber", F.col("l_returnflag") == "N")


@query(f"WITH {_FRACTIONS} SELECT scene_id, round(valid_fraction, 6) AS valid_fraction FROM f")
def zon8_flt3_clear_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fractions(spark, d))


@query(f"""WITH {_FRACTIONS}, s AS (SELECT s_suppkey::VARCHAR AS scene_id, s_nationkey AS region, s_name AS datetime, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS cloud_cover FROM supplier),
r AS (SELECT s.*, coalesce(valid_fraction, 0) AS valid_fraction, row_number() OVER (PARTITION BY region ORDER BY cloud_cover ASC NULLS LAST, datetime, s.scene_id)::INT AS rank FROM s LEFT JOIN f USING (scene_id)),
c AS (SELECT *, min(rank) FILTER (valid_fraction >= 0.57) OVER (PARTITION BY region) AS chosen FROM r)
SELECT scene_id, region, rank, round(valid_fraction, 6) AS valid_fraction, CASE WHEN rank < coalesce(chosen, rank + 1) THEN 'rejected' WHEN rank = chosen THEN 'chosen' ELSE 'untried' END AS status FROM c""")
def top3_scene_choice(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, "supplier").select(text("s_suppkey").alias("scene_id"), F.col("s_nationkey").alias("region"), F.col("s_name").alias("datetime"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("cloud_cover"))
    return rounded(imagery.choose_scenes(scenes, fractions(spark, d), 0.57, ["region"]).select("scene_id", "region", "rank", "valid_fraction", "status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, coalesce(max(p_size), 0)::INT AS code FROM lineitem LEFT JOIN part
 ON p_partkey // 50 = (l_partkey // 100) // 2 AND p_partkey % 50 = (l_partkey % 100) // 2 GROUP BY 1, 2, 3""")
def zon6_nearest_resample(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_partkey")
    fine = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n")).withColumn("x", key % 100 + 0.5).withColumn("y", -(F.floor(key / 100) + 0.5)).withColumn("g", F.lit(1))
    coarse = table(spark, d, "part").select(F.lit(1).alias("g"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2.0).alias("pixel_size"), F.col("p_size").alias("code"))
    return zonal.nearest_resample(fine, coarse, ["g"], "code").select("l_orderkey", "l_linenumber", "l_partkey", "n", "code")


# --- soil

_SOIL_SQL = """
hz AS (SELECT DISTINCT l_partkey::VARCHAR AS cokey, 5.0 * (l_linenumber - 1) AS t, 5.0 * (l_linenumber - 1) + l_quantity AS b, CASE WHEN l_discount > 0 THEN l_discount * 50 END AS om, 4 + l_tax * 50 AS ph, l_quantity AS cec, 1 + l_discount AS bd, l_tax AS k FROM lineitem),
w AS (SELECT *, greatest(0, least(b, 30) - greatest(t, 0)) AS w FROM hz WHERE greatest(0, least(b, 30) - greatest(t, 0)) > 0),
comp AS (SELECT cokey, sum(om * w) / sum(w) FILTER (om IS NOT NULL) AS m1, -log10(sum(pow(10, -ph) * w) / sum(w)) AS m2, sum(cec * w) / sum(w) AS m3, sum(k * w) / sum(w) AS m4, sum(bd * w * om / 1.724) AS m5 FROM w GROUP BY 1),
c AS (SELECT p_brand AS mukey, p_size::DOUBLE AS p, cokey IS NOT NULL AS profile, m1, m2, m3, m4, m5 FROM part LEFT JOIN comp ON p_partkey::VARCHAR = cokey WHERE p_size > 0),
mu AS (SELECT mukey, bool_or(profile) AS soil, sum(m1 * p) / sum(p) FILTER (m1 IS NOT NULL) AS m1, -log10(sum(pow(10, -m2) * p) / sum(p) FILTER (m2 IS NOT NULL)) AS m2, sum(m3 * p) / sum(p) FILTER (m3 IS NOT NULL) AS m3,
 sum(m4 * p) / sum(p) FILTER (m4 IS NOT NULL) AS m4, sum(m5 * p) / sum(p) FILTER (m5 IS NOT NULL) AS m5, """ + ", ".join(f"coalesce(sum(p) FILTER (m{k} IS NOT NULL), 0) / sum(p) AS c{k}" for k in range(1, 6)) + """ FROM c GROUP BY 1),
o AS (SELECT l_suppkey::VARCHAR AS field_id, p_brand AS mukey, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) * 0.9 AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand),
health AS (SELECT field_id, """ + ", ".join(
    [f"{'-log10(' if k == 2 else ''}sum({'pow(10, -m2)' if k == 2 else f'm{k}'} * f * c{k}) FILTER (f * c{k} > 0) / sum(f * c{k}) FILTER (m{k} IS NOT NULL AND f * c{k} > 0){')' if k == 2 else ''} AS {m.name}" for k, m in enumerate(soil.METRICS, 1)]
    + ["least(1, coalesce(sum(f) FILTER (soil), 0)) AS soil_coverage_fraction"] + [f"least(1, coalesce(sum(f * c{k}) FILTER (m{k} IS NOT NULL), 0)) AS {m.coverage}" for k, m in enumerate(soil.METRICS, 1)]
) + " FROM o LEFT JOIN mu USING (mukey) GROUP BY 1)"


def soil_tables(spark: SparkSession, d: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, horizons and shares; equal horizons of several lines are not yet one."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    top = 5.0 * (F.col("l_linenumber") - 1)
    organic = F.when(F.col("l_discount") > 0, F.col("l_discount") * 50)
    horizons = lines.select(F.col("l_partkey").alias("cokey"), top.alias("hzdept_r"), (top + F.col("l_quantity")).alias("hzdepb_r"), organic.alias("om_r"), (4 + F.col("l_tax") * 50).alias("ph1to1h2o_r"), F.col("l_quantity").alias("cec7_r"), (1 + F.col("l_discount")).alias("dbthirdbar_r"), F.col("l_tax").alias("kwfact"))
    components = part.select(F.col("p_brand").alias("mukey"), F.col("p_partkey").alias("cokey"), F.col("p_size").cast("double").alias("comppct_r"), F.col("p_name").alias("compname"))
    return components, horizons, brand_shares(spark, d, 0.9, counts)


def brand_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each supplier and brand."""
    return table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))


def brand_shares(spark: SparkSession, d: str, whole: float = 1.0, counts: DataFrame | None = None) -> DataFrame:
    """Share of each brand in each supplier's lines, as the part of a field that a map unit covers."""
    n = brand_counts(spark, d) if counts is None else counts
    total = n.groupBy("l_suppkey").agg(F.sum("n").alias("all"))
    return n.join(total, "l_suppkey").select(text("l_suppkey").alias("field_id"), F.col("p_brand").alias("mukey"), (F.col("n") / F.col("all") * whole).alias("field_fraction"))


def soil_health(spark: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    return soil.aggregate_soil(*soil_tables(spark, d, counts), once=True)


_SOIL_OUT = ", ".join(f"round({c}, 5) AS {c}" for c in [m.name for m in soil.METRICS] + ["soil_coverage_fraction"] + [m.coverage for m in soil.METRICS])


@query(f"WITH {_SOIL_SQL} SELECT field_id, {_SOIL_OUT} FROM health")
def agg7_agg10_soil_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(soil_health(spark, d), 5)


@query(f"WITH {_SOIL_SQL} SELECT cokey, round(m1 + 3e-11, 8) AS organic_matter_pct, round(m2 + 3e-11, 8) AS ph_h2o, round(m3 + 3e-11, 8) AS cec_cmol_kg, round(m4 + 3e-11, 8) AS erosion_k_factor, round(m5 + 3e-9, 6) AS carbon_storage_mg_c_ha FROM comp")
def agg7_agg8_component_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = soil.component_metrics(soil_tables(spark, d)[1].repartition("cokey").distinct()).where("has_profile").drop("has_profile").withColumn("cokey", text("cokey"))
    places = {m.name: 6 if m.source is None else 8 for m in soil.METRICS}  # a little is added, as many values end in a tie
    return out.withColumns({c: F.round(F.col(c) + 3.0 * 10.0 ** (-n - 3), n) for c, n in places.items()})


@query(f"WITH {_SOIL_SQL} SELECT mukey, soil AS has_soil, {', '.join(f'round(m{k}, 5) AS {m.name}, round(c{k}, 5) AS {m.name}_coverage' for k, m in enumerate(soil.METRICS, 1))} FROM mu")
def agg9_mapunit_metrics(spark: SparkSession, d: str) -> DataFrame:
    components, horizons, _ = soil_tables(spark, d)
    return rounded(soil.mapunit_metrics(components, soil.component_metrics(horizons.repartition("cokey").distinct())), 5)


@query(f"WITH {_SOIL_SQL} " + " UNION ALL ".join(f"SELECT '{m.name}' AS metric, '{m.unit}' AS unit, round(avg({m.name}), 5) AS mean, round(median({m.name}), 5) AS median, count({m.name}) AS non_null_fields, round(avg({m.coverage}), 5) AS mean_coverage_fraction FROM health" for m in soil.METRICS))
def agg11_piv2_soil_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(soil.soil_summary(soil_health(spark, d)), 5)


# --- weather

_DAILY = "d AS (SELECT o_orderstatus AS site_id, o_orderdate::DATE AS date, round(avg(o_totalprice), 6) AS t2m_c, round(sum(o_totalprice) / 1000, 6) AS precip_mm FROM orders GROUP BY ALL)"
_ANALYSED = f"""{_DAILY}, y AS (SELECT *, dayofyear(make_date(2000, month(date), day(date)))::INT AS day_of_year,
 CASE WHEN count(t2m_c) OVER w = 7 THEN avg(t2m_c) OVER w END AS t2m_7d_c FROM d WINDOW w AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
b AS (SELECT site_id, day_of_year, avg(t2m_c) AS baseline_t2m_c FROM y WHERE year(date) BETWEEN 1995 AND 1999 GROUP BY ALL),
a AS (SELECT y.*, baseline_t2m_c, CASE WHEN year(date) = 2000 THEN t2m_c - baseline_t2m_c END AS t2m_anomaly_c FROM y LEFT JOIN b USING (site_id, day_of_year))"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("site_id"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("t2m_c"), F.round(F.sum("o_totalprice") / 1000, 6).alias("precip_mm"))


def analysed(spark: SparkSession, d: str) -> DataFrame:
    return weather.analyse(daily(spark, d), 1995, 1999, 2000)


@query(f"WITH {_ANALYSED} SELECT site_id, date, t2m_c, precip_mm, round(t2m_7d_c + 3e-7, 4) AS t2m_7d_c, day_of_year, round(baseline_t2m_c + 3e-7, 4) AS baseline_t2m_c, round(t2m_anomaly_c + 3e-7, 4) AS t2m_anomaly_c FROM a")
def win1_win3_exp5_weather(spark: SparkSession, d: str) -> DataFrame:
    return analysed(spark, d).withColumns({c: F.round(F.col(c) + 3e-7, 4) for c in ("t2m_7d_c", "baseline_t2m_c", "t2m_anomaly_c")})


@query(f"WITH {_DAILY} SELECT site_id, count(*) AS gaps FROM (SELECT site_id, date - lag(date) OVER (PARTITION BY site_id ORDER BY date) AS days FROM d) WHERE days <> 1 GROUP BY 1")
def win4_gap_counts(spark: SparkSession, d: str) -> DataFrame:
    return weather.gaps(daily(spark, d)).groupBy("site_id").agg(F.count(F.lit(1)).alias("gaps"))


@query(f"WITH {_ANALYSED} SELECT site_id, count(*) AS record_count, round(avg(t2m_anomaly_c), 2) AS mean_anomaly_c, round(coalesce(sum(precip_mm) FILTER (year(date) = 2000), 0), 2) AS precip_mm FROM a GROUP BY 1")
def agg12_year_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weather.year_summary(analysed(spark, d), 2000), 2)


@query(f"""WITH {_ANALYSED}, e AS (SELECT site_id, date, t2m_anomaly_c AS v, row_number() OVER (PARTITION BY site_id ORDER BY t2m_anomaly_c, date) AS lo, row_number() OVER (PARTITION BY site_id ORDER BY t2m_anomaly_c DESC, date) AS hi FROM a WHERE t2m_anomaly_c IS NOT NULL)
SELECT site_id, max(date) FILTER (lo = 1) AS coldest_date, round(max(v) FILTER (lo = 1), 2) AS coldest_c, max(date) FILTER (hi = 1) AS warmest_date, round(max(v) FILTER (hi = 1), 2) AS warmest_c FROM e GROUP BY 1""")
def top4_anomaly_extremes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weather.anomaly_extremes(analysed(spark, d)), 2)


@query("""WITH n AS (SELECT o_orderstatus AS site_id, o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT site_id, min(date) AS a, max(date) AS b FROM n GROUP BY 1),
g AS (SELECT site_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM e)
SELECT site_id, date, n::DOUBLE AS t2m_c, NULLIF(n % 5, 0)::DOUBLE AS precip_mm FROM g LEFT JOIN n USING (site_id, date)""")
def src3_parse_daily(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and day as one JSON body a status, from its first day to its last; days without orders have the
    fill value, as does every fifth count as rain."""
    days = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("site_id"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    every = days.groupBy("site_id").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    rows = every.join(days, ["site_id", "date"], "left").withColumn("k", F.date_format("date", "yyyyMMdd"))
    values = {"T2M": F.coalesce(F.col("n").cast("double"), F.lit(readers.FILL)), "PRECTOTCORR": F.when(F.col("n") % 5 != 0, (F.col("n") % 5).cast("double")).otherwise(F.lit(readers.FILL))}
    maps = rows.groupBy("site_id").agg(*[F.map_from_entries(F.collect_list(F.struct("k", v.alias("v")))).alias(n) for n, v in values.items()])
    body = F.to_json(F.struct(F.struct(F.struct("T2M", "PRECTOTCORR").alias("parameter")).alias("properties")))
    return readers.parse_daily(landed(maps.select("site_id", body.alias("payload")), "payloads"))


# --- integration and report

_SHARES = "o AS (SELECT l_suppkey::VARCHAR AS field_id, p_brand AS mukey, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_DOMINANT = f"{_SHARES}, dom AS (SELECT field_id, mukey, n FROM o QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY n DESC, mukey) = 1)"


def brand_overlaps(spark: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    n = brand_counts(spark, d) if counts is None else counts
    n = n.select(text("l_suppkey").alias("field_id"), F.col("p_brand").alias("mukey"), "n")
    return n.select("field_id", "mukey", F.concat(F.lit("s-"), "mukey").alias("musym"), F.concat(F.lit("soil "), "mukey").alias("muname"), (F.col("n") * 10_000.0).alias("overlap_area_m2"))


@query(f"WITH {_DOMINANT} SELECT field_id, 's-' || mukey AS dominant_soil, 'soil ' || mukey AS dominant_soil_name, mukey AS dominant_soil_mukey, n::DOUBLE AS dominant_soil_overlap_area_ha FROM dom")
def top1_dominant_soils(spark: SparkSession, d: str) -> DataFrame:
    return integrate.dominant_soils(brand_overlaps(spark, d).withColumn("overlap_area_ha", E.hectares(F.col("overlap_area_m2"))))


def order_history(spark: SparkSession, d: str) -> DataFrame:
    """A class for each supplier and year: the most frequent return flag and line status."""
    rows = table(spark, d, "lineitem").where(F.year("l_shipdate") == 1997).groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("valid_pixels"))
    rows = rows.select(text("l_suppkey").alias("field_id"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("cdl_name"), "valid_pixels")
    return crops.rank_first(rows, ["field_id"], [F.desc("valid_pixels"), F.col("cdl_name")]).withColumn("year", F.lit(1997))


def supplier_index(spark: SparkSession, d: str) -> DataFrame:
    """Index of each supplier's lines; suppliers are numbers until one row is left of each."""
    return imagery.field_ndvi(scene_pixels(spark, d).withColumn("field_id", F.col("scene_id")), scene_bands(spark, d)).withColumn("field_id", text("field_id"))


_CROPS = "crop AS (SELECT l_suppkey::VARCHAR AS field_id, l_returnflag || '/' || l_linestatus AS name, count(*)::BIGINT AS px FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY l_suppkey, l_returnflag, l_linestatus QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag || '/' || l_linestatus) = 1)"
_INDEX = f"{_PIXELS}, ix AS (SELECT l_suppkey::VARCHAR AS field_id, avg(ndvi) AS mean_ndvi, count(ndvi) AS valid_pixel_count, count(*) AS total_pixel_count, count(ndvi) / count(*) AS coverage FROM v GROUP BY 1)"


@query(f"""WITH {_DOMINANT}, {_CROPS}, {_INDEX} SELECT field_id, name AS crop_2023_name, 's-' || mukey AS dominant_soil, 'soil ' || mukey AS dominant_soil_name, mukey AS dominant_soil_mukey, dom.n::DOUBLE AS dominant_soil_overlap_area_ha,
 round(mean_ndvi, 6) AS mean_ndvi, round(coverage, 6) AS ndvi_coverage_fraction, valid_pixel_count, total_pixel_count FROM dom JOIN crop USING (field_id) JOIN ix USING (field_id)""")
def join1_join2_integrated(spark: SparkSession, d: str) -> DataFrame:
    history, overlaps, index, fields = farm(spark, d)
    return rounded(integrate.integrated_dataset(fields.select("field_id"), history, overlaps, index, 1997))


def farm(spark: SparkSession, d: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Crops, soil overlaps and index of all suppliers with lines in the year, and these suppliers, areas from account
    balances. Each is written once, as gates and joins both read it, the index without the median, which no record has."""
    history = landed(order_history(spark, d), "history")
    fields = table(spark, d, "supplier").join(history.select("field_id"), F.col("field_id") == text("s_suppkey"), "left_semi").select(text("s_suppkey").alias("field_id"), F.abs("s_acctbal").alias("area_ha"))
    only = lambda df, label: landed(df.join(fields, "field_id", "left_semi"), label)
    return history, only(brand_overlaps(spark, d, counts), "overlaps"), only(supplier_index(spark, d).drop("median_ndvi"), "index"), landed(fields, "fields")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Field records of all suppliers with lines; overlaps and soils share the counts of lines by brand."""
    counts = landed(brand_counts(spark, d), "counts")
    history, overlaps, index, fields = farm(spark, d, counts)
    integrated = integrate.integrated_dataset(fields.select("field_id"), history, overlaps, index, 1997)
    health = landed(soil_health(spark, d, counts).join(fields, "field_id", "left_semi"), "health")
    return report.field_records(fields, history, landed(integrated, "integrated"), index, health, 1997)


_RECORDS = f"""{_DOMINANT.replace("o AS", "oo AS").replace("FROM o ", "FROM oo ")}, {_CROPS}, {_INDEX}, {_SOIL_SQL.replace("c AS (SELECT p_brand", "cc AS (SELECT p_brand").replace("FROM c GROUP", "FROM cc GROUP")},
rec AS (SELECT dom.field_id, abs(s_acctbal) AS area_ha, name AS crop_2023, px AS crop_2023_pixels, 's-' || mukey AS soil_type, 'soil ' || mukey AS soil_name, mean_ndvi, coverage AS ndvi_coverage_fraction, organic_matter_pct, ph_h2o, cec_cmol_kg, carbon_storage_mg_c_ha
 FROM dom JOIN crop USING (field_id) JOIN ix USING (field_id) JOIN health USING (field_id) JOIN supplier ON s_suppkey::VARCHAR = dom.field_id)"""


@query(f"WITH {_RECORDS} SELECT field_id, round(area_ha, 4) AS area_ha, crop_2023, crop_2023_pixels, soil_type, soil_name, {', '.join(f'round({c}, 4) AS {c}' for c in report.RECORD[6:])} FROM rec")
def join6_field_records(spark: SparkSession, d: str) -> DataFrame:
    return rounded(records(spark, d), 4)


_FIGURES = ", ".join(f"round(avg({c}), 4) AS {k}" for k, c in report.MEANS.items())


@query(f"""WITH {_RECORDS}, g AS (SELECT field_id, soil_type, grouping(field_id) AS gf, grouping(soil_type) AS gs, count(*) AS field_count, round(sum(area_ha), 3) AS total_area_ha, round(avg(ndvi_coverage_fraction) * 100, 4) AS ndvi_coverage_pct, {_FIGURES}
 FROM rec GROUP BY GROUPING SETS ((), (soil_type), (field_id), (field_id, soil_type))),
k AS (SELECT field_id, soil_type, grouping(field_id) AS gf, grouping(soil_type) AS gs, crop_2023, sum(crop_2023_pixels) AS px FROM rec GROUP BY GROUPING SETS ((crop_2023), (soil_type, crop_2023), (field_id, crop_2023), (field_id, soil_type, crop_2023))
 QUALIFY row_number() OVER (PARTITION BY field_id, soil_type, gf, gs ORDER BY px DESC, crop_2023) = 1)
SELECT g.field_id, g.soil_type, field_count, total_area_ha, crop_2023 AS dominant_crop_2023, ndvi_coverage_pct, {", ".join(report.MEANS)} FROM g LEFT JOIN k ON g.gf = k.gf AND g.gs = k.gs AND g.field_id IS NOT DISTINCT FROM k.field_id AND g.soil_type IS NOT DISTINCT FROM k.soil_type""")
def agg14_agg15_key_figures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.key_figures(records(spark, d)).withColumn("total_area_ha", F.round("total_area_ha", 3)), 4)


@query(f"WITH {_RECORDS} SELECT crop_2023, count(*) AS fields, round(avg(mean_ndvi), 5) AS mean FROM rec GROUP BY 1")
def agg5_index_by_crop(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.index_by(records(spark, d), "crop_2023"), 5)


@query("""WITH o AS (SELECT p_brand AS mukey, count(*)::DOUBLE * 10000 AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT mukey, 's-' || mukey AS musym, 'soil ' || mukey AS muname, a AS area_m2, round(a / (SELECT sum(a) FROM o), 6) AS share FROM o ORDER BY a DESC, mukey LIMIT 5""")
def agg6_largest_mapunits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.largest_mapunits(brand_overlaps(spark, d), 5))


@query("WITH c AS (SELECT n_regionkey, l_returnflag AS name, sum(l_quantity) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) SELECT n_regionkey, name AS dominant_crop FROM c QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY p DESC, name) = 1")
def agg13_join3_dominant_crop(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = table(spark, d, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return report.dominant_crop(rows, ["n_regionkey"], "l_returnflag", "l_quantity")


def _number(x: str) -> str:
    """SQL of a number with commas and three decimals at most."""
    return f"CASE WHEN round({x}, 3) < 0 THEN '-' ELSE '' END || regexp_replace(format('{{:,}}', trunc(abs(round({x}, 3)))::BIGINT) || '.' || lpad((round(abs({x}) * 1000)::BIGINT % 1000)::VARCHAR, 3, '0'), '\\.?0+$', '')"


_CAPTION = f"""CASE WHEN c = 0 THEN 'Nothing selected.' ELSE CASE WHEN c = 1 THEN f || ': ' || {_number("a")} || ' ha of ' || crop1 || ' on ' || soil1 || '.' ELSE c || ' of ' || every || ' fields, ' || {_number("area")} || ' ha, mostly ' || crop || '.' END
 || ' Index ' || {_number("ndvi")} || CASE WHEN ndvi < 0.3 THEN ': low.' WHEN ndvi <= 0.6 THEN ': medium.' ELSE ': high.' END || ' Organic matter ' || {_number("om")} || ' %, pH ' || {_number("ph")} || '.' END"""


@query(f"""WITH {_RECORDS}, picks AS (SELECT min(soil_type) AS soil, min(field_id) AS field FROM rec),
sel AS (SELECT 'soil' AS pick, rec.* FROM rec, picks WHERE soil_type = soil UNION ALL SELECT 'field', rec.* FROM rec, picks WHERE field_id = field UNION ALL SELECT 'neither', rec.* FROM rec, picks WHERE field_id = field AND soil_type = 'none such'),
t AS (SELECT pick, crop_2023 AS crop FROM sel GROUP BY pick, crop_2023 QUALIFY row_number() OVER (PARTITION BY pick ORDER BY sum(crop_2023_pixels) DESC, crop_2023) = 1),
z AS (SELECT p.pick, count(field_id) AS c, sum(area_ha) AS area, avg(mean_ndvi) AS ndvi, avg(organic_matter_pct) AS om, avg(ph_h2o) AS ph, max(field_id) AS f, max(area_ha) AS a, max(crop_2023) AS crop1, max(soil_type || ' — ' || soil_name) AS soil1, (SELECT count(*) FROM rec) AS every
 FROM (VALUES ('soil'), ('field'), ('neither')) p(pick) LEFT JOIN sel USING (pick) GROUP BY 1)
SELECT pick, c AS field_count, every AS all_fields, round(area, 3) AS total_area_ha, round(ndvi, 4) AS mean_ndvi, {_CAPTION} AS caption FROM z LEFT JOIN t USING (pick)""")
def flt6_exp7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Figures and captions of three selections: by soil, by field, and one that nothing meets."""
    rows = records(spark, d)
    least = rows.agg(F.min("soil_type").alias("soil"), F.min("field_id").alias("field")).first()
    picks = {"soil": (None, least["soil"]), "field": (least["field"], None), "neither": (least["field"], "none such")}
    out = None
    for name, (field, soil_type) in picks.items():
        one = report.selection_figures(rows, field, soil_type).select(F.lit(name).alias("pick"), "field_count", "all_fields", F.round("total_area_ha", 3).alias("total_area_ha"), F.round("mean_ndvi", 4).alias("mean_ndvi"), "caption")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_RECORDS}, {_ANALYSED.replace("y AS (", "yy AS (").replace("FROM y", "FROM yy").replace("y.*", "yy.*").replace("yy.*", "yy.*").replace("b AS (SELECT site_id", "bb AS (SELECT site_id").replace("JOIN b USING", "JOIN bb USING").replace("a AS (SELECT yy", "aa AS (SELECT yy")},
wx AS (SELECT avg(t2m_anomaly_c) AS t2m_anomaly_c, coalesce(sum(precip_mm) FILTER (year(date) = 2000), 0) AS precip_mm FROM aa WHERE site_id = (SELECT min(site_id) FROM aa)),
k AS (SELECT crop_2023 FROM rec GROUP BY 1 ORDER BY sum(crop_2023_pixels) DESC, crop_2023 LIMIT 1)
SELECT count(*) AS field_count, round(sum(area_ha), 3) AS total_area_ha, (SELECT crop_2023 FROM k) AS dominant_crop_2023, round(avg(ndvi_coverage_fraction) * 100, 4) AS ndvi_coverage_pct, {_FIGURES}, (SELECT round(t2m_anomaly_c, 2) FROM wx) AS t2m_anomaly_c, (SELECT round(precip_mm, 2) FROM wx) AS precip_mm,
 (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem) AS scene_date FROM rec""")
def agg14_package_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures over all fields with the year's weather of the first site and the date of the last line as the scene's."""
    series = weather.year_summary(analysed(spark, d), 2000)
    first = series.join(series.agg(F.min("site_id").alias("site_id")), "site_id")
    scene = table(spark, d, "lineitem").agg(E.date_of_stamp(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd'T'HH:mm:ss")).alias("scene_date"))
    out = report.package_figures(records(spark, d), first.select("mean_anomaly_c", "precip_mm"), scene)
    return rounded(out.withColumn("total_area_ha", F.round("total_area_ha", 3)).withColumns({c: F.round(c, 2) for c in ("t2m_anomaly_c", "precip_mm")}), 4)


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS mukey, count(*)::DOUBLE AS a FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT c_custkey::VARCHAR AS field_id, coalesce(mukey, '') AS mukey, coalesce('s-' || mukey, '') AS musym, coalesce('soil ' || mukey, '') AS muname, coalesce(a, 0) AS overlap_area_m2, 1000.0::DOUBLE AS field_area_m2, round(coalesce(a / 1000, 0), 6) AS field_fraction
FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def geo7_set1_join7_overlap_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers as fields, priorities of their pending orders as map units; customers without any are uncovered."""
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(text("o_custkey").alias("field_id"), F.col("o_orderpriority").alias("mukey")).agg(F.count(F.lit(1)).cast("double").alias("overlap_area_m2"))
    shares = landed(n.withColumn("field_area_m2", F.lit(1000.0)).withColumn("field_fraction", F.col("overlap_area_m2") / 1000), "shares")
    units = shares.select("mukey").distinct().select("mukey", F.concat(F.lit("s-"), "mukey").alias("musym"), F.concat(F.lit("soil "), "mukey").alias("muname"))
    fields = table(spark, d, "customer").select(text("c_custkey").alias("field_id"), F.lit(1000.0).alias("field_area_m2"))
    return rounded(spatial.overlap_table(fields, shares, units))


@query("""WITH n AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), f AS (SELECT l_suppkey::VARCHAR AS field_id, p_brand, n / sum(n) OVER (PARTITION BY l_suppkey) * 0.9 AS f FROM n)
SELECT field_id, round(sum(f), 6) AS covered, count(DISTINCT p_brand) AS mapunits FROM f GROUP BY 1 HAVING sum(f) < 1 - 1e-9""")
def flt7_agg16_uncovered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.uncovered(brand_shares(spark, d, 0.9)))


# --- space


def rectangles(spark: SparkSession, d: str, key: str, parity: int | None = None) -> DataFrame:
    """Rectangles of 0.05 by 0.04 from the first two components of vectors; ``parity`` tells two sides of a join apart.
    As map units, 25 share a key, so that several polygons of one overlap."""
    e = table(spark, d, "embeddings")
    if parity is not None:
        e = e.where(F.col("vec_id") % 2 == parity)
    x, y = F.round(F.col("embedding")[0].cast("double"), 4), F.round(F.col("embedding")[1].cast("double"), 4)
    ring = F.struct(F.lit(1).alias("sign"), F.array(x, x + 0.05, x + 0.05, x).alias("xs"), F.array(y, y, y + 0.04, y + 0.04).alias("ys"))
    name = F.floor(F.col("vec_id") / 50) if key == "mukey" else F.col("vec_id")
    return e.select(name.cast("string").alias(key), F.lit(spatial.EQUAL_AREA).alias("srid"), F.array(ring).cast(spatial.RINGS).alias("rings"))


_RECTS = "r AS (SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE, 4) AS y FROM embeddings)"


@query(f"WITH {_RECTS} SELECT vec_id::VARCHAR AS field_id, round(0.05 * 0.04, 6) AS area, round(x + 0.025, 5) AS cx, round(y + 0.02, 5) AS cy, round(x, 5) AS xmin, round(y, 5) AS ymin, round(x + 0.05, 5) AS xmax, round(y + 0.04, 5) AS ymax, true AS simple FROM r")
def geo2_geo3_measures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.with_measures(rectangles(spark, d, "field_id"), simple=True).drop("srid", "rings"), 5).withColumn("area", F.round("area", 6))


#: Union of each map unit's rectangles within each field: between neighbouring x, how much of y any of them covers.
_UNIONS = f"""{_RECTS}, q AS (SELECT a.vec_id AS i, b.vec_id // 50 AS m, greatest(a.x, b.x) AS x0, least(a.x, b.x) + 0.05 AS x1, greatest(a.y, b.y) AS y0, least(a.y, b.y) + 0.04 AS y1 FROM r a JOIN r b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND abs(a.x - b.x) < 0.05 AND abs(a.y - b.y) < 0.04),
cuts AS (SELECT i, m, x, lead(x) OVER (PARTITION BY i, m ORDER BY x) AS nx FROM (SELECT DISTINCT i, m, unnest([x0, x1]) AS x FROM q)),
spans AS (SELECT q.i, q.m, c.x, c.nx, y0, y1, max(y1) OVER (PARTITION BY q.i, q.m, c.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM cuts c JOIN q ON q.i = c.i AND q.m = c.m AND q.x0 <= c.x AND q.x1 >= c.nx WHERE c.nx IS NOT NULL),
u AS (SELECT i, m, sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(seen, y0)))) AS o FROM spans GROUP BY 1, 2)"""


@query(f"WITH {_UNIONS} SELECT i::VARCHAR AS field_id, m::VARCHAR AS mukey, round(o, 8) AS overlap_area_m2, round(0.05 * 0.04, 8) AS field_area_m2, round(o / (0.05 * 0.04), 6) AS field_fraction FROM u WHERE o > 1e-10")
def geo6_join8_overlap(spark: SparkSession, d: str) -> DataFrame:
    out = overlay.field_soil_overlap(rectangles(spark, d, "field_id", 0), rectangles(spark, d, "mukey", 1)).where("overlap_area_m2 > 1e-10")
    return out.withColumns({c: E.round_half_up(F.col(c), k) for c, k in (("overlap_area_m2", 8), ("field_area_m2", 8), ("field_fraction", 6))})


@query(f"""WITH {_RECTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r),
g AS (SELECT vec_id, least(greatest(trunc((y1 - y) / ((y1 - y0) / 2)), 0), 1)::INT AS grid_row, least(greatest(trunc((x - x0) / ((x1 - x0) / 2)), 0), 1)::INT AS grid_col, x, y, x0, x1, y0, y1 FROM r, b)
SELECT vec_id, grid_row, grid_col, 'F-' || lpad((grid_row * 2 + grid_col + 1)::VARCHAR, 2, '0') AS field_id FROM g
QUALIFY row_number() OVER (PARTITION BY grid_row, grid_col ORDER BY pow(x - (x0 + (grid_col + 0.5) * ((x1 - x0) / 2)), 2) + pow(y - (y1 - (grid_row + 0.5) * ((y1 - y0) / 2)), 2), vec_id::VARCHAR) = 1""")
def geo9_top2_grid_selection(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("cx"), F.round(F.col("embedding")[1].cast("double"), 4).alias("cy"))
    box = points.agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy")).first()
    return spatial.select_on_grid(points, tuple(box), 2, "vec_id", "F-").select("vec_id", "grid_row", "grid_col", "field_id")


@query(f"WITH {_RECTS} SELECT round(min(x), 5) AS xmin, round(min(y), 5) AS ymin, round(max(x) + 0.05, 5) AS xmax, round(max(y) + 0.04, 5) AS ymax FROM r")
def set3_total_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.total_bounds(spatial.with_measures(rectangles(spark, d, "mukey"))), 5)


@query(f"""WITH {_RECTS} SELECT vec_id, greatest(0, floor((0.5 - (y + 0.04)) / 0.1))::BIGINT AS row_from, least(8, ceil((0.5 - y) / 0.1))::BIGINT AS row_to, greatest(0, floor((x + 0.5) / 0.1))::BIGINT AS col_from, least(8, ceil((x + 0.05 + 0.5) / 0.1))::BIGINT AS col_to,
 floor((0.5 - (y + 0.04)) / 0.1) >= 0 AND floor((x + 0.5) / 0.1) >= 0 AND ceil((0.5 - y) / 0.1) <= 8 AND ceil((x + 0.05 + 0.5) / 0.1) <= 8 AS covered FROM r""")
def zon10_pixel_window(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.round(F.col("embedding")[0].cast("double"), 4), F.round(F.col("embedding")[1].cast("double"), 4)
    window = E.pixel_window(x, y, x + 0.05, y + 0.04, F.lit(-0.5), F.lit(0.5), F.lit(0.1), F.lit(8), F.lit(8))
    return table(spark, d, "embeddings").select("vec_id", *[v.alias(k) if k == "covered" else v.cast("long").alias(k) for k, v in window.items()])


# --- expressions and gates


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dayofyear(make_date(2000, month(l_shipdate), day(l_shipdate)))::INT AS day_of_year, greatest(0, least(5.0 * l_linenumber + l_quantity, 30) - greatest(5.0 * l_linenumber, 0)) AS thickness,
 round((1 + l_discount) * l_quantity * (l_tax * 50) / 1.724, 6) AS carbon, CASE WHEN l_tax * 12 < 0.3 THEN 'alert' WHEN l_tax * 12 <= 0.6 THEN 'watch' ELSE 'developed' END AS band, round(l_extendedprice / 10000, 8) AS ha, l_shipmode_date AS date, l_returnflag || ' — ' || l_linestatus AS label
FROM (SELECT *, split_part(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S'), 'T', 1) AS l_shipmode_date FROM lineitem)""")
def exp2_exp8_scalars(spark: SparkSession, d: str) -> DataFrame:
    top = 5.0 * F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.leap_day_of_year(F.col("l_shipdate")).alias("day_of_year"), E.overlap_length(top, top + F.col("l_quantity")).alias("thickness"),
        F.round(E.carbon_stock(F.col("l_tax") * 50, 1 + F.col("l_discount"), F.col("l_quantity")), 6).alias("carbon"), E.ndvi_band(F.col("l_tax") * 12).alias("band"), F.round(E.hectares(F.col("l_extendedprice")), 8).alias("ha"),
        E.date_of_stamp(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date"), E.soil_label(F.col("l_returnflag"), F.col("l_linestatus")).alias("label"),
    )


@query("SELECT count(*) FILTER (l_quantity IS NOT NULL AND l_quantity <> 50) AS with_data, count(*) FILTER (l_linenumber BETWEEN 4 AND 7) AS clear FROM lineitem")
def flt3_flt4_masks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_if(E.has_data(F.col("l_quantity"), F.lit(50.0))).alias("with_data"), F.count_if(E.clear_class(F.col("l_linenumber"))).alias("clear"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(p_brand, '^\\D*(\\d+)', 1)::BIGINT, p_brand, p_partkey)::INT AS place FROM part")
def srt2_numeric_order(spark: SparkSession, d: str) -> DataFrame:
    return places.global_places(table(spark, d, "part"), [*E.numeric_order(F.col("p_brand")), F.col("p_partkey").asc()]).select("p_partkey", "place")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def chk1_chk10_gated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders behind every gate: columns, unique and equal keys, references, ranges, finite numbers and numeric text,
    periods, sums. ``chk2_chk10_findings`` has what they refuse."""
    orders, customers, nations, regions = (table(spark, d, n) for n in ("orders", "customer", "nation", "region"))
    checks.require_columns(orders, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"], "orders")
    rules = {"prices must be non-negative": F.col("o_totalprice") >= 0} | checks.finite_rules(["o_totalprice"]) | checks.finite_rules(["o_orderkey"], integral=True)
    checks.require_all(orders.withColumnRenamed("o_custkey", "c_custkey"), "orders", rules, ["o_orderkey", "c_custkey"], parent=customers, key="c_custkey")
    checks.require_same_keys(regions.select(F.col("r_regionkey").alias("k")), nations.select(F.col("n_regionkey").alias("k")), "k", "regions")
    checks.require_period(regions, "r_regionkey", "0", "4", 5, "regions")
    checks.require_sums(nations.withColumn("share", F.lit(1 / 25)), "n_regionkey", "share", 1.0, "nations")
    named = checks.to_keys(checks.to_numbers(orders.withColumn("o_totalprice", text("o_totalprice")), ["o_totalprice"], "orders"), ["o_orderstatus"], "orders")
    checks.require_text(named, ["o_orderstatus"], "orders")
    rows = named.join(customers.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE o_totalprice::VARCHAR END AS price, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE o_orderstatus END AS word,
 CASE WHEN o_orderstatus = 'F' THEN 'inf'::DOUBLE ELSE o_totalprice END AS amount FROM orders),
days AS (SELECT o_orderstatus, count(*) AS n, min(o_orderdate::DATE)::VARCHAR AS lo, max(o_orderdate::DATE)::VARCHAR AS hi FROM orders GROUP BY 1)
SELECT 'price above 300000' AS rule, o_orderkey::VARCHAR AS key FROM o WHERE o_totalprice > 300000
UNION ALL SELECT 'non-finite amount', o_orderkey::VARCHAR FROM o WHERE isinf(amount)
UNION ALL SELECT 'non-integral o_totalprice', o_orderkey::VARCHAR FROM o WHERE o_totalprice <> floor(o_totalprice)
UNION ALL SELECT 'invalid numeric price', o_orderkey::VARCHAR FROM o WHERE price = 'n/a'
UNION ALL SELECT 'empty status', o_orderkey::VARCHAR FROM o WHERE trim(status) = ''
UNION ALL SELECT 'empty word', o_orderkey::VARCHAR FROM o WHERE word = 'nan'
UNION ALL SELECT 'duplicate o_custkey/o_orderpriority', o_custkey || '/' || o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1
UNION ALL SELECT 'missing k', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'unknown k', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'sum of l_quantity exceeds 150', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150
UNION ALL SELECT 'row count', o_orderstatus FROM days WHERE n <> 1
UNION ALL SELECT 'first day', o_orderstatus FROM days WHERE lo <> (SELECT min(o_orderdate::DATE)::VARCHAR FROM orders)
UNION ALL SELECT 'last day', o_orderstatus FROM days WHERE hi <> '2001-01-01'""")
def chk2_chk10_findings(spark: SparkSession, d: str) -> DataFrame:
    """What each gate refuses, over orders and lines with odd values put in by status and priority."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    o = orders.select(
        "*", F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(text("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderstatus") == "P", "nan").otherwise(F.col("o_orderstatus")).alias("word"), F.when(F.col("o_orderstatus") == "F", float("inf")).otherwise(F.col("o_totalprice")).alias("amount"),
    )
    whole = {"non-integral o_totalprice": checks.finite_rules(["o_totalprice"], integral=True)["non-integral o_totalprice"]}
    rules = {"price above 300000": F.col("o_totalprice") <= 300000} | checks.finite_rules(["amount"]) | whole | checks.number_rules(["price"]) | checks.key_rules(["status"]) | checks.text_rules(["word"])
    return (
        checks.rule_findings(o, "o_orderkey", rules)
        .unionByName(checks.duplicate_findings(orders, ["o_custkey", "o_orderpriority"]))
        .unionByName(checks.key_findings(orders.select(F.col("o_orderkey").alias("k")), lines.select(F.col("l_orderkey").alias("k")), "k"))
        .unionByName(checks.sum_findings(lines, "l_orderkey", "l_quantity", 150))
        .unionByName(checks.period_findings(orders.withColumn("day", F.to_date("o_orderdate")), "day", ["o_orderstatus"], str(orders.agg(F.to_date(F.min("o_orderdate"))).first()[0]), "2001-01-01", 1))
    )


# --- scans

TOKEN_RULE = {"cred-token": r'token = "[0-9a-f]{40}"', "cred-password": r"password=[0-9a-f]{8,}", "cred-key-id": r"AKIA[0-9A-Z]{16}"}
_SECRETS = "CASE lang WHEN 'de' THEN ' ghp_' || md5(text) WHEN 'fr' THEN ' github_pat_' || md5(text) WHEN 'es' THEN ' GOCSPX-' || md5(text) || ' refresh_token: ' || md5(text) ELSE CASE WHEN n_chars > 2000 THEN ' \"client_secret\": \"' || md5(text) || '\"' ELSE ' client_secret = short' END END"
_RULES = scan.CREDENTIALS | TOKEN_RULE


def secrets(spark: SparkSession, d: str) -> DataFrame:
    """Documents with made-up secrets of a shape by language behind the text."""
    digest, said = F.md5("text"), F.col("lang")
    tail = F.when(said == "de", F.concat(F.lit(" ghp_"), digest)).when(said == "fr", F.concat(F.lit(" github_pat_"), digest)).when(said == "es", F.concat(F.lit(" GOCSPX-"), digest, F.lit(" refresh_token: "), digest))
    tail = tail.otherwise(F.when(F.col("n_chars") > 2000, F.concat(F.lit(' "client_secret": "'), digest, F.lit('"'))).otherwise(F.lit(" client_secret = short")))
    return table(spark, d, "documents").withColumn("body", F.concat("text", tail))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"WITH s AS (SELECT doc_id, text || {_SECRETS} AS body FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM s WHERE regexp_matches(body, '{_quoted(p)}')" for n, p in _RULES.items()))
def scn1_credentials(spark: SparkSession, d: str) -> DataFrame:
    return scan.credential_findings(secrets(spark, d), "doc_id", "body", _RULES)


_LISTING = "l AS (SELECT source || '/' || CASE WHEN n_chars < 300 THEN '.ENV' WHEN n_chars < 600 THEN 'my-Classroom-' || doc_id WHEN n_chars < 1200 THEN 'oauth/token_' || doc_id ELSE 'd' || doc_id || CASE WHEN lang = 'en' THEN '.Zip' ELSE '.zip.txt' END END AS path, octet_length(encode(text)) AS length, text || " + _SECRETS + " AS body FROM documents)"


@query(f"WITH {_LISTING}, p AS (SELECT path, unnest(string_split(lower(path), '/')) AS c FROM l) SELECT path, rule, count(*) AS n FROM (" + " UNION ALL ".join(
    [f"SELECT path, '{n}' AS rule FROM p WHERE contains(c, '{m}')" for m, n in scan.NAME_RULES.items()] + ["SELECT path, 'name-zip' FROM p WHERE ends_with(c, '.zip')", "SELECT path, 'size' FROM l WHERE length > 4000"]
    + [f"SELECT path, '{n}' FROM l WHERE length <= 4000 AND regexp_matches(body, '{_quoted(p)}')" for n, p in scan.CREDENTIALS.items()]
) + ") GROUP BY ALL")
def scn1_scn3_file_rules(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files with odd names: name rules, sizes, and the content rules of files that are not too large."""
    n, key = F.col("n_chars"), text("doc_id")
    name = F.when(n < 300, ".ENV").when(n < 600, F.concat(F.lit("my-Classroom-"), key)).when(n < 1200, F.concat(F.lit("oauth/token_"), key)).otherwise(F.concat(F.lit("d"), key, F.when(F.col("lang") == "en", ".Zip").otherwise(".zip.txt")))
    files = secrets(spark, d).select(F.concat("source", F.lit("/"), name).alias("path"), F.octet_length("text").cast("long").alias("length"), "body")
    found = scan.name_findings(files).unionByName(scan.size_findings(files, 4000).select("path", F.lit("size").alias("rule"))).unionByName(scan.content_findings(files, "body", 4000))
    return found.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, 'path-home' AS rule FROM pages WHERE regexp_matches('see ' || replace(url, '://', ':/home/'), '/(?:home|Users)/[^\\s]+') AND NOT starts_with(url, 'https://m.')")
def scn2_home_paths(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("body", F.concat(F.lit("see "), F.replace("url", F.lit("://"), F.lit(":/home/"))))
    return scan.home_path_findings(pages, "page_id", "body", "url", ["https://m."])


@query("""SELECT url AS path, 'name-token' AS rule, count(*) AS n FROM (SELECT url, unnest(string_split(lower(url), '/')) AS p FROM pages) WHERE contains(p, 'token') GROUP BY ALL
UNION ALL SELECT url, 'size', count(*) FROM pages WHERE octet_length(encode(html)) > 8000 GROUP BY ALL""")
def scn3_names_and_sizes(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"))
    names = scan.name_findings(listing, {"token": "name-token"})
    return names.select("path", "rule").unionByName(scan.size_findings(listing, 8000).select("path", F.lit("size").alias("rule"))).groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS value FROM pages), l AS (SELECT page_id, value, split_part(split_part(value, '?', 1), '#', 1) AS target FROM a WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#') AND NOT regexp_matches(trim(value), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)'))
SELECT page_id, target, count(*) AS n FROM l WHERE target NOT IN (SELECT '/' || text FROM (SELECT DISTINCT split_part(text, ' ', 1) AS text FROM documents)) GROUP BY ALL""")
def scn4_unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("value"))
    known = table(spark, d, "documents").select(F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("path"))
    return scan.unresolved(anchors, known).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS v FROM pages),
k AS (SELECT page_id, 'image' AS kind, v AS value FROM a UNION ALL SELECT page_id, 'stylesheet', v || '.css?v=1' FROM a UNION ALL SELECT page_id, 'script', v || '.js#x' FROM a UNION ALL SELECT page_id, 'json', v || '.json' FROM a
 UNION ALL SELECT page_id, 'dashboard', 'dash.json' FROM pages WHERE html LIKE '<!DOCTYPE html><html %'),
l AS (SELECT page_id, kind, split_part(split_part(value, '?', 1), '#', 1) AS target FROM k WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#') AND NOT regexp_matches(trim(value), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)'))
SELECT page_id, kind, target, count(*) AS n FROM l WHERE target NOT IN (SELECT DISTINCT '/' || split_part(text, ' ', 1) FROM documents WHERE text IS NOT NULL) GROUP BY ALL""")
def scn4_html_references(spark: SparkSession, d: str) -> DataFrame:
    """Each list link of a page made an image, a style sheet, a script and a JSON link, and a data attribute put in; the
    references of these tags that no document's first word names."""
    tags = '<li><img alt="x > y" SRC="$1"/><link rel="preload Stylesheet" href=\'$1.css?v=1\'><script async src=$1.js#x></script><a class="c" href="$1.json">'
    html = F.regexp_replace(F.regexp_replace("html", '<li><a href="([^"]*)">', tags), "^<!DOCTYPE html><html ", '<!DOCTYPE html><html data-dashboard="dash.json" ')
    pages = table(spark, d, "pages").select("page_id", html.alias("html"))
    known = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("path"))
    return scan.unresolved(scan.html_references(pages, "page_id", "html"), known).groupBy("page_id", "kind", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS expected, CASE WHEN doc_id % 7 = 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'missing' END AS status FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def scn5_digest_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    odd, gone = F.col("doc_id") % 7 == 0, (F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 7 != 0)
    expected = docs.select(text("doc_id").alias("path"), F.sha2(F.when(odd, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    files = docs.where(~gone).select(text("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return scan.digest_findings(files, expected).select("path", "expected", "sha256", "status")


@query("SELECT p_partkey::INT AS code, p_name || ' & co' AS name FROM part")
def src5_parse_labels(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "part").select(F.concat(F.lit('<p>x</p><pre>\n &quot;'), text("p_partkey"), F.lit('&quot;   '), "p_name", F.lit(" &amp; co \n</pre>")).alias("html"))
    return readers.parse_labels(pages, "html")


# --- more space: projection, eligibility, clipping, tiles


_LONLAT = "g AS (SELECT vec_id, -96 + 20 * embedding[1]::DOUBLE AS lon, 38 + 10 * embedding[2]::DOUBLE AS lat FROM embeddings)"
_E2 = "0.0066943800229034"
_SINES = f"s AS (SELECT vec_id, lon, sin(radians(lat)) AS s, sqrt({_E2}) AS e FROM g), q AS (SELECT vec_id, lon, (1 - e * e) * (s / (1 - e * e * s * s) + atanh(e * s) / e) AS q FROM s)"
_CONSTANTS = """k0 AS (SELECT sqrt(0.0066943800229034) AS e, sin(radians(29.5)) AS s1, sin(radians(45.5)) AS s2, sin(radians(23)) AS s0),
k1 AS (SELECT e, pow(cos(asin(s1)), 2) / (1 - e * e * s1 * s1) AS m1, pow(cos(asin(s2)), 2) / (1 - e * e * s2 * s2) AS m2, (1 - e * e) * (s1 / (1 - e * e * s1 * s1) + atanh(e * s1) / e) AS q1,
 (1 - e * e) * (s2 / (1 - e * e * s2 * s2) + atanh(e * s2) / e) AS q2, (1 - e * e) * (s0 / (1 - e * e * s0 * s0) + atanh(e * s0) / e) AS q0 FROM k0),
k AS (SELECT (m1 - m2) / (q2 - q1) AS n, m1 + (m1 - m2) / (q2 - q1) * q1 AS c, q0 FROM k1)"""


@query(f"""WITH {_LONLAT}, {_SINES}, {_CONSTANTS} SELECT vec_id, round(6378137 * sqrt(c - n * q) / n * sin(n * radians(lon + 96)), 3) AS x, round(6378137 / n * (sqrt(c - n * q0) - sqrt(c - n * q) * cos(n * radians(lon + 96))), 3) AS y FROM q, k""")
def geo1_reproject(spark: SparkSession, d: str) -> DataFrame:
    return first_corner(spatial.reproject(lonlat_points(spark, d), spatial.EQUAL_AREA), 3)


def _utm_sql() -> str:
    """Kruger's series of zone 15, terms to the fourth order."""
    n = spatial.geometry.FLATTENING / (2 - spatial.geometry.FLATTENING)
    radius = spatial.geometry.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    east = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(alpha, 1))])
    return f"""t AS (SELECT vec_id, radians(lon + 93) AS d, sin(radians(lat)) AS s, sqrt({_E2}) AS e FROM g), h AS (SELECT vec_id, d, atanh(s) - e * atanh(e * s) AS w FROM t), i AS (SELECT vec_id, d, (exp(w) - exp(-w)) / 2 AS t FROM h),
 j AS (SELECT vec_id, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM i) SELECT vec_id, round(500000 + 0.9996 * {radius!r}::DOUBLE * ({east}), 3) AS x, round(0.9996 * {radius!r}::DOUBLE * ({north}), 3) AS y FROM j"""


def lonlat_points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    x, y = -96 + 20 * e[0].cast("double"), 38 + 10 * e[1].cast("double")
    point = F.array(F.struct(F.lit(1).alias("sign"), F.array(x).alias("xs"), F.array(y).alias("ys"))).cast(spatial.RINGS)
    return table(spark, d, "embeddings").select("vec_id", F.lit(spatial.LONLAT).alias("srid"), point.alias("rings"))


def first_corner(df: DataFrame, places: int) -> DataFrame:
    return rounded(df.select("vec_id", F.col("rings")[0]["xs"][0].alias("x"), F.col("rings")[0]["ys"][0].alias("y")), places)


@query(f"WITH {_LONLAT}, {_utm_sql()}")
def geo1_grid_zone(spark: SparkSession, d: str) -> DataFrame:
    return first_corner(spatial.reproject(lonlat_points(spark, d), 32615), 3)


def _utm_inverse_sql() -> str:
    """Krueger's inverse series of zone 15, and the series from the conformal to the geodetic latitude."""
    n = spatial.geometry.FLATTENING / (2 - spatial.geometry.FLATTENING)
    radius = 0.9996 * spatial.geometry.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = " - ".join(["a", *(f"{b!r}::DOUBLE * sin({2 * j} * a) * (exp({2 * j} * b) + exp(-{2 * j} * b)) / 2" for j, b in enumerate(beta, 1))])
    eta = " - ".join(["b", *(f"{b!r}::DOUBLE * cos({2 * j} * a) * (exp({2 * j} * b) - exp(-{2 * j} * b)) / 2" for j, b in enumerate(beta, 1))])
    lat = " + ".join(["c", *(f"{d!r}::DOUBLE * sin({2 * j} * c)" for j, d in enumerate(delta, 1))])
    return f"""z AS (SELECT vec_id, (4600000 + 100000 * round(embedding[2]::DOUBLE, 4)) / {radius!r}::DOUBLE AS a, 200000 * round(embedding[1]::DOUBLE, 4) / {radius!r}::DOUBLE AS b FROM embeddings),
 w AS (SELECT vec_id, {xi} AS xi, {eta} AS eta FROM z), c AS (SELECT vec_id, xi, eta, asin(sin(xi) * 2 / (exp(eta) + exp(-eta))) AS c FROM w)
 SELECT vec_id, round(-93 + degrees(atan2((exp(eta) - exp(-eta)) / 2, cos(xi))), 7) AS x, round(degrees({lat}), 7) AS y FROM c"""


@query(f"WITH {_utm_inverse_sql()}")
def geo1_from_grid_zone(spark: SparkSession, d: str) -> DataFrame:
    """Points of a transverse Mercator zone, from two components of vectors, as longitude and latitude."""
    x, y = F.round(F.col("embedding")[0].cast("double"), 4) * 200_000 + 500_000, F.round(F.col("embedding")[1].cast("double"), 4) * 100_000 + 4_600_000
    point = F.array(F.struct(F.lit(1).alias("sign"), F.array(x).alias("xs"), F.array(y).alias("ys"))).cast(spatial.RINGS)
    points = table(spark, d, "embeddings").select("vec_id", F.lit(spatial.UTM_NORTH + 15).alias("srid"), point.alias("rings"))
    return first_corner(spatial.reproject(points, spatial.LONLAT), 7)


@query(f"WITH {_LONLAT} SELECT vec_id, round(lon, 7) AS x, round(lat, 7) AS y FROM g")
def geo1_there_and_back(spark: SparkSession, d: str) -> DataFrame:
    there = spatial.reproject(lonlat_points(spark, d), spatial.EQUAL_AREA)
    return first_corner(spatial.reproject(there, spatial.LONLAT), 7)


@query(f"""WITH {_RECTS}, f AS (SELECT vec_id, x, y, greatest(0, least(x + 0.05, 0.1) - greatest(x, -0.2)) * greatest(0, least(y + 0.04, 0.2) - greatest(y, -0.2)) / (0.05 * 0.04) AS f FROM r WHERE x <= y)
SELECT vec_id::VARCHAR AS field_id, round(f, 6) AS inside_fraction FROM f WHERE x + 0.025 > -0.2 AND x + 0.025 < 0.1 AND y + 0.02 > -0.2 AND y + 0.02 < 0.2 AND f >= 0.95 + 1e-7""")
def flt1_flt2_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Flagged rectangles, the first row of each id, within a region."""
    rects = rectangles(spark, d, "field_id").withColumn("isAG", (F.col("rings")[0]["xs"][0] <= F.col("rings")[0]["ys"][0]).cast("int"))
    twice = rects.withColumn("src", F.lit(0)).unionByName(rects.withColumn("src", F.lit(1)))
    ring = F.array(F.struct(F.lit(1).alias("sign"), F.array(*map(F.lit, (-0.2, 0.1, 0.1, -0.2))).alias("xs"), F.array(*map(F.lit, (-0.2, -0.2, 0.2, 0.2))).alias("ys"))).cast(spatial.RINGS)
    region = spark.range(1).select(ring.alias("rings"))
    return rounded(spatial.within_region(spatial.eligible(twice, "isAG", "field_id", "src"), region, 0.95 + 1e-7).select("field_id", "inside_fraction"))


_SHAPES = ("none", "edges cross", "ring in the wrong place", "ring in the wrong place", "edges cross", "inside in several parts", "none", "ring touches itself")


@query(f"SELECT list_extract({list(_SHAPES)!r}, (vec_id % 8 + 1)::INT) AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE vec_id % 8 NOT IN (0, 6)")
def flt1_validity_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles from two components of vectors, made into eight shapes: whole, bent over itself, with a hole outside, in
    another shell, with a hole across its border, parted by a hole, with a hole at a corner, touching itself."""
    x, y = F.round(F.col("embedding")[0].cast("double"), 4), F.round(F.col("embedding")[1].cast("double"), 4)

    def ring(sign: int, *points: tuple[float, float]) -> Column:
        return F.struct(F.lit(sign).alias("sign"), F.array(*[x + a for a, _ in points]).alias("xs"), F.array(*[y + b for _, b in points]).alias("ys"))

    def box(sign: int, a: float, b: float, w: float, h: float) -> Column:
        return ring(sign, (a, b), (a + w, b), (a + w, b + h), (a, b + h))

    shell = box(1, 0, 0, 8, 8)
    shapes = [
        F.array(shell), F.array(ring(1, (0, 0), (8, 8), (8, 0), (0, 9))), F.array(shell, box(-1, 9, 9, 1, 1)), F.array(shell, box(1, 2, 2, 3, 3)),
        F.array(shell, box(-1, 6, 6, 4, 1)), F.array(shell, ring(-1, (0, 0), (5, 4), (8, 8), (4, 5))), F.array(shell, ring(-1, (0, 0), (5, 4), (4, 5))), F.array(ring(1, (0, 0), (8, 0), (4, 4), (8, 8), (0, 8), (4, 4))),
    ]
    chosen = shapes[0]
    for k, shape in enumerate(shapes[1:], 1):
        chosen = F.when(F.col("vec_id") % 8 == k, shape).otherwise(chosen)
    return spatial.validity_findings(table(spark, d, "embeddings").select("vec_id", chosen.cast(spatial.RINGS).alias("rings")), "vec_id")


@query(f"WITH {_UNIONS} SELECT i::VARCHAR AS field_id, m::VARCHAR AS mukey, round(o, 8) AS area FROM u WHERE o > 1e-10")
def geo8_clipped_soils(spark: SparkSession, d: str) -> DataFrame:
    """Map units within fields, dissolved; of the outlines the areas are kept."""
    fields, soils = rectangles(spark, d, "field_id", 0), rectangles(spark, d, "mukey", 1)
    return overlay.clipped_soils(fields, soils).select("field_id", "mukey", "area").where("area > 1e-10").withColumn("area", E.round_half_up(F.col("area"), 8))


#: Union over all fields of each map unit's rectangles within them: between neighbouring x, how much of y any covers.
_DISSOLVED = f"""{_RECTS}, q AS (SELECT DISTINCT b.vec_id // 50 AS m, greatest(a.x, b.x) AS x0, least(a.x, b.x) + 0.05 AS x1, greatest(a.y, b.y) AS y0, least(a.y, b.y) + 0.04 AS y1 FROM r a JOIN r b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND abs(a.x - b.x) < 0.05 AND abs(a.y - b.y) < 0.04),
cuts AS (SELECT m, x, lead(x) OVER (PARTITION BY m ORDER BY x) AS nx FROM (SELECT DISTINCT m, unnest([x0, x1]) AS x FROM q)),
spans AS (SELECT q.m, c.x, c.nx, y0, y1, max(y1) OVER (PARTITION BY q.m, c.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM cuts c JOIN q ON q.m = c.m AND q.x0 <= c.x AND q.x1 >= c.nx WHERE c.nx IS NOT NULL)"""


@query(f"WITH {_DISSOLVED} SELECT m::VARCHAR AS mukey, round(sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(seen, y0)))), 7) AS area, true AS closed FROM spans GROUP BY 1")
def geo8_dissolved_soils(spark: SparkSession, d: str) -> DataFrame:
    """One outline a map unit over all fields together, after the gate that each that overlaps is left."""
    units = overlay.dissolved(rectangles(spark, d, "field_id", 0), rectangles(spark, d, "mukey", 1))
    closed = F.forall("rings", lambda r: (F.size(r["xs"]) >= 3) & (F.size(r["xs"]) == F.size(r["ys"])))
    return spatial.with_measures(units).select("mukey", F.round("area", 7).alias("area"), closed.alias("closed"))


@query("""WITH h AS (SELECT (10 * ceil((max((p_partkey - 1) // 50) + 1) / 10))::BIGINT AS h FROM part), g AS (SELECT r.r, c.c, h FROM h, range((SELECT h FROM h)) r(r), range(50) c(c)),
px AS (SELECT g.*, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size % 10 END AS code FROM g LEFT JOIN part ON p_partkey = r * 50 + c + 1),
b AS (SELECT s_suppkey::VARCHAR AS field_id, s_suppkey % 40 + 0.2 AS x, s_suppkey % 30 + 0.3 AS y FROM supplier)
SELECT 'r' AS raster_id, 2023::INT AS year, field_id, code::INT AS code, count(*) AS n FROM px JOIN b ON c + 0.5 >= x AND c + 0.5 < x + 5 AND h - r - 0.5 >= y AND h - r - 0.5 < y + 4 GROUP BY ALL""")
def zon3_zonal_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a raster of 50 columns in tiles of 10 by 10, suppliers as boxes of 5 by 4; sizes by tens have no data."""
    part, k = table(spark, d, "part"), F.col("p_partkey") - 1
    height = F.floor((part.agg(F.max("p_partkey")).first()[0] - 1) / F.lit(50)) + 1
    top = F.ceil(height / 10) * 10
    px = part.select((k % 50).cast("int").alias("c"), F.floor(k / 50).cast("int").alias("r"), F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 10).alias("code")).withColumn("tile_x", F.floor(F.col("c") / 10).cast("int")).withColumn("tile_y", F.floor(F.col("r") / 10).cast("int"))
    place = (F.col("r") % 10) * 10 + F.col("c") % 10
    cell = F.map_from_entries(F.collect_list(F.struct(place, F.struct("code"))))
    values = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.col("m")[i]["code"])
    tiles = px.groupBy("tile_x", "tile_y").agg(cell.alias("m")).select(F.lit("r").alias("raster_id"), F.lit(2023).alias("year"), "tile_x", "tile_y", (F.col("tile_x") * 10.0).alias("origin_x"), (top - F.col("tile_y") * 10).cast("double").alias("origin_y"), F.lit(1.0).alias("pixel_size"), F.lit(10).alias("width"), F.lit(10).alias("height"), values.alias("values"))
    grids = spark.range(1).select(F.lit("r").alias("raster_id"), F.lit(spatial.EQUAL_AREA).alias("srid"), F.lit(0.0).alias("x0"), top.cast("double").alias("y0"), F.lit(1.0).alias("pixel_size"), F.lit(10).alias("tile_size"), F.lit(5).alias("tiles_x"), (top / 10).cast("int").alias("tiles_y"))
    x, y = F.col("s_suppkey") % 40 + 0.2, F.col("s_suppkey") % 30 + 0.3
    ring = F.array(F.struct(F.lit(1).alias("sign"), F.array(x, x + 5, x + 5, x).alias("xs"), F.array(y, y, y + 4, y + 4).alias("ys"))).cast(spatial.RINGS)
    fields = table(spark, d, "supplier").select(text("s_suppkey").alias("field_id"), F.lit(spatial.EQUAL_AREA).alias("srid"), ring.alias("rings"))
    counts = zonal.zonal_counts(tiles, spatial.with_measures(fields), grids)
    return counts.groupBy("raster_id", "year", "field_id", "code").agg(F.sum("n").alias("n"))


@query("""SELECT s_suppkey::VARCHAR AS scene_id, CASE WHEN s_acctbal > 8000 THEN 1 ELSE 2 END::BIGINT AS bands, CASE WHEN s_acctbal > 8000 THEN 1 ELSE 2 END::BIGINT AS grids FROM supplier WHERE s_acctbal > 8000 OR s_acctbal < 0 OR s_nationkey % 5 = 0""")
def zon7_grid_findings(spark: SparkSession, d: str) -> DataFrame:
    """Grids of suppliers' bands: the nir grid is shifted where the balance is negative and coarser in nations by fives,
    and missing where the balance is high."""
    s = table(spark, d, "supplier")
    shift, coarse = F.col("s_acctbal") < 0, F.col("s_nationkey") % 5 == 0
    grid = lambda name, x0, size: F.struct(F.lit(name).alias("band"), (F.lit(100) + F.col("s_nationkey")).alias("width"), F.lit(80).alias("height"), F.lit(32615).alias("srid"), x0.alias("x0"), F.lit(0.0).alias("y0"), size.alias("pixel_size"))
    x = F.col("s_suppkey") * 10.0
    bands = s.select(text("s_suppkey").alias("scene_id"), "s_acctbal", F.inline(F.array(grid("red", x, F.lit(10.0)), grid("nir", F.when(shift, x + 5).otherwise(x), F.when(coarse, 20.0).otherwise(10.0)))))
    return imagery.grid_findings(bands.where("band = 'red' or s_acctbal <= 8000"))


@query("SELECT s_suppkey::VARCHAR AS scene_id, 2::BIGINT AS bands, ((100 + s_nationkey) * 80)::BIGINT AS pixels FROM supplier")
def zon7_same_grids(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' red and nir bands behind the gate that both have one grid, and the pixels of that grid."""
    s = table(spark, d, "supplier")
    grid = [F.lit(b).alias("band") for b in ("red", "nir")]
    same = [(100 + F.col("s_nationkey")).alias("width"), F.lit(80).alias("height"), F.lit(32615).alias("srid"), (F.col("s_suppkey") * 10.0).alias("x0"), F.col("s_acctbal").alias("y0"), F.lit(10.0).alias("pixel_size")]
    bands = s.select(text("s_suppkey").alias("scene_id"), F.inline(F.array(*[F.struct(b, *same) for b in grid])))
    return imagery.require_same_grids(bands).groupBy("scene_id").agg(F.count(F.lit(1)).alias("bands"), F.max(F.col("width") * F.col("height")).cast("long").alias("pixels"))


# --- files: written from the tables to the shared folder and read back


@query(f"WITH {_RECTS} SELECT vec_id::VARCHAR AS field_id, round(x, 4) AS area_ha, round(0.05 * 0.04, 6) AS area FROM r")
def src1_snk1_geojson(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "geojson")
    writers.write_feature_collections(rectangles(spark, d, "field_id").withColumn("area_ha", F.col("rings")[0]["xs"][0]), path, "field_id", 100)
    back = readers.read_geojson(spark, path, "field_id string, area_ha double", "field_id", "area_ha", lines=True)
    return spatial.with_measures(back).select("field_id", F.round("area_ha", 4).alias("area_ha"), F.round("area", 6).alias("area"))


@query("SELECT p_partkey::VARCHAR AS mukey, 'a \"b\" | ' || p_name AS muname, nullif(p_size % 3, 0)::VARCHAR AS musym FROM part")
def src2_dictionary_table(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a pipe-delimited table whose columns a dictionary places, with quotes, bars and blanks in the text."""
    path, part = scratch_path(spark, "delimited"), table(spark, d, "part")
    quoted = F.concat(F.lit('"a ""b"" | '), "p_name", F.lit('"'))
    lines = part.select(F.concat_ws("|", F.concat(F.lit(" "), text("p_partkey"), F.lit(" ")), F.lit("x"), quoted, F.when(F.col("p_size") % 3 == 0, "").otherwise(text_of(F.col("p_size") % 3))).alias("value"))
    lines.write.text(path)
    names = ("mukey", "other", "muname", "musym")
    dictionary = spark.range(4).select(F.lit("mapunit").alias("table"), text_of(F.col("id") + 1).alias("ordinal"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") + 1).cast("int")).alias("column"))
    return readers.read_dictionary_table(spark, path, dictionary, "mapunit", ["mukey", "muname", "musym"])


@query(f"WITH {_RECTS} SELECT vec_id::VARCHAR AS field_id, round(x, 4) AS area_ha, round(0.05 * 0.04, 6) AS area FROM r")
def src1_split_collection(spark: SparkSession, d: str) -> DataFrame:
    """Collections of a file each, whose features many tasks find by braces and quotes."""
    path = scratch_path(spark, "collections")
    writers.write_feature_collections(rectangles(spark, d, "field_id").withColumn("area_ha", F.col("rings")[0]["xs"][0]), path, "field_id", 1000, apart=True)
    back = readers.read_geojson(spark, path, "field_id string, area_ha double", "field_id", "area_ha", split=True)
    return spatial.with_measures(back).select("field_id", F.round("area_ha", 4).alias("area_ha"), F.round("area", 6).alias("area"))


@query("SELECT p_partkey::VARCHAR AS mukey, 'a \"b\"' || chr(10) || '| ' || p_name AS muname FROM part")
def src2_split_table(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a pipe-delimited table with line ends, bars and quotes in its values, read by blocks."""
    path, part = scratch_path(spark, "quoted"), table(spark, d, "part")
    part.select(F.concat(text("p_partkey"), F.lit('|"a ""b""\n| '), "p_name", F.lit('"')).alias("value")).write.text(path)
    dictionary = spark.range(2).select(F.lit("mapunit").alias("table"), text_of(F.col("id") + 1).alias("ordinal"), F.element_at(F.array(F.lit("mukey"), F.lit("muname")), (F.col("id") + 1).cast("int")).alias("column"))
    return readers.read_dictionary_table(spark, path, dictionary, "mapunit", ["mukey", "muname"], split=True)


def text_of(c: Column) -> Column:
    return c.cast("string")


@query("SELECT s_suppkey::VARCHAR AS scene_id, s_name AS datetime, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS cloud_cover, 6.0::DOUBLE AS scales, -0.1::DOUBLE AS offsets FROM supplier")
def src4_scene_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a catalogue; the red band has scale 4 and an offset, the others have the defaults."""
    path, s = scratch_path(spark, "catalogue"), table(spark, d, "supplier")
    first = F.array(F.struct(F.lit(4.0).alias("scale"), F.lit(-0.1).alias("offset")))
    bare = F.array(F.struct(F.lit(None).cast("double").alias("scale"), F.lit(None).cast("double").alias("offset")))
    assets = F.create_map(*[x for b, v in (("red", first), ("nir", bare), ("scl", bare)) for x in (F.lit(b), F.struct(F.lit("h").alias("href"), v.alias("raster:bands")))])
    one = F.struct(text("s_suppkey").alias("id"), F.struct(F.col("s_name").alias("datetime"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("eo:cloud_cover")).alias("properties"), assets.alias("assets"))
    page = F.to_json(F.struct(F.struct(F.count(F.lit(1)).alias("matched")).alias("context"), F.collect_list(one).alias("features"))).alias("value")
    s.groupBy(F.floor(F.col("s_suppkey") / 1000)).agg(page).select("value").write.text(path)  # pages of a thousand scenes
    scenes, bands = readers.read_scene_catalogue(spark, path, lines=True)
    sums = bands.groupBy("scene_id").agg(F.sum("scale").alias("scales"), F.sum("offset").alias("offsets"))
    return scenes.join(sums, "scene_id")


@query(f"WITH {HISTORY} SELECT * FROM history")
def src6_snk2_products(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "product")
    writers.write_product(class_history(spark, d), path, ["field_id", "year"])
    return rounded(readers.read_product(spark, path, "crop_history"))


@query(f"""WITH {HISTORY}, totals AS (SELECT count(*) AS rows, count(DISTINCT (field_id, year)) AS distinct_keys, count(*) FILTER (cdl_code IS NULL) AS missing FROM history)
SELECT '{{"distinct_keys":' || distinct_keys || ',"missing":' || missing || ',"nothing":null,"product":"crop_history","rows":' || rows || '}}' AS summary, rows, 0::BIGINT AS out_of_order FROM totals""")
def snk2_srt1_summary_and_order(spark: SparkSession, d: str) -> DataFrame:
    """The summary's text as written, and the rows of the product, in files' order, that come before their predecessor."""
    path = scratch_path(spark, "product")
    rows = class_history(spark, d)
    writers.write_product(rows, path, ["field_id", "year"])
    writers.write_summary(crops.product_counts({"crop_history": (rows, ["field_id", "year"], ["cdl_code"])}).withColumn("nothing", F.lit(None).cast("string")), f"{path}-summary")
    return spark.read.text(f"{path}-summary").select(F.col("value").alias("summary")).crossJoin(readers.order_of_files(spark, path, ["field_id", "year"], "field_id string, year int"))
