"""Readers of the landed files. NaN and fill values become null here, so that no operator meets them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators import checks
from fieldspark.operators.spatial import RINGS
from fieldspark.operators.weather import require_continuous
from fieldspark.sources import records
from fieldspark.sources.scratch import landed

#: Fixed values of the daily weather source: parameter names and fill value.
TEMPERATURE, PRECIPITATION, FILL = "T2M", "PRECTOTCORR", -999.0
#: Typed columns of the CSV products; keys are text even where they look like numbers.
PRODUCTS = {
    "crop_history": "field_id string, year int, cdl_code int, cdl_name string, majority_fraction double, coverage_fraction double, valid_pixels long, total_pixels long",
    "overlaps": "field_id string, mukey string, musym string, muname string, overlap_area_m2 double, field_area_m2 double, field_fraction double",
    "field_ndvi": "field_id string, mean_ndvi double, median_ndvi double, valid_pixel_count long, total_pixel_count long, coverage_fraction double",
}
#: A line of a label page.
_LABEL = re.compile(r'\s*"(\d{1,9})"\s+(\S(?:.*\S)?)\s*$')


def without_nan(df: DataFrame) -> DataFrame:
    """All double and float columns with NaN as null."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def _rings(geometry: Column) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon whose coordinates are kept as text; null for others."""
    point = "array<array<array<double>>>"
    parts = F.when(geometry["type"] == "Polygon", F.array(F.from_json(geometry["coordinates"], point))).when(geometry["type"] == "MultiPolygon", F.from_json(geometry["coordinates"], f"array<{point}>"))
    one = lambda poly: F.transform(poly, lambda ring, i: F.struct(F.when(i == 0, 1).otherwise(-1).alias("sign"), F.transform(ring, lambda p: p[0]).alias("xs"), F.transform(ring, lambda p: p[1]).alias("ys")))
    return F.flatten(F.transform(parts, one)).cast(RINGS)


def read_geojson(spark: SparkSession, path: str, properties: str, key: str | None = None, area: str | None = None, srid: int = 4326, lines: bool = False, split: bool = False) -> DataFrame:
    """One row for each feature of FeatureCollections: its properties (a DDL string), srid and rings. Each file is one, or
    with ``lines`` each line is, so that large inputs are read in parallel. With ``split`` one large file is, too: its
    features are found by braces and quotes, whatever its lines.

    Refused: other JSON, no features, a missing or repeated ``key``, an ``area`` that is not finite.
    """
    schema = f"type string, features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    if split:
        named = spark.read.option("lineSep", ",").text(path).where(F.col("value").rlike(r'"type"\s*:\s*"FeatureCollection"'))
        feature = F.from_json("record", f"type string, properties struct<{properties}>, geometry struct<type:string,coordinates:string>")
        found = records.json_members(spark, path).select(feature.alias("f")).where("f.type = 'Feature'")
        found = landed(found, "features")
        good = named.limit(1).count() and found.limit(1).count()
    else:
        doc = spark.read.schema(schema).option("multiLine", not lines).json(path)
        good = doc.where("type = 'FeatureCollection' and size(features) > 0").limit(1).count()
        found = doc.select(F.explode("features").alias("f"))
    if not good:
        raise checks.CheckError(f"{path}: no feature collection with features")
    rows = found.select("f.properties.*", F.lit(srid).alias("srid"), _rings(F.col("f.geometry")).alias("rings"))
    if key:
        checks.require_rules(rows, {f"missing {key}": F.coalesce(F.col(key).cast("string"), F.lit("")) != ""}, path)
        checks.require_unique(rows, [key], path)
    if area:
        checks.require_finite(rows, [area], path)
    return without_nan(rows)


def column_positions(dictionary: DataFrame, table: str, columns: Sequence[str]) -> list[str]:
    """Columns of a table in order, from dictionary rows (table, ordinal, column).

    Ordinals must be whole numbers from 1 without gaps or conflicts, and ``columns`` among them. The dictionary has a
    row for each column of a survey's tables, so it is collected.
    """
    rows = dictionary.where(F.trim("table") == table).select(F.trim("ordinal").alias("o"), F.lower(F.trim("column")).alias("c")).distinct().collect()
    if not rows:
        raise checks.CheckError(f"{table}: not in the dictionary")
    if not all((r.o or "").isdigit() for r in rows):
        raise checks.CheckError(f"{table}: an ordinal is no whole number")
    names = {int(r.o): r.c for r in rows}
    if len(names) != len(rows) or len(set(names.values())) != len(rows):
        raise checks.CheckError(f"{table}: conflicting ordinals")
    if sorted(names) != list(range(1, len(names) + 1)):
        raise checks.CheckError(f"{table}: ordinals are not contiguous from 1")
    if missing := sorted(set(columns) - set(names.values())):
        raise checks.CheckError(f"{table}: dictionary lacks {', '.join(missing)}")
    return [names[k] for k in sorted(names)]


def _delimited(spark: SparkSession, path: str, schema: T.StructType, split: bool = False) -> DataFrame:
    options = {"sep": "|", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    if split:
        lines = records.quoted_lines(spark, path).where(F.trim("record") != "")
        return lines.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {**options, "multiLine": "true"}).alias("r")).select("r.*")
    return spark.read.schema(schema).options(**options, multiLine=True).csv(path)


def read_dictionary(spark: SparkSession, path: str, table: int = 0, ordinal: int = 1, column: int = 2, width: int | None = None) -> DataFrame:
    """Dictionary rows (table, ordinal, column) of a pipe-delimited file, from the given positions."""
    n = (max(table, ordinal, column) + 1) if width is None else width
    rows = _delimited(spark, path, T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(n)]))
    return rows.select(F.col(f"c{table}").alias("table"), F.col(f"c{ordinal}").alias("ordinal"), F.col(f"c{column}").alias("column"))


def read_dictionary_table(spark: SparkSession, path: str, dictionary: DataFrame, table: str, columns: Sequence[str], split: bool = False) -> DataFrame:
    """``columns`` of a pipe-delimited file without header, placed by the dictionary, trimmed, blank as null. With
    ``split`` one large file is read by many tasks, though its quoted values hold line ends.

    Every row must have the full width, and there must be rows; widths are checked over all columns, as a narrow
    projection would hide short rows.
    """
    names = column_positions(dictionary, table, columns)
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_bad", T.StringType())])
    rows = landed(_delimited(spark, path, schema, True), "rows") if split else _delimited(spark, path, schema)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_bad").isNotNull()).alias("bad"), *[F.max(n).alias(f"_{n}") for n in names]).first()  # all columns: else none is parsed
    if not got.n:
        raise checks.CheckError(f"{table}: no rows")
    if got.bad:
        raise checks.CheckError(f"{table}: {got.bad} rows without full width")
    return rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns])


def parse_daily(payloads: DataFrame, site: str = "site_id", body: str = "payload") -> DataFrame:
    """site_id, date, t2m_c, precip_mm from JSON bodies, one for each site.

    Refused: bodies without both parameters as objects or without days, unequal date keys, keys that are no dates,
    values that are not finite numbers (text and booleans too), negative rain, gaps. The fill value is null.
    """
    v = F.try_parse_json(body)
    rows = payloads.select(F.col(site).alias("site_id"), *[F.try_variant_get(v, f"$.properties.parameter.{p}", "map<string,variant>").alias(n) for p, n in ((TEMPERATURE, "t"), (PRECIPITATION, "p"))])
    keys = [F.array_sort(F.map_keys(c)) for c in ("t", "p")]
    checks.require_rules(rows, {
        "payload lacks a parameter": F.col("t").isNotNull() & F.col("p").isNotNull(), "no daily records": F.coalesce(F.size("t") > 0, F.lit(True)), "date keys of the parameters differ": F.coalesce(keys[0] == keys[1], F.lit(True)),
    }, "daily payload")
    days = rows.select("site_id", F.explode("t").alias("k", "t"), "p").withColumn("p", F.col("p")[F.col("k")])
    days = days.withColumn("date", F.when(F.col("k").rlike("^[0-9]{8}$"), F.try_to_date("k", "yyyyMMdd")))

    def number(c: str) -> Column:
        return F.when(F.schema_of_variant(c).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(F.col(c), "$", "double"))

    days = days.withColumns({c: number(c) for c in ("t", "p")})
    good = {c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)) for c in ("t", "p")}
    checks.require_rules(days, {"invalid date key": F.col("date").isNotNull(), "values must be finite numeric": good["t"] & good["p"], "negative precipitation": (F.col("p") >= 0) | (F.col("p") == FILL)}, "daily payload")
    return require_continuous(days.select("site_id", "date", *[F.nullif(c, F.lit(FILL)).alias(n) for c, n in (("t", "t2m_c"), ("p", "precip_mm"))]))


def read_daily_series(spark: SparkSession, path: str) -> DataFrame:
    """``parse_daily`` of whole files, the file's path as site."""
    return parse_daily(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("site_id"), F.col("value").alias("payload")))


def read_scene_catalogue(spark: SparkSession, path: str, assets: Sequence[str] = ("red", "nir", "scl"), lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scenes (scene_id, datetime, cloud_cover) and bands (scene_id, band, href, scale, offset) of search results. Each
    file is one, or with ``lines`` each line is.

    Scale and offset are those of an asset's first band, 1 and 0 where not given. Refused: no scenes, a scene without
    one of ``assets`` or their band list, fewer scenes than matched, or a next page where no count is given.
    """
    band = "array<struct<scale:double,offset:double>>"
    schema = f"context struct<matched:long>, links array<struct<rel:string>>, features array<struct<id:string,properties:struct<datetime:string,`eo:cloud_cover`:double>,assets:map<string,struct<href:string,`raster:bands`:{band}>>>>"
    doc = spark.read.schema(schema).option("multiLine", not lines).json(path)
    cut = F.when(F.col("context.matched").isNotNull(), F.col("context.matched") <= F.size("features")).otherwise(~F.coalesce(F.exists("links", lambda x: x["rel"] == "next"), F.lit(False)))
    checks.require_rules(doc, {"no scenes": F.coalesce(F.size("features") > 0, F.lit(False)), "the result is truncated": cut}, "scene catalogue")
    rows = doc.select(F.inline("features"))
    need = F.lit(True)
    for a in assets:
        need = need & F.coalesce(F.size(F.col("assets")[a]["raster:bands"]) > 0, F.lit(False))
    checks.require_rules(rows, {"a scene lacks assets or their bands": need}, "scene catalogue")
    scenes = rows.select(F.col("id").alias("scene_id"), "properties.datetime", F.col("properties.`eo:cloud_cover`").alias("cloud_cover"))
    bands = rows.select(F.col("id").alias("scene_id"), F.explode("assets").alias("band", "a")).where(F.col("band").isin(*assets))
    first = F.col("a")["raster:bands"][0]
    return scenes, bands.select("scene_id", "band", "a.href", F.coalesce(first["scale"], F.lit(1.0)).alias("scale"), F.coalesce(first["offset"], F.lit(0.0)).alias("offset"))


def parse_labels(pages: DataFrame, html: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, code, name from lines ``"code" name`` within pre blocks; character references, by name or number, are resolved.

    A code with two names is refused, and so is a result without rows.
    """

    @F.pandas_udf("array<struct<code:int,name:string>>")
    def labels(blocks: pd.Series) -> pd.Series:
        found = [[_LABEL.match(line) for line in unescape(b).splitlines()] for b in blocks]
        return pd.Series([[{"code": int(m.group(1)), "name": m.group(2)} for m in lines if m] for lines in found])

    blocks = pages.select(*keys, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<pre>(.*?)</pre>"), F.lit(1))).alias("b"))
    rows = blocks.select(*keys, F.inline(labels("b")))
    z = rows.groupBy(*keys, "code").agg(F.min("name").alias("name"), F.count_distinct("name").alias("n"))
    checks.require_rules(z, {"conflicting names for a code": F.col("n") == 1}, "class labels")
    if not z.limit(1).count():
        raise checks.CheckError("class labels: none found")
    return z.drop("n")


def read_product(spark: SparkSession, path: str, product: str, schemas: Mapping[str, str] = PRODUCTS) -> DataFrame:
    """A CSV product with its typed columns; a blank mukey is the empty key of a field without soils."""
    out = without_nan(spark.read.schema(schemas[product]).option("header", True).option("enforceSchema", False).csv(path))
    return out.withColumn("mukey", F.coalesce("mukey", F.lit(""))) if "mukey" in out.columns else out


def order_of_files(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """One row: rows, and out_of_order, how many rows of a CSV product with header stand before a row with a smaller key in
    its file, or files before a file with smaller keys. ``schema``: the keys' types, as DDL. Files are taken by name, rows by their place in the file."""
    types = dict(c.strip().split(None, 1) for c in schema.split(","))
    key = F.struct(*[F.col(k).cast(types[k]).alias(k) for k in keys])
    rows = spark.read.option("header", True).csv(path).select(key.alias("k"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("k").over(Window.partitionBy("file").orderBy("block", "at"))
    files = rows.withColumn("bad", (before > F.col("k")).cast("int")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    chained = files.withColumn("bad", F.col("bad") + F.coalesce((F.lag("hi").over(Window.orderBy("file")) > F.col("lo")).cast("int"), F.lit(0)))  # a row for each file
    return chained.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_order"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Raster tiles landed as Parquet: raster_id, year, tile_x, tile_y, origin_x, origin_y, pixel_size, width, height,
    values; each tile must have width by height values."""
    tiles = spark.read.parquet(path)
    checks.require_columns(tiles, ["raster_id", "year", "tile_x", "tile_y", "origin_x", "origin_y", "pixel_size", "width", "height", "values"], "tiles")
    return tiles.where(F.assert_true(F.size("values") == F.col("width") * F.col("height"), F.lit("a tile lacks values")).isNull())
