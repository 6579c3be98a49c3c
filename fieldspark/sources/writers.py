"""Writers. Files appear whole or not at all by Spark's commit protocol; order is made at the sink only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def geometry_json(rings: Column) -> Column:
    """GeoJSON geometry of rings; rings that start anew with sign 1 begin another polygon."""
    point = lambda ring: F.transform(F.arrays_zip(ring["xs"], ring["ys"]), lambda p: F.array(p["xs"], p["ys"]))
    empty = F.array().cast("array<array<array<array<double>>>>")
    polygons = F.aggregate(rings, empty, lambda acc, r: F.when((r["sign"] == 1) | (F.size(acc) == 0), F.concat(acc, F.array(F.array(point(r))))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.array(point(r)))))))
    one = F.struct(F.lit("Polygon").alias("type"), polygons[0].alias("coordinates"))
    many = F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))
    return F.when(F.size(polygons) == 1, F.to_json(one)).otherwise(F.to_json(many))


def features(df: DataFrame, rings: str = "rings") -> DataFrame:
    """One GeoJSON feature as text for each row, other columns (but srid) as properties."""
    names = [c for c in df.columns if c not in (rings, "srid")]
    body = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), F.coalesce(geometry_json(F.col(rings)), F.lit("null")), F.lit("}"))
    return df.select(*[F.col(c) for c in names[:1]], body.alias("value"))


def write_geojson(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Features line by line, in order."""
    features(df.orderBy(*order)).select("value").write.mode("overwrite").text(path)


def write_feature_collections(df: DataFrame, path: str, key: str, rows: int = 10_000, apart: bool = False) -> None:
    """Documents, a line each, that are FeatureCollections of about ``rows`` features, dealt by a hash of ``key`` and in its
    order within a document. Read with ``read_geojson(..., lines=True)``, or, if each has a file of its own (``apart``),
    with ``split=True``."""
    documents = max(1, -(-df.count() // rows))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "value"))), lambda x: x["value"]), ",")
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), one, F.lit("]}")).alias("value")
    dealt = features(df.select(key, *[c for c in df.columns if c != key])).groupBy(F.pmod(F.xxhash64(key), F.lit(documents)).alias("document"))
    out = dealt.agg(whole)
    if apart:
        out.write.mode("overwrite").partitionBy("document").text(path)
    else:
        out.select("value").write.mode("overwrite").text(path)


def write_summary(one_row: DataFrame, path: str) -> None:
    """A row as JSON with its keys in order, nulls included."""
    one_row.select(F.to_json(F.struct(*sorted(one_row.columns)), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_product(df: DataFrame, path: str, order: Sequence[str], kind: str = "csv") -> None:
    """A product in order of its keys, as CSV with header or as Parquet."""
    rows = df.orderBy(*order).write.mode("overwrite")
    rows.option("header", True).csv(path) if kind == "csv" else rows.parquet(path)
