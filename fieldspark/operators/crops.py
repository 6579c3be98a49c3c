"""Crop history: wide form, rotations, summaries of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.expressions import alternating, letter_sequence, only_classes
from fieldspark.operators import checks
from fieldspark.operators.places import exact_quantiles


def wide_history(history: DataFrame, years: Sequence[int]) -> DataFrame:
    """crop_{year}_{code,name,fraction,coverage} for each field; a repeated (field_id, year) is refused."""
    checks.require_unique(history, ["field_id", "year"], "crop history")
    parts = {"code": "cdl_code", "name": "cdl_name", "fraction": "majority_fraction", "coverage": "coverage_fraction"}
    wide = history.groupBy("field_id").pivot("year", list(years)).agg(*[F.first(c).alias(n) for n, c in parts.items()])
    return wide.select("field_id", *[F.col(f"{y}_{n}").alias(f"crop_{y}_{n}") for y in years for n in parts])


def join_history(fields: DataFrame, wide: DataFrame) -> DataFrame:
    """Fields with their wide history; fields without any drop out."""
    return fields.join(wide, "field_id", "inner")


def rotations(wide: DataFrame, years: Sequence[int], letters: Mapping[str, str], main: Sequence[str]) -> DataFrame:
    """field_id, sequence of letters, whether all years are main crops, whether each year differs from the last."""
    names = [F.col(f"crop_{y}_name") for y in years]
    return wide.select("field_id", letter_sequence(names, letters).alias("sequence"), only_classes(names, main).alias("main_only"), alternating(names).alias("alternating"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value that is not null."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def field_summary(fields: DataFrame, history: DataFrame) -> DataFrame:
    """One row: counts and areas of fields, and records, missing classes and repeated keys of their history."""
    f = fields.agg(F.count(F.lit(1)).alias("field_count"), F.sum("area_ha").alias("total_area_ha"), F.avg("area_ha").alias("mean_area_ha"))
    middle = exact_quantiles(fields.select(F.lit(1).alias("g"), "area_ha"), "g", "area_ha", [0.5]).agg(F.max(F.col("q")[0]).alias("median_area_ha"))
    keys = history.groupBy("field_id", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cdl_code").isNull()).alias("m"))
    h = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("crop_record_count"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing_crop_record_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_field_id_count"))
    return f.crossJoin(middle).crossJoin(h)  # one row each


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls of each column: column, missing."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, mean, std, min, q25, q50, q75, max with exact interpolated quartiles."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    z = rows.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    z = z.join(exact_quantiles(rows, "column", "v", [0.25, 0.5, 0.75]), "column", "left")
    return z.select("column", "n", "mean", "std", "min", *[F.col("q")[k].alias(f"q{q}") for k, q in enumerate((25, 50, 75))], "max")


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """bin, lo, hi, n over equal widths from least to greatest value, the last bin closed; empty bins have 0.

    Equal values all go to the bins of one unit around them. No values: no rows.
    """
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    ends = ends.withColumn("w", (F.col("b") - F.col("a")) / bins)
    counts = df.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((v - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select("a", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def product_counts(products: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Of each product (frame, keys, columns): product, rows, distinct_keys, missing; one pass over each."""
    out = None
    for name, (df, keys, columns) in products.items():
        missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
        one = df.agg(F.lit(name).alias("product"), F.count(F.lit(1)).alias("rows"), F.count_distinct(*keys).alias("distinct_keys"), missing.cast("long").alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


def rank_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
