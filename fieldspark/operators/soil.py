"""Soil horizons to components, map units and fields, with a coverage for each metric."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.expressions import carbon_stock, overlap_length
from fieldspark.operators import checks
from fieldspark.operators.places import exact_quantiles
from fieldspark.sources.scratch import landed


@dataclass(frozen=True)
class Metric:
    name: str
    source: str | None  #: horizon column; None: made from others
    coverage: str
    unit: str
    acidity: bool = False


#: The metrics' names, the horizon columns that they come from, their coverage columns and units.
METRICS = (
    Metric("organic_matter_pct", "om_r", "om_coverage_fraction", "%"),
    Metric("ph_h2o", "ph1to1h2o_r", "ph_coverage_fraction", "pH units", acidity=True),
    Metric("cec_cmol_kg", "cec7_r", "cec_coverage_fraction", "cmol(+)/kg"),
    Metric("erosion_k_factor", "kwfact", "erosion_coverage_fraction", "dimensionless K factor"),
    Metric("carbon_storage_mg_c_ha", None, "carbon_coverage_fraction", "Mg C/ha"),
)
DEPTH_LIMIT_CM = 30.0
#: The horizons' columns of numbers.
HORIZON = ["hzdept_r", "hzdepb_r", "om_r", "ph1to1h2o_r", "cec7_r", "dbthirdbar_r", "kwfact"]


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the values present, by weight; null where their weights sum to nothing."""
    w = F.when(value.isNotNull() & (weight > 0), weight)
    return F.sum(value * w) / F.nullif(F.sum(w), F.lit(0.0))


def weighted_ph(ph: Column, weight: Column) -> Column:
    """Weighted mean of pH by hydrogen ion activity."""
    return -F.log10(weighted_mean(F.pow(F.lit(10.0), -ph), weight))


def _mean(metric: Metric, value: Column, weight: Column) -> Column:
    return weighted_ph(value, weight) if metric.acidity else weighted_mean(value, weight)


def component_metrics(horizons: DataFrame, limit: float = DEPTH_LIMIT_CM, also: Sequence[Column] = ()) -> DataFrame:
    """One row for each cokey: metrics of its horizons weighted by thickness above ``limit``, carbon summed.

    Horizons with a missing depth or no thickness above the limit are passed over; ``has_profile`` tells whether any
    remains. A metric without values is null. ``also``: further aggregates.
    """
    h = horizons.withColumn("_w", overlap_length(F.col("hzdept_r"), F.col("hzdepb_r"), limit)).withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")))
    values = [_mean(m, F.col(m.source), F.col("_w")).alias(m.name) for m in METRICS if m.source]
    carbon = F.sum(carbon_stock(F.col("om_r"), F.col("dbthirdbar_r"), F.col("_w"))).alias("carbon_storage_mg_c_ha")
    return h.groupBy("cokey").agg(*values, carbon, (F.count("_w") > 0).alias("has_profile"), *also)


def mapunit_metrics(components: DataFrame, values: DataFrame) -> DataFrame:
    """One row for each mukey: metrics of its components with a positive share, weighted by share.

    Each metric takes the components that have it; ``<metric>_coverage`` is their part of all positive shares.
    ``has_soil``: some component with a positive share has a profile.
    """
    pct = F.when(F.col("comppct_r") > 0, F.col("comppct_r"))
    joined = components.select("mukey", "cokey", "comppct_r").join(values, "cokey", "left").withColumn("_p", pct)
    aggs = []
    for m in METRICS:
        v = F.col(m.name)
        aggs += [_mean(m, v, F.col("_p")).alias(m.name), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_p"))) / F.nullif(F.sum("_p"), F.lit(0.0)), F.lit(0.0)).alias(f"{m.name}_coverage")]
    soil = F.coalesce(F.bool_or(F.col("_p").isNotNull() & F.coalesce("has_profile", F.lit(False))), F.lit(False))
    return joined.groupBy("mukey").agg(*aggs, soil.alias("has_soil"))


def field_metrics(overlaps: DataFrame, mapunits: DataFrame) -> DataFrame:
    """One row for each field_id: metrics weighted by fraction times coverage, and coverages of at most 1.

    Fields whose overlaps have no soil data stay, with null metrics and coverages of 0.
    """
    joined = overlaps.select("field_id", "mukey", "field_fraction").join(mapunits, "mukey", "left")
    aggs = [F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("has_soil"), F.col("field_fraction"))), F.lit(0.0))).alias("soil_coverage_fraction")]
    for m in METRICS:
        v, w = F.col(m.name), F.col("field_fraction") * F.col(f"{m.name}_coverage")
        aggs += [_mean(m, v, w).alias(m.name), F.least(F.lit(1.0), F.coalesce(F.sum(F.when(v.isNotNull() & (w > 0), w)), F.lit(0.0))).alias(m.coverage)]
    out = joined.groupBy("field_id").agg(*aggs)
    return out.select("field_id", *[m.name for m in METRICS], "soil_coverage_fraction", *[m.coverage for m in METRICS])


def checked_tables(components: DataFrame, horizons: DataFrame, overlaps: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components and overlaps with trimmed keys and numbers, and in place of horizons the metrics by component, after all
    gates of the three tables. Rules of components and overlaps are counted as these are written; horizons are dealt by
    component, where repeated rows, broken rules and metrics are one pass, and only the metrics are written. Keys, sums and
    references of all three are one job. Whole numbers as cokey of both tables stay numbers, which need no trimming.

    pH may be 0 to 14, but one that has weight must be above 0. Depths must be in order where both are known. Horizons that
    are equal in all columns are refused, or count once with ``once``.
    """
    for df, name, columns in ((components, "components", ["mukey", "cokey", "comppct_r", "compname"]), (horizons, "horizons", ["cokey", *HORIZON]), (overlaps, "overlaps", ["field_id", "mukey", "field_fraction"])):
        checks.require_columns(df, columns, name)
    whole = {"cokey"} if all(isinstance(df.schema["cokey"].dataType, T.IntegralType) for df in (components, horizons)) else set()

    def typed(df: DataFrame, keys: list[str], numbers: list[str], may_be_empty: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Column]]:
        raw = checks.key_rules([k for k in keys if k not in may_be_empty and k not in whole]) | checks.number_rules(numbers, df)
        raw |= {f"empty {k}": F.col(k).isNotNull() for k in keys if k in whole}
        named = {n: f"_raw{k}" for k, n in enumerate(raw)}
        out = checks.as_numbers(checks.as_keys(df.withColumns({c: raw[n] for n, c in named.items()}), [k for k in keys if k not in whole]), numbers)
        return out, {n: F.col(c) for n, c in named.items()}

    components, c_rules = typed(components, ["mukey", "cokey", "compname"], ["comppct_r"])
    horizons, h_rules = typed(horizons, ["cokey"], HORIZON)
    overlaps, o_rules = typed(overlaps, ["field_id", "mukey"], ["field_fraction"], ("mukey",))
    weighted = overlap_length(F.col("hzdept_r"), F.col("hzdepb_r")) > 0

    def kept(df: DataFrame, label: str, rules: dict[str, Column]) -> DataFrame:
        written = checks.landed_by_rules(df, rules, label)
        return written.drop(*[c for c in written.columns if c.startswith("_raw")])

    components = kept(components, "components", c_rules | {"percentages must be non-negative": F.col("comppct_r") >= 0})
    overlaps = kept(overlaps, "overlaps", o_rules | {"field fractions must be between 0 and 1": F.coalesce(F.col("field_fraction").between(0, 1), F.lit(False))})
    values, v_rules = _checked_metrics(horizons, h_rules | {
        "organic matter must be non-negative": F.col("om_r") >= 0, "pH must be between 0 and 14": F.col("ph1to1h2o_r").between(0, 14), "weighted pH must be above 0": ~weighted | (F.col("ph1to1h2o_r") > 0),
        "CEC must be non-negative": F.col("cec7_r") >= 0, "bulk density must be positive": F.col("dbthirdbar_r") > 0, "K factor must be non-negative": F.col("kwfact") >= 0, "bottom depth is above top depth": F.col("hzdepb_r") >= F.col("hzdept_r"),
    }, once)
    checks.require_together(
        checks.gate(components, "components", unique=["cokey"]), checks.gate(values, "horizons", v_rules, parent=components, key="cokey"),
        checks.gate(overlaps, "overlaps", unique=["field_id", "mukey"], sums=("field_id", "field_fraction", 1.000001)),
    )
    return components, values, overlaps


def _checked_metrics(horizons: DataFrame, rules: dict[str, Column], once: bool) -> tuple[DataFrame, dict[str, Column]]:
    """``component_metrics`` written, with rules over its rows that hold just if ``rules`` do over the horizons and, unless
    ``once``, none is repeated. One exchange, by cokey: a component's horizons are a profile, a few rows."""
    columns = [c for c in horizons.columns if not c.startswith("_raw")]
    broken = [F.when(~r, F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules.values())]
    dealt = horizons.select(*columns, reduce(Column.bitwiseOR, broken).alias("_broken")).repartition("cokey")
    rows = dealt.groupBy(*columns).agg(F.bit_or("_broken").alias("_broken"), F.count(F.lit(1)).alias("_n"))
    values = landed(component_metrics(rows, also=[F.bit_or("_broken").alias("_broken"), F.max("_n").alias("_n")]), "horizons")
    seen = {} if once else {f"duplicate {'/'.join(columns)}": F.col("_n") == 1}
    return values, seen | {n: F.col("_broken").bitwiseAND(F.lit(1 << k)) == 0 for k, n in enumerate(rules)}


def aggregate_soil(components: DataFrame, horizons: DataFrame, overlaps: DataFrame, once: bool = False) -> DataFrame:
    """Fields' soil metrics and coverages from checked tables; horizons that are equal in all columns are refused, or count
    once with ``once``."""
    components, values, overlaps = checked_tables(components, horizons, overlaps, once)
    return field_metrics(overlaps, mapunit_metrics(components, values))


def soil_summary(rows: DataFrame) -> DataFrame:
    """One row for each metric: unit, mean, median, non_null_fields, mean_coverage_fraction; nulls where no values."""
    entries = [F.struct(F.lit(m.name).alias("metric"), F.lit(m.unit).alias("unit"), F.col(m.name).alias("value"), F.col(m.coverage).alias("coverage")) for m in METRICS]
    each = rows.select(F.inline(F.array(*entries)))
    z = each.groupBy("metric", "unit").agg(F.avg("value").alias("mean"), F.count("value").alias("non_null_fields"), F.avg("coverage").alias("mean_coverage_fraction"))
    middle = exact_quantiles(each, "metric", "value", [0.5]).select("metric", F.col("q")[0].alias("median"))
    return z.join(middle, "metric", "left").select("metric", "unit", "mean", "median", "non_null_fields", "mean_coverage_fraction")
