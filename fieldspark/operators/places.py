"""Places in a global order without one task for all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.scratch import landed, scratch_path


def global_places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place from 1 in ``order``: ranges of the order are ranked by themselves and shifted by the counts of
    the ranges before.

    The ranges are written first. Planned twice, once for the counts and once for the ranks, they could be sampled
    differently and not fit each other.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each shuffle partition at most
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inner", inner).join(before, "_range").withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_range", "_inner", "_before")


#: Accuracy of the sketches that brackets come from; most groups; most distinct values that the last step takes, and the
#: parts into which more of them are cut.
ACCURACY, GROUPS, VALUES, PARTS = 10_000, 10_000, 1_000_000, 64


def _brackets(rows: DataFrame, group: str, shares: list[float]) -> list[dict]:
    """A dictionary for each group and share: group, k, the places lo and hi on either side of the quantile, the part of
    the way between them, and the values from and to that they lie between, as a sketch tells.

    One aggregation by group; the driver gets a row for each of at most ``GROUPS`` groups.
    """
    slack = 2.0 / ACCURACY
    ends = [min(1.0, max(0.0, q + d)) for q in shares for d in (-slack, slack)]
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", ends, ACCURACY).alias("e")).limit(GROUPS + 1).collect()
    if len(found) > GROUPS:
        raise ValueError(f"quantiles are sought in more than {GROUPS} groups")
    out = []
    for r in found:
        for k, q in enumerate(shares):
            at = q * (r["n"] - 1)
            out.append({"group": r[group], "k": k, "lo": math.floor(at), "hi": math.ceil(at), "part": at - math.floor(at), "from": r["e"][2 * k], "to": r["e"][2 * k + 1]})
    return out


def _counted(rows: DataFrame, group: str, wanted: list[dict]) -> DataFrame:
    """_i (index in ``wanted``), _v, _c: rows of each value within a bracket, and of all below it, with a null value."""
    spark, kind = rows.sparkSession, rows.schema[group].dataType.simpleString()
    sought = spark.createDataFrame([(w["group"], i, w["from"], w["to"]) for i, w in enumerate(wanted)], f"_g {kind}, _i int, _from double, _to double")
    met = rows.join(F.broadcast(sought), F.col(group).eqNullSafe(F.col("_g"))).where("_v <= _to")
    return landed(met.groupBy("_i", F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "counts")


def _narrowed(values: DataFrame, wanted: list[dict]) -> DataFrame:
    """Those of ``values`` that are in the same of ``PARTS`` ranges as a wanted place; raises their ``before`` by the rows of
    the ranges below. The driver gets ``PARTS`` rows for each group and share."""
    cuts = values.groupBy("_i").agg(F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)], ACCURACY).alias("_cuts"))
    cut = landed(values.join(F.broadcast(cuts), "_i").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"), "cut")
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in cut.groupBy("_i", "_range").agg(F.sum("_c").alias("s")).collect():
        sums.setdefault(r["_i"], []).append((r["_range"], r["s"]))
    keep = []
    for i, ranges in sums.items():
        w, upto = wanted[i], wanted[i]["before"]
        held = []
        for k, s in sorted(ranges):
            if upto + s > w["lo"] and upto <= w["hi"]:
                held.append((i, k, upto))
            upto += s
        w["before"] = held[0][2]
        keep += [h[:2] for h in held]
    kept = values.sparkSession.createDataFrame(keep, "_i int, _range int")
    return landed(cut.join(F.broadcast(kept), ["_i", "_range"]).drop("_range"), "values")


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``group`` and ``q``, the exact interpolated quantiles of the values that are not null, for a few groups of any size.

    A sketch brackets each quantile. Rows below a bracket are counted, those within it are counted by value, so equal
    values are one row however many there are, and nothing is sorted. More than ``VALUES`` values within brackets are cut
    into ranges again, of which only those that hold a wanted place stay. Where a sketch errs and a place lies outside its
    bracket, that bracket becomes all values. Groups without values are left out; null is a group like others.
    """
    spark, kind = df.sparkSession, df.schema[group].dataType.simpleString()
    rows = landed(df.select(group, F.col(value).cast("double").alias("_v")).where("_v is not null"), "column")
    wanted = _brackets(rows, group, shares)
    while True:
        counts = _counted(rows, group, wanted)
        sums = counts.groupBy("_i").agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("before"), F.sum("_c").alias("upto"), F.count("_v").alias("values"))
        for r in sums.collect():
            wanted[r["_i"]] |= r.asDict()
        missed = [w for w in wanted if not (w["before"] <= w["lo"] and w["hi"] < w["upto"]) and not math.isnan(w["to"])]
        if not missed:
            break
        for w in missed:
            w |= {"from": -math.inf, "to": math.nan}  # NaN is the greatest value
    values, many = counts.where("_v is not null"), sum(w["values"] for w in wanted)
    while many > VALUES:
        values, before = _narrowed(values, wanted), many
        many = values.count()
        if many == before:
            break
    sought = spark.createDataFrame([(i, w["lo"], w["hi"], w["before"]) for i, w in enumerate(wanted)], "_i int, _lo long, _hi long, _before long")
    upto = values.join(F.broadcast(sought), "_i").withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy("_i").orderBy("_v")))
    ends = upto.groupBy("_i").agg(*[F.min(F.when(F.col("_upto") > F.col(c), F.col("_v"))).alias(c[1:]) for c in ("_lo", "_hi")])
    named = spark.createDataFrame([(w["group"], i, w["k"], w["part"]) for i, w in enumerate(wanted)], f"`{group}` {kind}, _i int, _k int, _part double")
    each = ends.join(F.broadcast(named), "_i").select(group, "_k", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_part")).alias("_q"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_q"))), lambda x: x["_q"]).alias("q"))
