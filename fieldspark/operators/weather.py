"""Daily weather by site: centred means, climatology, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.expressions import leap_day_of_year
from fieldspark.operators import checks


def centred_mean(daily: DataFrame, value: str = "t2m_c", name: str = "t2m_7d_c", reach: int = 3) -> DataFrame:
    """Mean of the ``reach`` rows before to after within the site; null unless all values are there."""
    w = Window.partitionBy("site_id").orderBy("date").rowsBetween(-reach, reach)
    return daily.withColumn(name, F.when(F.count(value).over(w) == 2 * reach + 1, F.avg(value).over(w)))


def with_baseline(daily: DataFrame, first_year: int, last_year: int, value: str = "t2m_c", name: str = "baseline_t2m_c") -> DataFrame:
    """Adds day_of_year, and the site's mean of ``value`` by day over the baseline years, both ends included.

    At most 366 rows a site are aggregated, combined before the shuffle, and joined back by site and day.
    """
    rows = daily.withColumn("day_of_year", leap_day_of_year(F.col("date")))
    base = rows.where(F.year("date").between(first_year, last_year)).groupBy("site_id", "day_of_year").agg(F.avg(value).alias(name))
    return rows.join(base, ["site_id", "day_of_year"], "left")


def with_anomaly(rows: DataFrame, year: int, value: str = "t2m_c", baseline: str = "baseline_t2m_c", name: str = "t2m_anomaly_c") -> DataFrame:
    """Adds value less baseline in ``year``, null in others."""
    return rows.withColumn(name, F.when(F.year("date") == year, F.col(value) - F.col(baseline)))


def analyse(daily: DataFrame, first_year: int, last_year: int, year: int) -> DataFrame:
    """The analysed series: daily (site_id, date, t2m_c, precip_mm) and the four columns above, in that order."""
    out = with_anomaly(with_baseline(centred_mean(daily), first_year, last_year), year)
    return out.select("site_id", "date", "t2m_c", "precip_mm", "t2m_7d_c", "day_of_year", "baseline_t2m_c", "t2m_anomaly_c")


def gaps(daily: DataFrame) -> DataFrame:
    """Rows whose date is not the day after the one before within the site, with ``days`` since that one."""
    before = F.lag("date").over(Window.partitionBy("site_id").orderBy("date"))
    return daily.withColumn("days", F.datediff("date", before)).where("days <> 1")


def require_continuous(daily: DataFrame) -> DataFrame:
    if gaps(daily).limit(1).count():
        raise checks.CheckError("daily series: dates must be unique and continuous")
    return daily


def year_summary(analysed: DataFrame, year: int) -> DataFrame:
    """By site: record_count, mean_anomaly_c of the year (null without any), precip_mm of the year (0 without any)."""
    own = F.year("date") == year
    return analysed.groupBy("site_id").agg(F.count(F.lit(1)).alias("record_count"), F.avg(F.when(own, F.col("t2m_anomaly_c"))).alias("mean_anomaly_c"), F.coalesce(F.sum(F.when(own, F.col("precip_mm"))), F.lit(0.0)).alias("precip_mm"))


def anomaly_extremes(analysed: DataFrame) -> DataFrame:
    """By site: dates and values of the least and greatest anomaly, the earliest of equal ones."""
    a = F.col("t2m_anomaly_c")
    low = F.min(F.when(a.isNotNull(), F.struct(a.alias("a"), F.col("date").alias("d"))))
    high = F.min(F.when(a.isNotNull(), F.struct((-a).alias("a"), F.col("date").alias("d"))))
    z = analysed.groupBy("site_id").agg(low.alias("lo"), high.alias("hi"))
    return z.select("site_id", F.col("lo.d").alias("coldest_date"), F.col("lo.a").alias("coldest_c"), F.col("hi.d").alias("warmest_date"), (-F.col("hi.a")).alias("warmest_c"))
