"""Operators on small hand-computed input."""

import datetime as dt
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import expressions as E
from fieldspark.functions import boxes, convex, geometry, outlines, validity
from fieldspark.operators import checks, crops, imagery, integrate, overlay, report, scan, soil, spatial, weather, zonal
from fieldspark.operators.checks import CheckError


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def pixels(spark, codes, zone="z"):
    return spark.createDataFrame([(zone, c) for c in codes], "zone string, code int")


# --- zones


@pytest.mark.parametrize(
    ("codes", "least", "want"),
    [([1, 1, 5, 0], 0.7, (4, 3, 0.75, 1, 2 / 3)), ([1, 0, 0, 0], 0.7, (4, 1, 0.25, None, None)), ([2, 2, 1, 1], 0.0, (4, 4, 1.0, 1, 0.5)), ([1] * 7 + [0] * 3, 0.7, (10, 7, 0.7, 1, 1.0)), ([0, 0], 0.0, (2, 0, 0.0, None, None))],
)
def test_categorical_summary(spark, codes, least, want):
    got = rows(zonal.categorical_summary(pixels(spark, codes), ["zone"], "code", F.col("code") != 0, least))[0][1:]
    assert got == pytest.approx(want)


def test_continuous_summary(spark):
    values = [1.0, 2.0, math.nan, math.inf, -math.inf, 3.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[2:5]] + [("c", None)], "z string, v double")
    assert rows(zonal.continuous_summary(df, ["z"], "v", F.lit(True)), "z") == [("a", 2.0, 2.0, 3, 6, 0.5), ("b", None, None, 0, 3, 0.0), ("c", None, None, 0, 1, 0.0)]


def box(x, y, w, h, sign=1):
    return {"sign": sign, "xs": [float(v) for v in (x, x + w, x + w, x)], "ys": [float(v) for v in (y, y, y + h, y + h)]}


def polygons(spark, named, key="field_id", srid=5070):
    return spark.createDataFrame([(k, srid, r) for k, r in named], f"{key} string, srid int, rings {spatial.RINGS}")


def test_zonal_counts_and_history(spark):
    codes = [1, 1, 0, 0, 1, 0, 0, 0, 5, None, 0, 0, 1, 1, 0, 0]
    tile = ("r", 2023, 0, 0, 0.0, 120.0, 30.0, 4, 4, codes)
    tiles = spark.createDataFrame([tile], "raster_id string, year int, tile_x int, tile_y int, origin_x double, origin_y double, pixel_size double, width int, height int, `values` array<int>")
    grids = spark.createDataFrame([("r", 5070, 0.0, 120.0, 30.0, 4, 1, 1)], "raster_id string, srid int, x0 double, y0 double, pixel_size double, tile_size int, tiles_x int, tiles_y int")
    fields = spatial.with_measures(polygons(spark, [("left", [box(0, 60, 60, 60)]), ("right", [box(60, 60, 60, 60)]), ("none", [box(0, 30, 60, 30)]), ("away", [box(500, 500, 9, 9)])]))
    counts = zonal.zonal_counts(tiles, fields, grids)
    labels = spark.createDataFrame([(1, "Corn"), (5, "Soybeans")], "code int, name string")
    assert rows(zonal.crop_history(counts, labels), "field_id") == [("left", 2023, 1, "Corn", 1.0, 0.75, 3, 4), ("none", 2023, 5, "Soybeans", 1.0, 1.0, 1, 1), ("right", 2023, None, None, None, 0.0, 0, 4)]
    with pytest.raises(CheckError, match="unknown code 5"):
        zonal.crop_history(counts, labels.where("code = 1"))


def test_nearest_resample_and_clear_fraction(spark):
    coarse = spark.createDataFrame([("s", r, c, 0.0, 40.0, 20.0, 4 + 2 * r + c) for r in (0, 1) for c in (0, 1)], "scene_id string, row int, col int, x0 double, y0 double, pixel_size double, scl int")
    fine = spark.createDataFrame([("s", r, c, 10.0 * c + 5, 40 - 10.0 * r - 5) for r in range(4) for c in range(5)], "scene_id string, r int, c int, x double, y double")
    got = {(r, c): v for _, r, c, _, _, v in rows(zonal.nearest_resample(fine, coarse, ["scene_id"], "scl").select("scene_id", "r", "c", "x", "y", "scl"))}
    assert [[got[r, c] for c in range(5)] for r in range(4)] == [[4, 4, 5, 5, 0]] * 2 + [[6, 6, 7, 7, 0]] * 2
    df = spark.createDataFrame([("s", 4, True), ("s", 8, False), ("s", 0, True), ("t", 4, False)], "scene_id string, scl int, inside boolean")
    assert rows(zonal.clear_fraction(df, "scene_id", "scl", F.col("inside")), "scene_id") == [("s", 0.5), ("t", 0.0)]


# --- expressions


def test_ndvi_and_masks(spark):
    df = spark.createDataFrame([(2000, 5000, True), (2000, 5000, False), (0, 1000, True), (1000, 1000, True), (0, 5000, True)], "r int, n int, ok boolean")
    one = lambda *a: [r[0] for r in df.select(E.ndvi(F.col("r"), F.col("n"), F.col("ok"), F.lit(0.0001), F.lit(-0.1), *a)).collect()]
    assert one() == [pytest.approx(0.6), None, pytest.approx(-1.0), None, 1.0]
    assert one(F.lit(0.0002), F.lit(-0.2))[0] == pytest.approx(7 / 9)
    v = spark.createDataFrame([(0.0,), (1.0,), (math.nan,), (None,)], "v double")
    assert [r[0] for r in v.select(E.has_data(F.col("v"), F.lit(0.0))).collect()] == [False, True, False, False]
    assert [r[0] for r in v.select(E.has_data(F.col("v"), F.lit(None).cast("double"))).collect()] == [True, True, False, False]
    assert [r[0] for r in spark.range(12).select(E.clear_class(F.col("id"))).collect()] == [4 <= k <= 7 for k in range(12)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(E.overlap_length(F.lit(a), F.lit(b))) for a, b in ((10.0, 40.0), (35.0, 60.0), (-5.0, 10.0))] == [20.0, 0.0, 10.0]
    assert one(E.carbon_stock(F.lit(3.448), F.lit(1.3), F.lit(30.0))) == pytest.approx(78.0)
    days = ["2020-02-28", "2020-02-29", "2020-03-01", "2020-12-31", "2021-02-28", "2021-03-01", "2021-12-31"]
    assert [one(E.leap_day_of_year(F.lit(d).cast("date"))) for d in days] == [59, 60, 61, 366, 59, 61, 366]
    assert [one(E.ndvi_band(F.lit(v))) for v in (0.29, 0.3, 0.6, 0.61)] == ["alert", "watch", "watch", "developed"]
    assert [one(E.number_text(F.lit(v))) for v in (1234.5, 2.0, 0.9417999, 1000.0)] == ["1,234.5", "2", "0.942", "1,000"]
    assert one(E.date_of_stamp(F.lit("2023-07-01T17:00:00Z"))) == "2023-07-01" and one(E.soil_label(F.lit("55"), F.lit("Nicollet"))) == "55 — Nicollet"
    codes = spark.createDataFrame([("L138B",), ("55",), ("107",), ("6",), ("W",)], "c string")
    assert [r[0] for r in codes.orderBy(*E.numeric_order(F.col("c"))).collect()] == ["6", "55", "107", "L138B", "W"]
    w = spark.range(1).select(*[v.alias(k) for k, v in E.pixel_window(*map(F.lit, (11.0, 5.0, 29.0, 25.0, 0.0, 30.0, 10.0, 4, 2))).items()]).first()
    assert tuple(w) == (0, 2, 1, 3, False)
    with pytest.raises(ValueError):
        E.overlap_length(F.lit(1.0), F.lit(2.0), 0)


# --- gates


def test_gates_refuse(spark):
    df = spark.createDataFrame([("a", 1.0, "1"), ("a", math.nan, "x"), (" ", 2.5, "")], "k string, v double, t string")
    refused = [
        (lambda: checks.require_columns(df, ["k", "z"], "t"), "missing required columns: z"),
        (lambda: checks.require_unique(df, ["k"], "t"), "duplicate k"),
        (lambda: checks.require_same_keys(df, df.where("k = 'a'"), "k", "t"), "missing k"),
        (lambda: checks.require_same_keys(df.where("k = 'a'"), df, "k", "t"), "unknown k"),
        (lambda: checks.require_reference(df, df.where("k = 'a'"), "k", "t"), "unknown k"),
        (lambda: checks.require_rules(df, {"v small": F.col("v") < 2}, "t"), "v small"),
        (lambda: checks.require_finite(df, ["v"], "t"), "non-finite v"),
        (lambda: checks.require_finite(df.where("v > 2 and not isnan(v)"), ["v"], "t", integral=True), "non-integral v"),
        (lambda: checks.to_numbers(df, ["t"], "t"), "invalid numeric t"),
        (lambda: checks.to_keys(df, ["k"], "t"), "empty k"),
        (lambda: checks.require_period(df, "k", "a", "b", 3, "t"), "expected 3 rows"),
        (lambda: checks.require_count(df, 2, "t"), "expected 2 rows"),
        (lambda: checks.require_sums(df.fillna(0.0), "k", "v", 0.5, "t"), "exceed 0.5"),
        (lambda: checks.require_text(df, ["t"], "t"), "empty t"),
        (lambda: checks.require_one_to_one({"f": df.where("k = ' '"), "g": df}, "k"), "g: duplicate k; g: unknown k"),
    ]
    for call, text in refused:
        with pytest.raises(CheckError, match=text):
            call()
    assert checks.to_keys(df, ["k"], "t", ["k"]).where("k = ''").count() == 1
    assert [r[0] for r in checks.to_numbers(spark.createDataFrame([(" 1.5 ",), ("",), (None,), ("NaN",)], "t string"), ["t"], "t").collect()] == [1.5, None, None, None]


# --- soil

HZ = "cokey string, hzdept_r double, hzdepb_r double, om_r double, ph1to1h2o_r double, cec7_r double, dbthirdbar_r double, kwfact double"
CO = "mukey string, cokey string, comppct_r double, compname string"
OV = "field_id string, mukey string, field_fraction double"


def soil_of(spark, components, horizons, overlaps):
    return rows(soil.aggregate_soil(spark.createDataFrame(components, CO), spark.createDataFrame(horizons, HZ), spark.createDataFrame(overlaps, OV)), "field_id")


def test_soil_weights(spark):
    components = [("1", "a", 80.0, "A"), ("1", "b", 20.0, "B"), ("2", "c", 100.0, "C")]
    horizons = [("a", 0.0, 30.0, 4.0, 6.0, 20.0, 1.3, 0.3), ("b", 0.0, 30.0, 2.0, 7.0, 10.0, 1.3, 0.2), ("c", 0.0, 30.0, 2.0, 7.0, 10.0, 1.3, 0.2)]
    got = soil_of(spark, components, horizons, [("F", "1", 0.6), ("F", "2", 0.4)])[0]
    ph1 = -math.log10(0.8e-6 + 0.2e-7)
    assert got[1] == pytest.approx(0.6 * 3.6 + 0.4 * 2.0) and got[2] == pytest.approx(-math.log10(0.6 * 10**-ph1 + 0.4e-7)) and got[6:] == pytest.approx((1.0,) * 6)
    one = soil.component_metrics(spark.createDataFrame([("a", 0.0, 15.0, 3.448, 7.0, 1.0, 1.3, 0.1), ("a", 15.0, 30.0, 3.448, 7.0, 1.0, 1.3, 0.1)], HZ)).first()
    assert one.carbon_storage_mg_c_ha == pytest.approx(78.0) and one.has_profile


def test_soil_gaps(spark):
    components = [("1", "a", 50.0, "A"), ("1", "b", 50.0, "B"), ("w", "w", 100.0, "Water"), ("n", "n", None, "None")]
    horizons = [("a", 0.0, 30.0, 4.0, 7.0, None, None, None), ("b", 0.0, 30.0, None, None, None, None, None), ("b", None, 30.0, 9.0, 7.0, None, None, None), ("b", 40.0, 60.0, 9.0, 7.0, None, None, None)]
    got = soil_of(spark, components, horizons, [("F", "1", 0.8), ("F", "w", 0.2), ("G", "w", 1.0), ("H", "", 0.0)])
    assert got[0][1:] == pytest.approx((4.0, 7.0, None, None, None, 0.8, 0.4, 0.4, 0.0, 0.0, 0.0))
    assert [g[1:] for g in got[1:]] == [(None,) * 5 + (0.0,) * 6] * 2
    summary = {r.metric: r for r in soil.soil_summary(soil.aggregate_soil(spark.createDataFrame(components, CO), spark.createDataFrame(horizons, HZ), spark.createDataFrame([("F", "1", 0.8)], OV))).collect()}
    assert summary["organic_matter_pct"].mean == 4.0 and summary["cec_cmol_kg"].mean is None and summary["cec_cmol_kg"].non_null_fields == 0


@pytest.mark.parametrize(
    ("change", "text"),
    [
        ({"horizons": [("a", 20.0, 10.0, 1.0, 6.0, 1.0, 1.0, 0.1)]}, "bottom depth"), ({"horizons": [("a", 0.0, 10.0, -1.0, 6.0, 1.0, 1.0, 0.1)]}, "organic matter"),
        ({"horizons": [("a", 0.0, 10.0, 1.0, 15.0, 1.0, 1.0, 0.1)]}, "pH must"), ({"horizons": [("a", 0.0, 10.0, 1.0, 0.0, 1.0, 1.0, 0.1)]}, "weighted pH"), ({"horizons": [("a", 0.0, 10.0, 1.0, 6.0, 1.0, 0.0, 0.1)]}, "bulk density"),
        ({"horizons": [("z", 0.0, 10.0, 1.0, 6.0, 1.0, 1.0, 0.1)]}, "unknown cokey z"), ({"horizons": [("a", 0.0, 10.0, 1.0, 6.0, 1.0, 1.0, 0.1)] * 2}, "duplicate"),
        ({"components": [("1", "a", 50.0, "A"), ("2", "a", 50.0, "A")]}, "duplicate cokey"), ({"components": [("1", "a", -1.0, "A")]}, "percentages"),
        ({"overlaps": [("F", "1", 0.5), ("F", "1", 0.1)]}, "duplicate field_id/mukey"), ({"overlaps": [("F", "1", 0.9), ("F", "2", 0.2)]}, "exceed"), ({"overlaps": [("F", "1", None)]}, "between 0 and 1"),
    ],
)
def test_soil_refuses(spark, change, text):
    parts = {"components": [("1", "a", 50.0, "A")], "horizons": [("a", 0.0, 10.0, 1.0, 6.0, 1.0, 1.0, 0.1)], "overlaps": [("F", "1", 1.0)]} | change
    with pytest.raises(CheckError, match=text):
        soil_of(spark, **parts)


# --- weather


def days(spark, values, start="2001-01-01"):
    first = dt.date.fromisoformat(start)
    return spark.createDataFrame([("s", first + dt.timedelta(k), v, 1.0) for k, v in enumerate(values)], "site_id string, date date, t2m_c double, precip_mm double")


def test_centred_mean_and_gaps(spark):
    got = [r.t2m_7d_c for r in weather.centred_mean(days(spark, map(float, range(9)))).orderBy("date").collect()]
    assert got == [None] * 3 + [3.0, 4.0, 5.0] + [None] * 3
    assert [r.t2m_7d_c for r in weather.centred_mean(days(spark, [0.0, 1.0, None, 3.0, 4.0, 5.0, 6.0])).collect()] == [None] * 7
    with pytest.raises(CheckError, match="continuous"):
        weather.require_continuous(days(spark, [1.0, 2.0]).unionByName(days(spark, [1.0], "2001-01-05")))


def test_baseline_and_anomaly(spark):
    values = {"1991-01-01": 1.0, "2020-01-01": 3.0, "2021-01-01": 100.0, "2023-01-01": 5.0, "1992-02-29": 2.0, "1993-03-01": 6.0, "2023-03-01": 6.0, "2023-03-02": None}
    df = spark.createDataFrame([("s", dt.date.fromisoformat(d), v, 1.0) for d, v in values.items()], "site_id string, date date, t2m_c double, precip_mm double")
    out = weather.analyse(df, 1991, 2020, 2023)
    got = {str(r.date): (r.baseline_t2m_c, r.t2m_anomaly_c) for r in out.collect()}
    assert got["2021-01-01"] == (2.0, None) and got["2023-01-01"] == (2.0, 3.0) and got["1992-02-29"][0] == 2.0 and got["2023-03-01"] == (6.0, 0.0) and got["2023-03-02"] == (None, None)
    assert rows(weather.year_summary(out, 2023)) == [("s", 8, 1.5, 3.0)] and rows(weather.year_summary(out, 1950)) == [("s", 8, None, 0.0)]
    assert rows(weather.anomaly_extremes(out)) == [("s", dt.date(2023, 3, 1), 0.0, dt.date(2023, 1, 1), 3.0)]


# --- crops

HIST = "field_id string, year int, cdl_code int, cdl_name string, majority_fraction double, coverage_fraction double, valid_pixels long, total_pixels long"


def test_wide_history_rotations_and_summary(spark):
    data = [("A", 2020, 1, "Corn", 0.9, 1.0, 9, 9), ("A", 2021, 5, "Soybeans", 0.8, 1.0, 9, 9), ("B", 2020, None, None, None, 0.1, 1, 9), ("B", 2021, 1, "Corn", 1.0, 1.0, 9, 9)]
    hist = spark.createDataFrame(data, HIST)
    wide = crops.wide_history(hist, [2020, 2021])
    assert wide.columns[:3] == ["field_id", "crop_2020_code", "crop_2020_name"] and rows(wide.select("field_id", "crop_2020_code", "crop_2021_name"), "field_id") == [("A", 1, "Soybeans"), ("B", None, "Corn")]
    fields = spark.createDataFrame([("A", 2.0), ("B", 4.0), ("C", 9.0)], "field_id string, area_ha double")
    assert crops.join_history(fields, wide).count() == 2
    letters = {"Corn": "C", "Soybeans": "S"}
    assert rows(crops.rotations(wide.where("field_id = 'A'"), [2020, 2021], letters, ["Corn", "Soybeans"])) == [("A", "C → S", True, True)]
    with pytest.raises(Exception, match="no class"):
        crops.rotations(wide, [2020, 2021], letters, ["Corn"]).collect()
    with pytest.raises(CheckError, match="duplicate"):
        crops.wide_history(hist.unionByName(hist), [2020])
    assert rows(crops.field_summary(fields, hist.unionByName(hist.limit(1)))) == [(3, 15.0, 5.0, 4.0, 5, 1, 1)]
    assert dict(rows(crops.missing_counts(hist)))["cdl_name"] == 1
    assert rows(crops.value_counts(hist, "cdl_name"), "cdl_name") == [("Corn", 2), ("Soybeans", 1)]


def test_histogram_and_describe(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 8, 8)] + [(None,)], "v double")
    assert [r.n for r in crops.histogram(df, "v").orderBy("bin").collect()] == [1, 1, 1, 0, 0, 0, 0, 2]
    assert sum(r.n for r in crops.histogram(df.where("v = 8"), "v").collect()) == 2 and crops.histogram(df.where("v is null"), "v").count() == 0
    assert rows(crops.describe(df, ["v"]))[0][:3] == ("v", 5, 3.8) and rows(crops.describe(df, ["v"]))[0][5:8] == (1.0, 2.0, 8.0)
    assert rows(crops.product_counts({"p": (df, ["v"], ["v"])})) == [("p", 6, 4, 1)]


# --- imagery


def test_scene_choice(spark):
    scenes = spark.createDataFrame([("a", 5.0, "2023-07-01"), ("b", 5.0, "2023-07-02"), ("c", 20.0, "2023-06-01"), ("d", 5.0, "2023-06-30"), ("e", None, "2023-06-01")], "scene_id string, cloud_cover double, datetime string")
    assert [r.scene_id for r in imagery.scene_order(scenes).orderBy("rank").collect()] == ["d", "a", "b", "c", "e"]
    fractions = spark.createDataFrame([("d", 0.5), ("a", 0.7), ("b", 1.0)], "scene_id string, valid_fraction double")
    got = {r.scene_id: r.status for r in imagery.require_scene(imagery.choose_scenes(scenes, fractions)).collect()}
    assert got == {"d": "rejected", "a": "chosen", "b": "untried", "c": "untried", "e": "untried"}
    with pytest.raises(CheckError, match="none meets"):
        imagery.require_scene(imagery.choose_scenes(scenes, fractions, 1.1))


def test_field_ndvi(spark):
    px = spark.createDataFrame([("s", "F", 2000, 5000, 4), ("s", "F", 2000, 5000, 8), ("s", "F", 0, 5000, 4), ("s", "G", 2000, 5000, 3)], "scene_id string, field_id string, red int, nir int, scl int")
    bands = spark.createDataFrame([("s", "red", 0.0001, -0.1, 0.0), ("s", "nir", 0.0001, -0.1, None)], "scene_id string, band string, scale double, offset double, nodata double")
    out = imagery.field_ndvi(px, bands)
    got = rows(out, "field_id")
    assert got[0] == ("F", pytest.approx(0.6), pytest.approx(0.6), 1, 3, pytest.approx(1 / 3)) and got[1] == ("G", None, None, 0, 1, 0.0)
    with pytest.raises(CheckError, match="no valid pixel"):
        imagery.require_valid_pixels(out)
    grid = spark.createDataFrame([("s", b, 10, 10, 32615, 0.0, 0.0, p) for b, p in (("red", 10.0), ("nir", 20.0))], "scene_id string, band string, width int, height int, srid int, x0 double, y0 double, pixel_size double")
    with pytest.raises(CheckError, match="grids differ in s"):
        imagery.require_same_grids(grid)


# --- integration and report


def test_dominant_soils_and_integration(spark):
    over = spark.createDataFrame([("A", "9", "s9", "n9", 50_000.0), ("A", "10", "s10", "n10", 50_000.0), ("B", "2", "s2", "n2", 20_000.0), ("B", "3", "s3", "n3", 70_000.0)], "field_id string, mukey string, musym string, muname string, overlap_area_m2 double")
    got = rows(integrate.dominant_soils(over.withColumn("overlap_area_ha", E.hectares(F.col("overlap_area_m2")))), "field_id")
    assert got == [("A", "s10", "n10", "10", 5.0), ("B", "s3", "n3", "3", 7.0)]
    fields = spark.createDataFrame([("B", 1), ("A", 2)], "field_id string, extra int")
    hist = spark.createDataFrame([("A", 2023, "Corn"), ("B", 2023, "Soybeans"), ("A", 2022, "Hay")], "field_id string, year int, cdl_name string")
    index = spark.createDataFrame([("A", 0.9, 1.0), ("B", None, 0.2)], "field_id string, mean_ndvi double, coverage_fraction double")
    out = integrate.integrated_dataset(fields, hist, over, index)
    assert out.columns == [*integrate.INTEGRATED, "extra"] and rows(out, "field_id")[1][:2] == ("B", "Soybeans") and rows(out, "field_id")[1][6:10] == (None, 0.2, None, None)
    for bad, text in ((index.limit(1), "ndvi: missing"), (index.unionByName(index), "ndvi: duplicate"), (index.unionByName(spark.createDataFrame([("Z", 1.0, 1.0)], index.schema)), "ndvi: unknown")):
        with pytest.raises(CheckError, match=text):
            integrate.integrated_dataset(fields, hist, over, bad)


def test_figures_and_captions(spark):
    data = [("A", 1.5, "Corn", 10, "55", "N", 0.2, 1.0, 4.0, 6.0, 20.0, 50.0), ("B", 2.5, "Soybeans", 10, "55", "N", 0.6, 0.5, 2.0, 7.0, 10.0, 60.0), ("C", 4.0, "Corn", 5, "107", "W", 0.9, 0.0, 3.0, 6.5, 15.0, 70.0)]
    recs = spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in zip(report.RECORD, "string double string long string string double double double double double double".split())))
    got = {(r.field_id, r.soil_type): r for r in report.key_figures(recs).collect()}
    assert len(got) == 9 and got[None, None].field_count == 3 and got[None, None].dominant_crop_2023 == "Corn" and got[None, "55"].dominant_crop_2023 == "Corn" and got[None, "55"].mean_ndvi == pytest.approx(0.4) and got["B", None].ndvi_coverage_pct == 50.0
    text = report.selection_figures(recs, soil_type="55").first()
    assert text.caption == "2 of 3 fields, 4 ha, mostly Corn. Index 0.4: medium. Organic matter 3 %, pH 6.5."
    assert report.selection_figures(recs, field_id="A").first().caption == "A: 1.5 ha of Corn on 55 — N. Index 0.2: low. Organic matter 4 %, pH 6."
    assert report.selection_figures(recs).first().caption.startswith("All 3 fields, mostly Corn. Index 0.567: medium.")
    none = report.selection_figures(recs, "A", "107").first()
    assert none.field_count == 0 and none.mean_ndvi is None and none.caption == "Nothing selected."
    assert rows(report.index_by(recs, "soil_type").orderBy("fields", ascending=False)) == [("55", 2, pytest.approx(0.4)), ("107", 1, 0.9)]
    over = spark.createDataFrame([("A", "1", "s", "n", 3.0), ("B", "1", "s", "n", 3.0), ("B", "2", "t", "m", 2.0), ("C", "", "", "", 0.0)], "field_id string, mukey string, musym string, muname string, overlap_area_m2 double")
    assert rows(report.largest_mapunits(over, 1)) == [("1", "s", "n", 6.0, 0.75)]
    weather_row, scene = spark.createDataFrame([(1.8, 627.0)], "mean_anomaly_c double, precip_mm double"), spark.createDataFrame([("2023-07-01",)], "scene_date string")
    assert report.package_figures(recs, weather_row, scene).first().scene_date == "2023-07-01"
    with pytest.raises(CheckError, match="non-finite"):
        report.package_figures(recs, weather_row.withColumn("precip_mm", F.lit(None).cast("double")), scene)


# --- space


def test_albers_and_utm():
    r = np.random.default_rng(0)
    lon, lat = r.uniform(-124, -67, 50), r.uniform(25, 49, 50)
    back = geometry.albers_inverse(*geometry.albers_forward(lon, lat))
    assert np.abs(back[0] - lon).max() < 1e-10 and np.abs(back[1] - lat).max() < 1e-10
    assert [float(v[0]) for v in geometry.albers_forward(np.array([-96.0]), np.array([23.0]))] == pytest.approx([0, 0], abs=1e-6)
    east, north = geometry.utm_forward(np.array([-93.0, -93.0]), np.array([0.0, 90.0]), 15)
    assert east.tolist() == pytest.approx([500_000] * 2) and north.tolist() == pytest.approx([0, 0.9996 * 10_001_965.729], rel=1e-9)


def test_measures_and_areas():
    square, hole = box(0, 0, 10, 10), box(2, 2, 4, 4, -1)
    assert geometry.measures([square, hole]) == pytest.approx((84.0, (500 - 64) / 84, (500 - 64) / 84))
    assert geometry.covered_area([square], [[box(5, -5, 20, 10)], [box(5, -5, 20, 8)]]) == pytest.approx(25.0)
    assert geometry.covered_area([square, hole], [[box(0, 0, 10, 10)]]) == pytest.approx(84.0)
    assert geometry.covered_area([square], [[box(10, 0, 5, 5)]]) == 0.0
    triangle = {"sign": 1, "xs": [0, 10, 0], "ys": [0, 0, 10]}
    other = {"sign": 1, "xs": [10, 10, 0], "ys": [0, 10, 0]}
    assert geometry.covered_area([triangle], [[other]]) == pytest.approx(25.0)
    pieces = geometry.covered_pieces([triangle], [[other], [box(1, 1, 3, 3)]])
    assert sum(geometry.measures([p])[0] for p in pieces) == pytest.approx(geometry.covered_area([triangle], [[other], [box(1, 1, 3, 3)]]))
    assert not geometry.is_simple([{"sign": 1, "xs": [0, 1, 0, 1], "ys": [0, 1, 1, 0]}]) and geometry.is_simple([triangle])


def test_overlap(spark):
    fields = polygons(spark, [("F", [box(0, 0, 10, 10)]), ("G", [box(100, 100, 10, 10)])])
    soils = polygons(spark, [("1", [box(0, 0, 5, 10)]), ("2", [box(5, 0, 2, 10)]), ("2", [box(6, 0, 2, 10)]), (" 2", [box(8, 0, 2, 5)]), ("3", [box(10, 0, 5, 5)])], "mukey")
    got = rows(overlay.field_soil_overlap(fields, soils), "field_id", "mukey")
    assert got == [("F", "1", 50.0, 100.0, 0.5), ("F", "2", 40.0, 100.0, 0.4)]
    assert rows(overlay.field_soil_overlap(fields, soils, 1.5), "field_id", "mukey") == got
    clipped = {m: sum(geometry.measures([p])[0] for p in r) for m, _, r in rows(overlay.clipped_soils(fields, soils.withColumn("mukey", F.trim("mukey")), 4.0).select("mukey", "field_id", "rings"))}
    assert clipped == pytest.approx({"1": 50.0, "2": 40.0})
    units = spark.createDataFrame([("1", "s1", "n1"), ("2", "s2", "n2")], "mukey string, musym string, muname string")
    areas = spark.createDataFrame([("F", 100.0), ("G", 100.0)], "field_id string, field_area_m2 double")
    table = spatial.overlap_table(areas, spark.createDataFrame(got, "field_id string, mukey string, overlap_area_m2 double, field_area_m2 double, field_fraction double"), units)
    assert rows(table, "field_id")[-1] == ("G", "", "", "", 0.0, 100.0, 0.0)
    assert [tuple(r) for r in spatial.uncovered(table).orderBy("field_id").collect()] == [("F", pytest.approx(0.9), 2), ("G", 0.0, 1)]
    with pytest.raises(CheckError, match="srid must be 5070"):
        overlay.field_soil_overlap(fields.withColumn("srid", F.lit(None).cast("int")), soils)
    with pytest.raises(CheckError, match="missing required columns: mukey"):
        overlay.field_soil_overlap(fields, soils.withColumnRenamed("mukey", "m"))


def test_grid_selection(spark):
    pts = [(f"P{r}{c}", c + 0.5, 4.5 - r) for r in range(5) for c in range(5)] + [("far", 0.9, 4.9), ("P00-A", 0.5, 4.5)]
    df = spark.createDataFrame(pts, "key string, cx double, cy double")
    got = {r.field_id: r.key for r in spatial.select_on_grid(df, (0.0, 0.0, 5.0, 5.0), 5, "key", "S-").collect()}
    assert len(got) == 25 and got["S-01"] == "P00" and got["S-25"] == "P44" and got["S-06"] == "P10"
    with pytest.raises(CheckError, match="populated grid cells"):
        spatial.select_on_grid(df.limit(1), (0.0, 0.0, 5.0, 5.0), 5, "key", "S-")


def test_eligible_and_region(spark):
    data = [("a", 1, 0, [box(0, 0, 1, 1)]), ("a", 1, 1, [box(5, 5, 1, 1)]), ("b", 0, 2, [box(0, 0, 1, 1)]), ("c", 1, 3, None), ("d", 1, 4, [box(0, 0, 1, 0)]), ("e", 1, 5, [box(9.5, 0, 1, 1)]), ("f", 1, 6, [box(9.02, 0, 1, 1)])]
    df = spark.createDataFrame([(k, a, o, 5070, r) for k, a, o, r in data], f"id string, isAG int, src int, srid int, rings {spatial.RINGS}")
    good = spatial.eligible(df, "isAG", "id", "src")
    assert sorted((r.id, r.xmin) for r in good.collect()) == [("a", 0.0), ("e", 9.5), ("f", 9.02)]
    region = polygons(spark, [("r", [box(0, 0, 10, 10)])])
    assert sorted((r.id, round(r.inside_fraction, 6)) for r in spatial.within_region(good, region).collect()) == [("a", 1.0), ("f", 0.98)]
    moved = spatial.reproject(spatial.reproject(polygons(spark, [("r", [box(-93.5, 42, 0.1, 0.1)])], srid=4326), 5070), 4326).first()
    assert list(moved.rings[0].xs) == pytest.approx([-93.5, -93.4, -93.4, -93.5])
    assert rows(spatial.total_bounds(good))[0] == (0.0, 0.0, 10.5, 1.0)
    with pytest.raises(CheckError, match="unknown srid"):
        spatial.reproject(region.withColumn("srid", F.lit(1)), 4326)


# --- scans


def test_scans(spark):
    secret = "ghp_" + "a" * 24
    df = spark.createDataFrame([(1, f"x {secret}"), (2, "rule ghp_ names only"), (3, 'client_secret: "abcdefgh1"'), (4, "see /home/me/x"), (5, None)], "id int, text string")
    got = rows(scan.credential_findings(df, "id", "text"), "id")
    assert got == [(1, "cred-ghp"), (3, "cred-client")] and secret not in json.dumps(got)
    paths = df.withColumn("path", F.when(F.col("id") == 4, "docs/plan.md"))
    assert rows(scan.home_path_findings(df, "id", "text")) == [(4, "path-home")] and scan.home_path_findings(paths, "id", "text", "path", ["docs/"]).count() == 0
    listing = spark.createDataFrame([("a/.env", 1), ("b/Token.txt", 1), ("c.ZIP", 1), ("ok", scan.LARGEST + 1)], "path string, length long")
    assert rows(scan.name_findings(listing), "path") == [("a/.env", "name-env"), ("b/Token.txt", "name-token"), ("c.ZIP", "name-zip")] and rows(scan.size_findings(listing)) == [("ok", scan.LARGEST + 1)]
    html = """<img alt="x" src='a.png?v=1'><link rel="stylesheet" href="s.css"><link rel="icon" href="i.ico"><script src="//cdn/x.js"></script><a href="d.json#p">j</a><a href="d.json">j</a><body data-dashboard="data/x.json"><a href="#top">t</a><img src="HTTP://h/x">"""
    refs = scan.html_references(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html")
    assert sorted(r[1:] for r in rows(refs)) == [("dashboard", "data/x.json"), ("image", "HTTP://h/x"), ("image", "a.png?v=1"), ("json", "d.json"), ("script", "//cdn/x.js"), ("stylesheet", "s.css")]
    known = spark.createDataFrame([("a.png",), ("d.json",)], "path string")
    assert sorted(r.target for r in scan.unresolved(refs, known).collect()) == ["data/x.json", "s.css"]
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "path string, content binary")
    want = files.select("path", F.sha2("content", 256).alias("sha256")).where("path <> 'c'").withColumn("sha256", F.when(F.col("path") == "b", "0").otherwise(F.upper("sha256"))).unionByName(spark.createDataFrame([("z", "0")], "path string, sha256 string"))
    assert [(r.path, r.status) for r in scan.digest_findings(files, want).orderBy("path").collect()] == [("b", "changed"), ("c", "unlisted"), ("z", "missing")]


def test_overlay_of_many_corners():
    """A ring of thousands of corners: crossings are sought among near edges only, and areas agree with the circle's."""
    t = np.linspace(0, 2 * np.pi, 20_001)[:-1]
    disc = {"sign": 1, "xs": (10 * np.cos(t)).tolist(), "ys": (10 * np.sin(t)).tolist()}
    assert geometry.is_simple([disc])
    assert geometry.covered_area([box(-20, -20, 40, 20)], [[disc]]) == pytest.approx(50 * np.pi, rel=1e-6)
    assert geometry.covered_area([disc], [[box(-20, 0, 40, 20)], [box(0, -20, 20, 40)]]) == pytest.approx(75 * np.pi, rel=1e-5)


def test_convex_and_swept_areas_agree():
    r = np.random.default_rng(2)
    for _ in range(40):
        field = [box(*r.uniform(-2, 2, 2), *r.uniform(1, 4, 2)), {"sign": -1, **{k: v for k, v in box(0.1, 0.1, 0.2, 0.2).items() if k != "sign"}}]
        a = np.sort(r.uniform(0, 2 * np.pi, 5))
        piece = [{"sign": 1, "xs": (2 * np.cos(a)).tolist(), "ys": (2 * np.sin(a)).tolist()}]
        swept = sum((h - l) * (hi - lo) for l, h, lo, hi, _, _ in geometry._covered(geometry.edges([field[0]]), [geometry.edges(piece)], np.concatenate([geometry.edges([field[0]]), geometry.edges(piece)])))
        assert geometry.covered_area([field[0]], [piece]) == pytest.approx(swept, abs=1e-9)


def test_grid_points_by_scan_lines():
    r = np.random.default_rng(3)
    for _ in range(20):
        side = geometry.edges([{"sign": 1, "xs": r.uniform(0, 9, 9).tolist(), "ys": r.uniform(0, 9, 9).tolist()}])
        xs, ys = np.arange(0.5, 9), np.arange(8.5, 0, -1)
        assert (geometry.inside_grid(side, xs, ys) == geometry.contains(side, *np.meshgrid(xs, ys))).all()


def test_one_huge_polygon_meets_small_ones(spark):
    """Levels: a polygon a thousand times larger fills few cells, and meets each small one once."""
    small = [(f"s{i}", [box(10 * (i % 30), 10 * (i // 30), 1, 1)]) for i in range(300)]
    fields, soils = polygons(spark, small), polygons(spark, [("m", [box(-1, -1, 1000, 1000)]), ("n", [box(0, 0, 0.5, 0.5)])], "mukey")
    got = overlay.field_soil_overlap(fields, soils)
    assert got.where("mukey = 'm' and abs(field_fraction - 1) < 1e-9").count() == 300 and rows(got.where("mukey = 'n'").select("field_id", "field_fraction")) == [("s0", pytest.approx(0.25))]
    placed = spatial.with_level(spatial.with_measures(soils), 1.0)
    assert spatial.cells(placed, 1.0, list(range(12))).count() < 60


def star(r, n=7, spread=3.0):
    cx, cy = r.uniform(-spread, spread, 2)
    t = np.sort(r.uniform(0, 2 * np.pi, n))
    return [{"sign": 1, "xs": (cx + r.uniform(0.3, 2, n) * np.cos(t)).tolist(), "ys": (cy + r.uniform(0.3, 2, n) * np.sin(t)).tolist()}]


def ring_area(rings):
    return sum(x["sign"] * geometry.measures([{"sign": 1, "xs": x["xs"], "ys": x["ys"]}])[0] for x in rings)


def seamless(rings, size):
    """Whether no edge lies on a line of the grid."""
    for x in rings:
        for a, b, c, d in zip(x["xs"], x["ys"], [*x["xs"][1:], x["xs"][0]], [*x["ys"][1:], x["ys"][0]]):
            if (a == c and abs(a / size - round(a / size)) < 1e-12 and b != d) or (b == d and abs(b / size - round(b / size)) < 1e-12 and a != c):
                return False
    return True


def test_outlines_of_regions_cut_into_cells():
    """Areas by one sweep, by cells, and of stitched outlines agree, and neither cells nor neighbours leave seams."""
    r = np.random.default_rng(5)
    for _ in range(60):
        size = float(r.choice([0.5, 1.0, 0.7]))
        sides = [[star(r) if r.random() < 0.6 else [box(*r.integers(-3, 3, 2).astype(float), *r.integers(1, 4, 2).astype(float))] for _ in range(r.integers(1, 5))] for _ in range(2)]
        want = outlines.overlap_area(sides)
        assert ring_area(outlines.stitched(outlines.region_edges(sides))) == pytest.approx(want, abs=1e-8)
        cells = {}
        for side, polygons_ in enumerate(sides):
            for p in polygons_:
                pieces = list(outlines.split(p, size))
                assert sum(outlines.overlap_area([[g], [g]]) for _, _, g in pieces) == pytest.approx(outlines.overlap_area([[p], [p]]), abs=1e-8)
                for x, y, g in pieces:
                    cells.setdefault((x, y), ([], []))[side].append(g)
        assert sum(outlines.overlap_area(c) for c in cells.values()) == pytest.approx(want, abs=1e-8)
    bent = [{"sign": 1, "xs": [0.1, 5.3, 4.9, 0.2], "ys": [0.2, 0.1, 4.8, 5.2]}, {"sign": -1, "xs": [1.2, 3.4, 2.5], "ys": [1.1, 1.3, 3.7]}]
    assert [x["sign"] for x in sorted(outlines.stitched(outlines.region_edges([[bent], [bent]])), key=lambda x: -x["sign"])] == [1, -1]


def test_dissolved_soils(spark):
    """One row a map unit: fields next to each other and pieces of one key leave no seams, holes stay, areas are those of
    one sweep over everything."""
    fields = polygons(spark, [("F", [box(0.3, 0.3, 4, 4)]), ("G", [box(4.3, 0.3, 4, 4)]), ("H", [box(20, 20, 3, 3)])])
    soils = polygons(spark, [("1", [box(-1, -1, 6, 9)]), ("1", [box(4, -1, 9, 9), box(5.5, 1.5, 1, 1, -1)]), ("2", [box(2, 2, 1, 1)]), (" 2", [box(21, 21, 0.5, 0.5)]), ("3", [box(50, 50, 1, 1)])], "mukey")
    for size in (None, 1.0, 0.7):
        overlaps, units = overlay.dissolved_soils(fields, soils, size)
        got = {r.mukey: [x.asDict() for x in r.rings] for r in units.collect()}
        assert got.keys() == {"1", "2"} and ring_area(got["1"]) == pytest.approx(31.0) and ring_area(got["2"]) == pytest.approx(1.25)
        assert [(x["sign"], len(x["xs"])) for x in sorted(got["1"], key=lambda x: -x["sign"])] == [(1, 4), (-1, 4)]
        assert sorted(len(x["xs"]) for x in got["2"]) == [4, 4]
        near = lambda df: rows(df.select("field_id", "mukey", F.round("overlap_area_m2", 9), F.round("field_fraction", 9)), "field_id", "mukey")
        assert near(overlaps) == near(overlay.field_soil_overlap(fields, soils))
    r = np.random.default_rng(8)
    many = polygons(spark, [(f"f{i}", star(r)) for i in range(12)])
    units = polygons(spark, [(str(i % 3), star(r)) for i in range(15)], "mukey")
    as_dicts = lambda df, key: {k: [[x.asDict() for x in r.rings] for r in g] for k, g in ((k, [r for r in df.collect() if r[key] == k]) for k in {r[key] for r in df.collect()})}
    whole, by = [p for ps in as_dicts(many, "field_id").values() for p in ps], as_dicts(units, "mukey")
    got = {r.mukey: [x.asDict() for x in r.rings] for r in overlay.dissolved_soils(many, units, 0.9)[1].collect()}
    for mukey, soils_ in by.items():
        assert ring_area(got[mukey]) == pytest.approx(outlines.overlap_area([whole, soils_]), abs=1e-7) and seamless(got[mukey], 0.9)
    empty = overlay.dissolved_soils(many.limit(0), units)
    assert empty[0].count() == empty[1].count() == 0


def test_crowded_places_are_cut_into_many_cells(spark, monkeypatch):
    """90 % of the polygons in one cell of the first grid: cells end up with few corners, and no pair is lost."""
    r = np.random.default_rng(3)
    at = np.concatenate([r.uniform(0, 1, (270, 2)), r.uniform(0, 100, (30, 2))])
    fields = polygons(spark, [(f"f{i}", [box(x, y, 0.05, 0.04)]) for i, (x, y) in enumerate(at[::2])])
    soils = polygons(spark, [(f"s{i}", [box(x, y, 0.05, 0.04)]) for i, (x, y) in enumerate(at[1::2])], "mukey")
    want = rows(overlay.field_soil_overlap(fields, soils).select("field_id", "mukey", F.round("overlap_area_m2", 10)), "field_id", "mukey")
    assert len(want) > 20
    monkeypatch.setattr(overlay, "CORNERS", 60)
    cells, _ = overlay._sides(fields, soils, 8.0)
    sizes = [x["n"] for x in cells.groupBy(*overlay.CELL).agg(F.sum("corners").alias("n")).collect()]
    assert max(sizes) <= 60 and len(sizes) > 30
    assert rows(overlay.field_soil_overlap(fields, soils, 8.0).select("field_id", "mukey", F.round("overlap_area_m2", 10)), "field_id", "mukey") == want


def ring(points, sign=1):
    return {"sign": sign, "xs": [float(p[0]) for p in points], "ys": [float(p[1]) for p in points]}


@pytest.mark.parametrize("rings, said", [
    ([box(0, 0, 4, 4), box(1, 1, 1, 1, -1)], None), ([ring([(0, 0), (1, 1), (0, 2), (1, 0)])], "edges cross"), ([box(0, 0, 4, 4), box(5, 5, 1, 1, -1)], "ring in the wrong place"),
    ([box(0, 0, 4, 4), box(3, 3, 2, 2, -1)], "edges cross"), ([box(0, 0, 4, 4), box(1, 1, 1, 1)], "ring in the wrong place"), ([box(0, 0, 9, 9), box(1, 1, 7, 7, -1), box(3, 3, 1, 1)], None),
    ([box(0, 0, 9, 9), box(1, 1, 7, 7, -1), box(3, 3, 1, 1, -1)], "ring in the wrong place"), ([box(0, 0, 1, 1), box(1, 1, 1, 1)], None), ([box(0, 0, 1, 1), box(1, 0, 1, 1)], "edges overlap"), ([box(0, 0, 4, 4, -1)], "ring in the wrong place"),
    ([box(0, 0, 4, 4), ring([(0, 2), (1, 1), (1, 3)], -1)], None), ([box(0, 0, 4, 4), ring([(0, 2), (2, 1), (4, 2), (2, 3)], -1)], "inside in several parts"), ([box(0, 0, 2, 2), ring([(1, 1), (2, 2), (3, 3), (3, 1)])], "edges cross"),
    ([ring([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1)])], "ring touches itself"), ([ring([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)])], "ring touches itself"), ([ring([(0, 0), (1, 1)])], "fewer than three corners"),
    ([ring([(0, 0), (1, math.nan), (2, 2)])], "non-finite coordinates"), ([ring([(0, 0), (1, 1), (2, 2)])], "no area"), ([], "no area"), (None, "no area"), ([ring([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 0)])], None),
    ([box(0, 0, 9, 9), box(2, 2, 2, 2, -1), box(4, 4, 2, 2, -1), box(6, 2, 2, 2, -1), ring([(4, 2), (6, 2), (5, 1)], -1)], "inside in several parts"), ([box(0, 0, 9, 9), box(1, 1, 2, 2, -1), box(3, 3, 2, 2, -1)], None),
    ([box(0, 0, 4, 4), ring([(4, 4), (6, 4), (6, 6), (4, 6)])], None), ([box(0, 0, 4, 4), ring([(2, 2), (4, 4), (2, 3)], -1)], None), ([box(0, 0, 4, 4), ring([(3, 3), (4, 4), (5, 3)])], "edges cross"),
])
def test_faults_of_polygons(rings, said):
    assert validity.fault(rings) == said
    if rings and len(rings) == 1:  # turned and mirrored alike
        for turn in (lambda x, y: (y, x), lambda x, y: (-x, y), lambda x, y: (x + 0.1 * y, y - 0.1 * x)):
            got = validity.fault([ring(list(zip(*[[turn(a, b)[k] for a, b in zip(r["xs"], r["ys"])] for k in (0, 1)])), r["sign"]) for r in rings])
            assert (got is None) == (said is None)


def test_sweep_finds_the_crossings_that_all_pairs_have():
    r = np.random.default_rng(1)
    for _ in range(1500):
        one = [ring(r.uniform(0, 1, (r.integers(3, 10), 2)))]
        x, y = geometry._ring(one[0])
        crosses = len(geometry._crossing_heights(np.stack([x[:-1], y[:-1], x[1:], y[1:]], 1))) > 0
        assert (validity.fault(one) == "edges cross") == crosses


def test_faults_of_a_polygon_with_very_many_corners():
    t = np.linspace(0, 2 * np.pi, 100_001)[:-1]
    wave = 10 * (1 + 0.1 * np.cos(50 * t))
    began = time.process_time()
    assert validity.fault([ring(np.stack([wave * np.cos(t), wave * np.sin(t)], 1))]) is None
    assert validity.fault([ring([(0, -5), *[(k, 1000 if k % 2 else 0) for k in range(30_001)], (30_001, -5)])]) is None  # tall edges
    assert time.process_time() - began < 20


def test_grid_zones_both_ways(spark):
    r = np.random.default_rng(4)
    lon, lat = r.uniform(-97, -89, 3000), r.uniform(0, 84, 3000)
    back = geometry.utm_inverse(*geometry.utm_forward(lon, lat, 15), 15)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9  # a tenth of a millimetre
    df = polygons(spark, [("z", [box(450_000, 4_600_000, 200_000, 200_000)])], srid=32615).unionByName(polygons(spark, [("a", [box(-93.5, 42, 0.1, 0.1)])], srid=4326)).unionByName(polygons(spark, [("n", None)], srid=5070))
    plain = {x.field_id: x for x in spatial.reproject(df, 5070).collect()}
    fine = {x.field_id: x for x in spatial.reproject(df, 5070, within=0.01).collect()}
    assert plain["n"].rings is None and len(plain["z"].rings[0].xs) == 4 and len(fine["z"].rings[0].xs) > 50
    again = {x.field_id: x for x in spatial.reproject(spark.createDataFrame(list(fine.values()), df.schema), 32615).collect()}
    side = np.array(again["z"].rings[0].xs), np.array(again["z"].rings[0].ys)
    edge = np.minimum.reduce([np.abs(side[0] - 450_000), np.abs(side[0] - 650_000), np.abs(side[1] - 4_600_000), np.abs(side[1] - 4_800_000)])
    assert edge.max() < 1e-3  # all corners lie on the square's sides
    straight = geometry.measures([plain["z"].rings[0].asDict()])[0], geometry.measures([fine["z"].rings[0].asDict()])[0]
    assert abs(straight[0] - straight[1]) > 100


def test_references_of_malformed_pages(spark):
    """Tags, comments, raw text and attribute values as a parser finds them, whatever their quotes and case."""
    pages = {
        "a": '<IMG SRC=x.png><img src="a>b.png" alt=\'"\'><img/src=c.png/><img src>', "b": '<!-- <img src="no.png"> --><script>"<img src=no.png>"</script><script SRC="s.js"></script><style><img src=no.png></style>',
        "c": '<link rel="preload StyleSheet" href="&#x61;&amp;b.css"><link rel=icon href=no.css><link rel="stylesheet">', "d": "<a href='x.json'>y</a><a href=\"n&#111;.json\" href='y.json'><a href=no.html>", "e": '<div data-dashboard="d.json"><p data-dashboard></div>',
        "f": '<img src="open.png', "g": "<img src=one.png src=two.png <b>", "h": "<!DOCTYPE x [<img src=no.png>]><?php <img src=no.png> ?>< img src=no.png><img\nsrc\n=\n'line.png'>", "i": None, "j": "", "k": "<textarea><img src=t.png></textarea><title><img src=no.png>" ,
    }
    got = {}
    for r in scan.html_references(spark.createDataFrame(list(pages.items()), "k string, html string"), "k", "html").collect():
        got.setdefault(r.k, []).append((r.kind, r.value))
    assert got["a"] == [("image", "x.png"), ("image", "a>b.png"), ("image", "c.png/")] and got["b"] == [("script", "s.js")]
    assert got["c"] == [("stylesheet", "a&b.css")] and got["d"] == [("json", "x.json"), ("json", "y.json")] and got["e"] == [("dashboard", "d.json")]
    assert got["h"][-1] == ("image", "line.png") and not {"f", "i", "j"} & got.keys()
    assert all("no." not in v for found in got.values() for _, v in found if found is not got["h"] and found is not got.get("k"))


@pytest.mark.parametrize("piece", ["<", "<a ", "<!--", "<a href='", "<img src=x", "&#", "<script>", "</", "<!"])
def test_time_of_references_grows_with_length_alone(piece):
    def took(n):
        parser = scan._References()
        began = time.process_time()
        parser.feed(piece * (n // len(piece)))
        return time.process_time() - began

    took(1000)
    assert took(160_000) < 8 * max(took(40_000), 0.05)


def test_natural_order(spark):
    codes = ["a10b2", "a9b10", "a9b9", "a10b1", "B2", "b10", "b2", "é1", "e2", "f1", "10", "9", "0010", "7" * 30, "8" * 29, "Zürich 2", "zurich 10", "", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string").repartition(5)
    got = [r.c for r in df.orderBy(*E.numeric_order(F.col("c"))).collect()]
    assert got == ["", "9", "0010", "10", "8" * 29, "7" * 30, "a9b9", "a9b10", "a10b1", "a10b2", "b2", "B2", "b10", "é1", "e2", "f1", "Zürich 2", "zurich 10", None]


def test_gates_in_one_job(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, -1.0)], "k string, j int, v double")
    assert checks.require_all(df, "t", {"v above -2": F.col("v") > -2}, ["k", "j"], ("k", "v", 1.2)) is df
    for args, said in (
        (({"v positive": F.col("v") > 0}, ["k", "j"]), "v positive"), (({}, ["k"]), "duplicate k"), (({}, ["k", "j"], ("k", "v", 1.0)), "v of a exceed 1"),
        (({}, ["k", "j"], None, df.where("k = 'a'"), "k"), "unknown k b"), (({"v positive": F.col("v") > 0}, ["k"]), "duplicate k; v positive"),
    ):
        with pytest.raises(CheckError, match=said):
            checks.require_all(df, "t", *args)
    checks.require_all(df.limit(0), "t", {"v positive": F.col("v") > 0}, ["k"], ("k", "v", 1.0))


def test_gates_of_several_tables_in_one_job(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None, "", 1.0, "q"), (1, "", "", 1.0, "q"), (1, None, "", 1.0, "q"), (7, "z", "", 2.0, "q")], "k int, v string, w string, x double, y string")
    checks.require_together(checks.gate(a, "a", unique=["k", "v"]), checks.gate(b.dropDuplicates(), "b", unique=b.columns))
    with pytest.raises(CheckError) as e:
        checks.require_together(checks.gate(a, "a", {"v is x": F.col("v") == "x"}, ["k"]), checks.gate(b, "b", unique=b.columns, parent=a, key="k"), checks.one_to_one_gate({"one": a.limit(1), "two": b.where("k = 7")}, "k"))
    assert str(e.value) == "two: missing k; two: unknown k; a: duplicate k; v is x; b: duplicate k/v/w/x/y; unknown k 7"


def test_rules_are_counted_by_the_write(spark):
    df = spark.range(10).withColumn("v", F.when(F.col("id") > 0, F.col("id")))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("gated"))
    spark.sparkContext.setJobGroup("gated", "")
    before = jobs()
    got = checks.landed_by_rules(df, {"v below 99": F.col("v") < 99}, "numbers")
    assert jobs() - before == 1 and rows(got, "id") == rows(df, "id")
    spark.sparkContext.setJobGroup("other", "")
    with pytest.raises(CheckError, match="numbers: v below 5"):
        checks.landed_by_rules(df, {"v below 99": F.col("v") < 99, "v below 5": F.col("v") < 5}, "numbers")
    assert checks.landed_by_rules(df.limit(0), {"v below 5": F.col("v") < 5}, "none").count() == 0


def test_integration_joins_buckets_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ids = spark.range(50).select(F.col("id").cast("string").alias("field_id"))
    out = integrate.integrate_fields(ids.withColumn("geometry", F.lit("g")), ids.withColumn("crop_2023_name", F.lit("Corn")), ids.withColumn("dominant_soil", F.lit("s")), ids.withColumn("mean_ndvi", F.lit(0.5)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Scan parquet") == 4
    assert out.count() == 50 and out.columns[-1] == "geometry"


def test_grids_that_disagree_are_refused(spark):
    fine = spark.createDataFrame([("g", 0.5, -0.5)], "g string, x double, y double")
    coarse = spark.createDataFrame([("g", 0, 0, 0.0, 0.0, 2.0, 7), ("g", 0, 1, 0.0, 1.0, 2.0, 8)], "g string, row long, col long, x0 double, y0 double, pixel_size double, code int")
    with pytest.raises(Exception, match="differ in origin"):
        zonal.nearest_resample(fine, coarse, ["g"], "code").collect()
    assert zonal.nearest_resample(fine, coarse.limit(1), ["g"], "code").first()["code"] == 7


def test_unions_of_many_convex_polygons_agree_with_one_sweep():
    r = np.random.default_rng(11)
    fields, pieces, group = [], [], []
    for g in range(40):
        field = [box(*r.uniform(0, 1, 2), 1, 1)]
        for _ in range(r.integers(1, 7)):
            t = np.sort(r.uniform(0, 2 * np.pi, r.integers(3, 7)))
            x, y = r.uniform(0, 2, 2)
            piece = [{"sign": 1, "xs": (x + 0.7 * np.cos(t)).tolist(), "ys": (y + 0.7 * np.sin(t)).tolist()}]
            fields.append(field), pieces.append(piece), group.append(g)
    (p, n), (q, _) = (convex.rows([geometry.convex(x) for x in side]) for side in (fields, pieces))
    p, n = convex.clipped(p, n, q)
    got = convex.union_areas(p, n, q, np.array(group))
    for g in range(40):
        own = [k for k in range(len(group)) if group[k] == g]
        assert got[g] == pytest.approx(outlines.overlap_area([[fields[own[0]]], [pieces[k] for k in own]]), abs=1e-12)


def test_stacked_polygons_stay_in_few_cells_and_are_dealt_to_blocks(spark, monkeypatch):
    """Polygons that lie on each other: cutting again would only multiply them; blocks lose no pair."""
    r = np.random.default_rng(4)
    at = r.uniform(0, 0.02, (120, 2))
    fields = polygons(spark, [(f"f{i}", [box(x, y, 0.05, 0.04)]) for i, (x, y) in enumerate(at[::2])])
    soils = polygons(spark, [(f"s{i // 3}", [box(x, y, 0.05, 0.04)]) for i, (x, y) in enumerate(at[1::2])], "mukey")
    parts: dict = {}
    for i, (x, y) in enumerate(at[1::2]):
        parts.setdefault(f"s{i // 3}", []).append([box(x, y, 0.05, 0.04)])
    want = {(f"f{i}", m): outlines.overlap_area([[[box(x, y, 0.05, 0.04)]], own]) for i, (x, y) in enumerate(at[::2]) for m, own in parts.items()}
    monkeypatch.setattr(overlay, "CORNERS", 40)
    monkeypatch.setattr(overlay, "BLOCK", 16)
    assert overlay._sides(fields, soils, 0.1)[0].count() < 4 * 120
    got = {(a.field_id, a.mukey): a.overlap_area_m2 for a in overlay.field_soil_overlap(fields, soils, 0.1).collect()}
    assert got == pytest.approx(want, abs=1e-15) and len(got) == 60 * 20
    clipped = overlay.clipped_soils(fields, soils, 0.1).collect()
    assert {(c.field_id, c.mukey): ring_area([x.asDict() for x in c.rings]) for c in clipped} == pytest.approx(want, abs=1e-9)


def test_dissolved_soils_work_out_no_overlaps_that_the_gate_does_not_need(spark, monkeypatch):
    fields = polygons(spark, [("F", [box(0, 0, 4, 4)]), ("G", [box(2, 2, 4, 4)])])
    soils = polygons(spark, [("1", [box(1, 1, 4, 4)]), (" 2", [box(3, 3, 9, 9)])], "mukey")
    monkeypatch.setattr(overlay, "field_soil_overlap", None)
    got = {u.mukey: ring_area([x.asDict() for x in u.rings]) for u in overlay.dissolved(fields, soils).collect()}
    assert got == pytest.approx({"1": 14.0, "2": 9.0})


def test_lines_by_brand_are_counted_once_for_field_records(spark, monkeypatch):
    from fieldspark.plans import queries

    counted, given, count, only = [], [], queries.brand_counts, queries.report.field_records
    monkeypatch.setattr(queries, "brand_counts", lambda *a: (counted.append(a), count(*a))[1])
    monkeypatch.setattr(queries.report, "field_records", lambda *a: (given.append(a[3].columns), only(*a))[1])
    assert queries.join6_field_records(spark, "/root/testdata/sf0.001").count() > 0
    assert len(counted) == 1 and "median_ndvi" not in given[0]


def test_digests_of_repeated_rows_tell_nulls_apart(spark):
    rows = [(None, 5, 1.0, "a"), (5, None, 1.0, "a"), (None, None, 1.0, ""), (None, None, 1.0, None)]
    df = spark.createDataFrame(rows, "a int, b int, c double, d string")
    checks.require_all(df, "rows", unique=df.columns)
    assert not any("json" in str(c) for c in checks._digest(df.columns).values())
    with pytest.raises(checks.CheckError, match="duplicate"):
        checks.require_all(df.union(df.limit(1)), "rows", unique=df.columns)


def test_outlines_of_upright_boxes_are_those_of_the_sweep():
    import random

    box = lambda x0, y0, x1, y1: [{"sign": 1, "xs": [x0, x1, x1, x0], "ys": [y0, y0, y1, y1]}]
    corners = lambda rings: {p for r in rings for p in zip(r["xs"], r["ys"])}
    r = random.Random(7)
    for _ in range(300):
        boxes = [(x, y, x + r.randint(1, 4), y + r.randint(1, 4)) for x, y in ((r.randint(0, 6), r.randint(0, 6)) for _ in range(r.randint(1, 7)))]
        boxes = [tuple(map(float, b)) for b in boxes]
        got = outlines.stitched(outlines.box_edges(boxes))
        want = outlines.stitched(outlines.region_edges([[box(*b) for b in boxes]]))
        whole = outlines.overlap_area([[box(*b) for b in boxes]])
        assert corners(got) <= corners(want)  # the sweep may keep one on a straight line where rings touch
        assert math.isclose(outlines.overlap_area([[got]]), whole) and math.isclose(outlines.overlap_area([[got], [box(*b) for b in boxes]]), whole)
    p, n = convex.rows([([0, 1, 1, 0], [0, 0, 1, 1]), ([0, 1, 1.5, 0], [0, 0, 1, 1]), ([0, 1, 1], [0, 0, 1]), None])
    assert convex.upright(p, n).tolist() == [True, False, False, False]


def test_areas_of_rings_by_expressions(spark):
    rings = [{"sign": 1, "xs": [5.0, 9.0, 9.0, 5.0], "ys": [1.0, 1.0, 4.0, 4.0]}, {"sign": -1, "xs": [6.0, 6.0, 8.0], "ys": [2.0, 3.0, 2.0]}]
    df = spark.createDataFrame([(1, rings), (2, []), (3, None), (4, [{"sign": 1, "xs": [1.0, 2.0], "ys": [1.0, 2.0]}])], f"k int, rings {spatial.RINGS}")
    assert [r[0] for r in df.orderBy("k").select(E.rings_area(F.col("rings"))).collect()] == [11.0, 0.0, None, 0.0]


def test_horizons_are_one_pass_to_metrics_by_component(spark, monkeypatch):
    kept, land = [], checks.landed
    for module in (checks, soil):
        monkeypatch.setattr(module, "landed", lambda df, label: (kept.append(df.columns), land(df, label))[1], raising=False)
    top, below = (7, 0.0, 10.0, 1.0, 6.0, 1.0, 1.0, 0.1), (7, 10.0, 30.0, 4.0, 6.0, 1.0, 1.0, 0.1)

    def of(horizons, once=True):
        parts = [(("1", 7, 50.0, "A"), ("1", 8, 50.0, "B"))], [horizons], [[("F", "1", 1.0)]]
        types = CO.replace("cokey string", "cokey long"), HZ.replace("cokey string", "cokey long"), OV
        return tuple(soil.aggregate_soil(*[spark.createDataFrame(list(p[0]), t) for p, t in zip(parts, types)], once=once).first())

    assert of([top, below, top]) == of([top, below], False) == pytest.approx(("F", 3.0, 6.0, 1.0, 0.1, 70 / 1.724 + 20 / 1.724, 1.0, *[0.5] * 5))
    assert of([]) == ("F", *[None] * 5, *[0.0] * 6)
    for horizons, once, said in (([top, top], False, "duplicate cokey/hzdept_r"), ([top, (None, *top[1:])], True, "empty cokey"), ([(9, *top[1:])], True, "unknown cokey 9"), ([top, (7, 0.0, 5.0, -1.0, *top[4:]), top], True, "horizons: organic matter")):
        with pytest.raises(CheckError, match=said):
            of(horizons, once)
    assert kept and not any("hzdept_r" in columns for columns in kept)


def test_index_of_suppliers_groups_numbers(spark, monkeypatch):
    from fieldspark.plans import queries

    given, only = [], queries.imagery.field_ndvi
    monkeypatch.setattr(queries.imagery, "field_ndvi", lambda *a: (given.extend(dict(df.dtypes) for df in a), only(*a))[1])
    assert dict(queries.supplier_index(spark, "/root/testdata/sf0.001").dtypes)["field_id"] == "string"
    assert [t["scene_id"] for t in given] == ["bigint"] * 2 and given[0]["field_id"] == "bigint"


def test_package_figures_are_worked_out_once(spark):
    one = spark.createDataFrame([("F", 1.0, "corn", 5, "s", "soil", 0.5, 1.0, 2.0, 6.0, 10.0, 50.0)], "field_id string, area_ha double, crop_2023 string, crop_2023_pixels long, soil_type string, soil_name string, mean_ndvi double, ndvi_coverage_fraction double, organic_matter_pct double, ph_h2o double, cec_cmol_kg double, carbon_storage_mg_c_ha double")
    got = report.package_figures(one, spark.createDataFrame([(1.0, 2.0)], "mean_anomaly_c double, precip_mm double"), spark.createDataFrame([("2023-07-01",)], "scene_date string"))
    assert got.inputFiles() and got.first().total_area_ha == 1.0


def made_boxes(r, groups, most, whole=False):
    many = r.integers(1, most, groups)
    n = many.sum()
    low = r.integers(0, 6, (2, n)).astype(float) if whole else r.uniform(0, 1, (2, n))
    high = low + (r.integers(1, 5, (2, n)) if whole else r.uniform(0.01, 1, (2, n)))
    return (*low, *high), np.cumsum(many) - many, many


@pytest.mark.parametrize("most, whole", [(10, False), (10, True), (boxes.MOST + 1, True)])
def test_outlines_and_areas_of_groups_of_boxes(most, whole):
    """All groups at once have the outlines and areas that the sweep gives each by itself."""
    b, start, many = made_boxes(np.random.default_rng(9), 150, most, whole)
    area, got = boxes.union_areas(b, start), {}
    for g, x in boxes.outlines(b, start):
        for k, own in enumerate(x.group):
            s = slice(x.first[k], x.first[k + 1])
            got.setdefault(int(g[own]), []).append({"sign": int(x.sign[k]), "xs": x.xs[s].tolist(), "ys": x.ys[s].tolist()})
            assert x.area[k] == pytest.approx(ring_area([got[g[own]][-1] | {"sign": 1}]))
    corners = lambda rings: {p for x in rings for p in zip(x["xs"], x["ys"])}
    for g, (at, n) in enumerate(zip(start, many)):
        own = [tuple(float(c[k]) for c in b) for k in range(at, at + n)]
        sides = [[[box(x0, y0, x1 - x0, y1 - y0)] for x0, y0, x1, y1 in own]]
        assert corners(got[g]) == corners(outlines.stitched(outlines.box_edges(own)))
        assert area[g] == pytest.approx(outlines.overlap_area(sides)) and ring_area(got[g]) == pytest.approx(area[g])
        assert outlines.overlap_area([*sides, [got[g]]]) == pytest.approx(area[g])
    thin = (np.array([0.0, 1.0, 5.0]), np.zeros(3), np.array([1.0, 1 + 1e-13, 5 + 1e-13]), np.ones(3))
    assert [(g.tolist(), len(x.xs)) for g, x in boxes.outlines(thin, np.array([0, 2]))] == [([0], 4)]


def test_blocks_of_upright_boxes_are_not_swept(spark, monkeypatch):
    """Outlines of map units of many overlapping boxes come from arrays; with ``most`` of them, or others among them, as before."""
    r = np.random.default_rng(11)
    at = r.uniform(0, 0.02, (80, 2)).round(4)
    fields = polygons(spark, [(f"f{i}", [box(x, y, 0.05, 0.04)]) for i, (x, y) in enumerate(at[:20])])
    soils = polygons(spark, [(f"s{i // 20}", [box(x, y, 0.05, 0.04)]) for i, (x, y) in enumerate(at[20:])], "mukey")
    left, right = (overlay._plain(df.withColumn("box", F.array(*overlay._BOUNDS))).select("key", "area", "rings", "box").toArrow() for df in overlay._measured(fields, soils))
    assert left["rings"].null_count == 20 and right["rings"].null_count == 60
    want = {(f"f{i}", f"s{m}"): outlines.overlap_area([[[box(x, y, 0.05, 0.04)]], [[box(*p, 0.05, 0.04)] for p in at[20 + 20 * m : 40 + 20 * m]]]) for i, (x, y) in enumerate(at[:20]) for m in range(3)}
    for name in ("region_edges", "stitched", "rings_of"):
        monkeypatch.setattr(outlines, name, None)
    monkeypatch.setattr(geometry, "convex", None)
    got = overlay._block_outlines(left, right).to_pylist()
    assert {(g["field_id"], g["mukey"]): ring_area(g["rings"]) for g in got} == pytest.approx(want, abs=1e-12)
    assert {(g["field_id"], g["mukey"]): g["area"] for g in got} == pytest.approx(want, abs=1e-12) and len(got) == 60
    monkeypatch.undo()
    more = polygons(spark, [("s0", [{"sign": 1, "xs": [0.0, 0.1, 0.0], "ys": [0.0, 0.0, 0.1]}]), *[("s1", [box(x / 4, y / 4, 0.05, 0.04)]) for x, y in r.uniform(0, 0.2, (boxes.MOST + 6, 2))]], "mukey")
    clipped = {(c.field_id, c.mukey): (c.area, ring_area([x.asDict() for x in c.rings])) for c in overlay.clipped_soils(fields, soils.unionByName(more), 0.2).collect()}
    areas = {(a.field_id, a.mukey): a.overlap_area_m2 for a in overlay.field_soil_overlap(fields, soils.unionByName(more), 0.2).collect()}
    assert {k: a for k, (a, _) in clipped.items()} == pytest.approx(areas, abs=1e-9) and {k: a for k, (_, a) in clipped.items()} == pytest.approx(areas, abs=1e-9)
    assert len(areas) == 60 and all(areas[f"f{i}", "s2"] == pytest.approx(want[f"f{i}", "s2"], abs=1e-12) for i in range(20))


def test_rounding_is_that_of_decimals(spark):
    r = np.random.default_rng(12)
    near = [s * (k + 0.5 + d) / 1e8 for k in (0, 3, 12_345, 199_999) for d in (0, 1e-9, -1e-9, 1e-4, -1e-4, 0.2) for s in (1, -1)]
    values = [*near, *r.uniform(-1, 1, 2000).tolist(), *r.uniform(0, 1e12, 50).tolist(), *(r.integers(0, 10**9, 500) / 1e9).tolist(), 0.0, -1e-12, math.nan, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (6, 8):
        assert df.where(~F.round("v", k).eqNullSafe(E.round_half_up(F.col("v"), k))).count() == 0
