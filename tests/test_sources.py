"""Readers and writers on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geometry
from fieldspark.operators import crops
from fieldspark.operators.checks import CheckError
from fieldspark.operators import places
from fieldspark.sources import readers, writers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(p)


def feature(i, area=1.0, kind="Polygon", coords=None):
    return {"type": "Feature", "properties": {"field_id": i, "area_ha": area}, "geometry": {"type": kind, "coordinates": coords or [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}}


def test_geojson(spark, tmp_path):
    multi = [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]
    path = put(tmp_path, "a.json", {"type": "FeatureCollection", "features": [feature("A"), feature("B", 2.0, "MultiPolygon", multi)]})
    got = {r.field_id: r for r in readers.read_geojson(spark, path, "field_id string, area_ha double", "field_id", "area_ha").collect()}
    assert got["A"].srid == 4326 and geometry.measures(got["A"].rings)[0] == 15.0 and geometry.measures(got["B"].rings)[0] == 1.0
    for doc, text in (({"type": "Feature"}, "no feature collection"), ({"type": "FeatureCollection", "features": []}, "no feature collection"), ({"type": "FeatureCollection", "features": [feature(None)]}, "missing field_id"), ({"type": "FeatureCollection", "features": [feature("A"), feature("A")]}, "duplicate field_id"), ({"type": "FeatureCollection", "features": [feature("A", None)]}, "non-finite area_ha")):
        with pytest.raises(CheckError, match=text):
            readers.read_geojson(spark, put(tmp_path, "b.json", doc), "field_id string, area_ha double", "field_id", "area_ha")
    df = readers.read_geojson(spark, path, "field_id string, area_ha double")
    writers.write_feature_collections(df, str(tmp_path / "out"), "field_id")
    again = readers.read_geojson(spark, str(tmp_path / "out"), "field_id string, area_ha double", "field_id")
    assert {r.field_id: geometry.measures(r.rings)[0] for r in again.collect()} == {"A": 15.0, "B": 1.0}
    writers.write_geojson(df.where("field_id = 'B'"), str(tmp_path / "seq"), ["field_id"])
    one = json.loads(spark.read.text(str(tmp_path / "seq")).first().value)
    assert one["properties"] == {"field_id": "B", "area_ha": 2.0} and one["geometry"]["type"] == "MultiPolygon"


DICT = '"comp"|"1"|"mukey"|x\n"comp"|"2"|"name"|x\n"comp"|"3"|"pct"|x\n"other"|"1"|"k"|x\n'


def test_dictionary_tables(spark, tmp_path):
    d = readers.read_dictionary(spark, put(tmp_path, "d.txt", DICT), width=4)
    rows = put(tmp_path, "c.txt", ' 10 |"a ""b"" | c"|\n9||2.5\n')
    got = [tuple(r) for r in readers.read_dictionary_table(spark, rows, d, "comp", ["mukey", "name", "pct"]).collect()]
    assert got == [("10", 'a "b" | c', None), ("9", None, "2.5")]
    assert [tuple(r) for r in readers.read_dictionary_table(spark, rows, d, "comp", ["pct"]).collect()] == [(None,), ("2.5",)]
    for text, body, name, columns in ((DICT.replace('"3"', '"4"'), "1|2|3\n", "comp", ["mukey"]), (DICT, "1|2|3\n", "nope", ["mukey"]), (DICT, "1|2|3\n", "comp", ["zzz"]), (DICT, "1|2\n", "comp", ["mukey"]), (DICT, "", "comp", ["mukey"]), (DICT.replace('"2"', '"x"'), "1|2|3\n", "comp", ["mukey"]), (DICT + '"comp"|"3"|"q"|x\n', "1|2|3\n", "comp", ["mukey"])):
        d2 = readers.read_dictionary(spark, put(tmp_path, "d2.txt", text), width=4)
        with pytest.raises(CheckError):
            readers.read_dictionary_table(spark, put(tmp_path, "c2.txt", body), d2, name, columns)
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == "true"


def daily(t, p=None):
    return json.dumps({"properties": {"parameter": {"T2M": t, "PRECTOTCORR": dict.fromkeys(t, 1.0) if p is None else p}}})


def test_daily_series(spark, tmp_path):
    read = lambda *bodies: readers.parse_daily(spark.createDataFrame([(f"s{k}", b) for k, b in enumerate(bodies)], "site_id string, payload string"))
    got = [(str(r.date), r.t2m_c, r.precip_mm) for r in read(daily({"20230102": -999, "20230101": 1.5}, {"20230101": 0, "20230102": -999.0})).orderBy("date").collect()]
    assert got == [("2023-01-01", 1.5, 0.0), ("2023-01-02", None, None)]
    bad = {
        "differ": daily({"20230101": 1.0}, {"20230102": 1.0}), "invalid date": daily({"20230230": 1.0}), "invalid date key": daily({"2023011": 1.0}), "continuous": daily({"20230101": 1.0, "20230103": 1.0}),
        "finite numeric": daily({"20230101": True}), "must be finite": daily({"20230101": "1.0"}), "values must": '{"properties":{"parameter":{"T2M":{"20230101":null},"PRECTOTCORR":{"20230101":1}}}}',
        "negative": daily({"20230101": 1.0}, {"20230101": -1.0}), "lacks": "{}", "lacks a parameter": "[1]", "no daily": daily({}),
    }
    for text, body in bad.items():
        with pytest.raises(CheckError, match=text):
            read(daily({"20230101": 1.0}), body)
    path = put(tmp_path, "w.json", daily({"20230101": 1.0}))
    assert readers.read_daily_series(spark, path).count() == 1


def scene(i, cloud=1.0, bands=({"scale": 0.1, "offset": -0.1},)):
    return {"id": i, "properties": {"datetime": "2023-07-01T00:00:00Z", "eo:cloud_cover": cloud}, "assets": {b: {"href": b, "raster:bands": list(bands)} for b in ("red", "nir", "scl")}}


def test_scene_catalogue(spark, tmp_path):
    scenes, bands = readers.read_scene_catalogue(spark, put(tmp_path, "s.json", {"context": {"matched": 2}, "features": [scene("a"), scene("b", None, [{}])]}))
    assert {r.scene_id: r.cloud_cover for r in scenes.collect()} == {"a": 1.0, "b": None}
    assert {(r.scene_id, r.band): (r.scale, r.offset) for r in bands.collect()}["b", "red"] == (1.0, 0.0) and bands.count() == 6
    for doc in ({"context": {"matched": 3}, "features": [scene("a")]}, {"links": [{"rel": "next"}], "features": [scene("a")]}, {"features": []}, {"features": [scene("a", bands=[])]}, {"features": [scene("a") | {"assets": {}}]}):
        with pytest.raises(CheckError):
            readers.read_scene_catalogue(spark, put(tmp_path, "t.json", doc))
    assert readers.read_scene_catalogue(spark, put(tmp_path, "u.json", {"links": [{"rel": "self"}], "features": [scene("a")]}))[0].count() == 1


@pytest.fixture
def small_blocks(spark):
    """Blocks of few bytes, so that one file is read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "0")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_one_collection_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    """Features of a file on one line, and of one on many, with braces, quotes and other members in the way."""
    r = random.Random(6)
    odd = ["}", "{", 'say "}" {', "back\\\\", '\\"', "é{", "", "},{", "[{", "a\nb"]
    features = [{"type": "Feature", "properties": {"id": f"f{i}", "name": r.choice(odd) + str(i), "area": i / 7}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 0]]]}} for i in range(120)]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x{y}"}}, "na{me": "fields } here", "features": features, "foot": {"a": {"b": 1}}}
    want = None
    for k, text in enumerate((json.dumps(doc), json.dumps(doc, indent=2), json.dumps(dict(reversed(doc.items())), ensure_ascii=False))):
        path = str(tmp_path / f"d{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        plain = readers.read_geojson(spark, path, "id string, name string, area double", "id", "area")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        got = sorted(map(str, readers.read_geojson(spark, path, "id string, name string, area double", "id", "area", split=True).collect()))
        want = want or sorted(map(str, plain.collect()))
        assert got == want and len(got) == 120
    for bad in ({"type": "Feature"}, {"type": "FeatureCollection", "features": []}, {"type": "FeatureCollection", "features": [features[0], features[0]]}, {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": None}, "geometry": None}]}):
        with pytest.raises(CheckError):
            readers.read_geojson(spark, put(tmp_path, "bad.json", bad), "id string, name string, area double", "id", "area", split=True)


def test_one_table_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    """Quoted values with line ends, bars and doubled quotes, over block ends."""
    r = random.Random(7)
    values = ["plain", "bar | bar", 'a "quoted" one', "two\nlines", "\n\n", "", "é", 'x "\n" y', "many\n" * 9]
    rows = [[str(i), r.choice(values), r.choice(values)] for i in range(300)]
    path = str(tmp_path / "t.txt")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join("|".join('"' + v.replace('"', '""') + '"' if r.random() < 0.5 or any(c in v for c in '"|\n') else v for v in row) + "\n" for row in rows))
    names = spark.createDataFrame([("t", str(k + 1), n) for k, n in enumerate(("key", "one", "two"))], "table string, ordinal string, column string")
    plain = sorted(map(tuple, readers.read_dictionary_table(spark, path, names, "t", ["key", "one", "two"]).collect()))
    assert spark.read.text(path).rdd.getNumPartitions() > 5 and len(plain) == 300
    assert sorted(map(tuple, readers.read_dictionary_table(spark, path, names, "t", ["key", "one", "two"], split=True).collect())) == plain
    with open(path, "a", encoding="utf-8") as f:
        f.write("short|row\n")
    with pytest.raises(CheckError, match="without full width"):
        readers.read_dictionary_table(spark, path, names, "t", ["key"], split=True)


def test_labels(spark):
    read = lambda html: {r.code: r.name for r in readers.parse_labels(spark.createDataFrame([(html,)], "html string"), "html").collect()}
    assert read('<pre>\n&quot;0&quot;  Background\n "1" Corn \nnone</pre><p>"9" No</p><pre>"26" Dbl &amp; Wheat\r\n"1" Corn\n&#34;5&#x22; O&#39;ats &eacute;</pre>') == {0: "Background", 1: "Corn", 5: "O'ats é", 26: "Dbl & Wheat"}
    with pytest.raises(CheckError, match="conflicting"):
        read('<pre>"1" Corn\n"1" Rice</pre>')
    with pytest.raises(CheckError, match="none found"):
        read('"1" Corn')


def test_products_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("B", "9", "s", "n", 1.0, 2.0, 0.5), ("A", "", "", "", 0.0, 2.0, 0.0)], readers.PRODUCTS["overlaps"])
    writers.write_product(df, str(tmp_path / "o"), ["field_id", "mukey"])
    got = readers.read_product(spark, str(tmp_path / "o"), "overlaps")
    assert [(r.field_id, r.mukey) for r in got.orderBy("field_id").collect()] == [("A", ""), ("B", "9")]
    nan = readers.without_nan(spark.createDataFrame([(float("nan"), 1), (1.5, 2)], "v double, k int"))
    assert [r.v for r in nan.orderBy("k").collect()] == [None, 1.5]
    writers.write_summary(spark.createDataFrame([(1, None)], "b int, a int"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":null,"b":1}'
    writers.write_product(crops.product_counts({"o": (df, ["field_id"], ["mukey"])}), str(tmp_path / "m"), ["product"], "parquet")
    assert spark.read.parquet(str(tmp_path / "m")).first().distinct_keys == 2


def test_tiles(spark, tmp_path):
    schema = "raster_id string, year int, tile_x int, tile_y int, origin_x double, origin_y double, pixel_size double, width int, height int, `values` array<int>"
    spark.createDataFrame([("r", 1, 0, 0, 0.0, 0.0, 1.0, 2, 1, [1, 2])], schema).write.parquet(str(tmp_path / "t"))
    assert readers.read_tiles(spark, str(tmp_path / "t")).count() == 1
    spark.createDataFrame([("r", 1, 0, 0, 0.0, 0.0, 1.0, 2, 1, [1])], schema).write.parquet(str(tmp_path / "u"))
    with pytest.raises(Exception, match="lacks values"):
        readers.read_tiles(spark, str(tmp_path / "u")).collect()


def test_global_places(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    assert all(r.place == r.v + 1 for r in places.global_places(df, [F.col("v").asc()]).collect())


def test_places_of_wide_rows_written_and_read(spark, tmp_path):
    """Ranges that counts and ranks see differently would give repeated or missing places."""
    n = 200_000
    wide = spark.range(n).select(F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.lit("b" * 20).alias("b"), F.rand(3).alias("c"))
    places.global_places(wide, [F.col("v").asc()]).write.parquet(str(tmp_path / "placed"))
    got = spark.read.parquet(str(tmp_path / "placed"))
    one = got.agg(F.count_distinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi")).first()
    assert tuple(one) == (n, 1, n)
    least = got.where("place <= 3").orderBy("place").select("v").collect()
    assert [r.v for r in least] == [r.v for r in wide.orderBy("v").limit(3).select("v").collect()]


def test_exact_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 5.0), ("c", None)], "g string, v double")
    got = {r.g: r.q for r in places.exact_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {"a": [0.0, 2.25, 4.5, 9.0], "b": [5.0] * 4}


def test_quantiles_of_hot_and_odd_values(spark, monkeypatch):
    """A value of 90 % of the rows is one row before anything is placed; brackets that miss and ranges that are cut again
    give the same."""
    import numpy as np

    r = np.random.default_rng(4)
    sides = {"hot": np.where(r.random(6000) < 0.9, 7.0, r.normal(size=6000)), "wide": r.normal(size=5000) * 10.0 ** r.integers(-200, 200, 5000), "few": r.integers(0, 4, 3000) / 3, None: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, values in sides.items() for v in values], "g string, v double").repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {g: np.quantile(v, shares) for g, v in sides.items()}

    def same():
        got = {x.g: x.q for x in places.exact_quantiles(df, "g", "v", shares).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=1e-12) for g in got)

    same()
    monkeypatch.setattr(places, "VALUES", 100)
    same()
    whole = places._brackets
    monkeypatch.setattr(places, "_brackets", lambda *a: [w | {"from": w["to"] + 1.0, "to": w["to"] + 1.5} if w["k"] == 2 else w for w in whole(*a)])
    same()
    counted = places._counted(df.withColumnRenamed("v", "_v"), "g", whole(df.withColumnRenamed("v", "_v"), "g", [0.5]))
    assert counted.where("_v = 7").count() == 1  # the hot value
    with pytest.raises(ValueError):
        monkeypatch.setattr(places, "GROUPS", 2)
        places.exact_quantiles(df, "g", "v", shares)


def test_order_of_files(spark, tmp_path):
    df = spark.createDataFrame([(f"k{v:03d}", v) for v in range(200)], "field_id string, year int")
    writers.write_product(df.repartition(4), str(tmp_path / "good"), ["field_id", "year"])
    assert tuple(readers.order_of_files(spark, str(tmp_path / "good"), ["field_id", "year"], "field_id string, year int").first()) == (200, 0)
    df.orderBy(F.desc("year")).coalesce(1).write.option("header", True).csv(str(tmp_path / "bad"))
    assert tuple(readers.order_of_files(spark, str(tmp_path / "bad"), ["field_id", "year"], "field_id string, year int").first()) == (200, 199)


def test_results_do_not_depend_on_partitions(spark):
    from fieldspark.plans import queries

    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("zon1_majority_class", "agg4_flt5_value_counts", "top1_dominant_soils"):
        seen = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert seen[0] == seen[1] and seen[0]
