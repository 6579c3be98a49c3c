"""The five stages on small and odd inputs."""

import corpus_pipeline
import pytest
from cases import docs_of, prose
from pyspark.sql import functions as F

PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with ``documents``: good prose with near copies and personal data, junk, null ids and texts, columns whose
    names operators use; ``labels`` for most."""
    good = [f"{t} {t.upper()} call +1 (499) 555-{i:04d} or mail u{i}@ex{i}.org" if i % 5 == 0 else t for i, t in enumerate(prose(3, 240, 120))]
    good += [g + " indeed" for g in good[:40]]
    junk = ["$$ ## buy!!! " * (i % 9 + 5) for i in range(120)]
    docs = docs_of(spark, good + junk + [None, ""])
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 7"))
    root = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{root}/documents.parquet")
    quality = [(i, int(i < len(good)), 0) for i in range(len(good) + len(junk))]
    spark.createDataFrame(quality, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), good


def test_stages_one_after_the_other(spark, labelled):
    root, good_texts = labelled
    good = len(good_texts)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, root).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len([i for i in ids if i is not None and i < good]) > 0.95 * good and not [i for i in ids if i is not None and good <= i < good + 120]
    single = corpus_pipeline.drop_near_copies(spark, kept, root).cache()
    left = {r.doc_id for r in single.select("doc_id").collect()}
    long = {i for i, t in enumerate(good_texts) if i >= 240 and len(t.split()) >= 12}  # shorter ones share too little with their copy
    assert single.columns == docs.columns and not left & long and len(left) >= len(ids) - 45
    clean = corpus_pipeline.redact(spark, single, root).cache()
    assert clean.count() == single.count() and not clean.where("text like '%@ex%'").count() and clean.where("text like '%[EMAIL]%'").count() > 20
    mixed = corpus_pipeline.mix(spark, clean, root).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = corpus_pipeline.pack(spark, mixed, root).collect()
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and {r.doc_id for r in packed} == {r.doc_id for r in mixed.select("doc_id").collect()}


def test_whole_run(spark, labelled):
    rows = corpus_pipeline.run(spark, labelled[0])
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 200


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
