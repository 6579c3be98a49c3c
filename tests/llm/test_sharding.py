"""Hash-tree sharding against plain draws, and its law."""

import math
import zlib

from cases import HARD
from pyspark.sql import functions as F
import xxhash

from fieldspark.llm import sharding


def test_shards_are_gapless_and_grow_into_the_new_one(spark, hard, empty):
    rows = sharding.shard_documents(hard).collect()
    assert len(rows) == hard.count() and sharding.shard_documents(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    got = {(r.doc_id, r.text_crc32): r["size"] for r in rows}
    assert got[(5, zlib.crc32(HARD[5].encode()))] == len(HARD[5].encode()) + 1 and got[(1, 0)] == 1


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints and strings: each value's hash seeds the next."""
    h = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else v.to_bytes(8 if kind == "l" else 4, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h & (2**64 - 1))
    return h - 2**64 if h >= 2**63 else h


def plain_place(key, topology):
    """Draws written out: -ln(u) / weight for each shard; descends to the region, rack and shard of the least draws."""
    draw = {s.shard: -math.log((((spark_hash(("l", key), ("i", s.shard)) & (2**64 - 1)) >> 11) + 0.5) / 2**53) / s.weight for s in topology if s.weight}
    rows = [s for s in topology if s.weight]
    for level in ("region", "rack", "shard"):
        children = {getattr(s, level) for s in rows}
        best = min(children, key=lambda c: min(draw[s.shard] for s in rows if getattr(s, level) == c))
        rows = [s for s in rows if getattr(s, level) == best]
    return rows[0].shard


def test_draws_equal_plain_ones(spark):
    for topology in (sharding.tree(8), sharding.grown(sharding.reweighted(sharding.tree(7, 3, 2), 2, 3.5))):
        got = spark.range(500).select("id", sharding.place(F.col("id"), topology).alias("s")).collect()
        assert all(r.s == plain_place(r.id, topology) for r in got)


def test_doc_id_and_number_of_shards_decide(spark):
    """Growth from n to n + 1 shards is the tree of n + 1, and takes rows only into the new shard, for every n."""
    trees = [sharding.tree(n) for n in range(1, 42)]
    assert all(sharding.grown(a) == b for a, b in zip(trees, trees[1:]))
    rows = spark.range(3000).select(*[sharding.place(F.col("id"), t).alias(f"n{len(t)}") for t in trees]).toPandas()
    for n in range(1, 41):
        moved = rows[rows[f"n{n}"] != rows[f"n{n + 1}"]]
        assert (moved[f"n{n + 1}"] == n).all() and 0 < len(moved) < 3000
        assert abs(rows[f"n{n}"].value_counts().max() - 3000 / n) < 6 * (3000 / n) ** 0.5 + 1


def test_grown_shard_is_the_shard_of_the_next_number(spark, hard):
    old, new = (sharding.shard_documents(hard, n).collect() for n in (8, 9))
    of = {(r.doc_id, r.text_crc32): r.shard for r in new}
    assert all(of[r.doc_id, r.text_crc32] == r.grown_shard for r in old)


def test_changed_weight_moves_rows_only_into_or_out_of_its_shard(spark):
    old = sharding.tree(8)
    ids = spark.range(4000)
    for new, inward in ((sharding.reweighted(old, 5, 2.0), True), (sharding.reweighted(old, 5, 0.25), False)):
        got = ids.select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).where("a <> b").collect()
        assert got and all(r["b" if inward else "a"] == 5 for r in got)
    share = ids.groupBy(sharding.place(F.col("id"), sharding.reweighted(old, 0, 9.0)).alias("s")).count().where("s = 0").first()["count"]
    assert abs(share / 4000 - 9 / 16) < 0.04
    regions = {r.region: r["count"] for r in ids.groupBy(sharding.descend(F.col("id"), sharding.reweighted(old, 0, 5.0))["region"].alias("region")).count().collect()}
    assert abs(regions[0] / 4000 - 8 / 12) < 0.04


def test_slots_over_many_buckets(spark):
    rows = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    got = sharding.shard_rows(rows, "k", ["o"], sharding.tree(8), None, 16).collect()
    assert sorted(r.slot for r in got) == list(range(500)) and len({r.shard for r in got}) == 1
