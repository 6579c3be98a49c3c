"""The n-gram join against brute force."""

import random

import numpy as np
import pytest
from cases import docs_of, prose
from pyspark.sql import functions as F

from fieldspark.llm import ngram_join
from fieldspark.llm.common import components


def plain_components(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
        if up == (new := [up[u] for u in up]):
            break
        up = new
    least = {}
    for (d, _), u in zip(rows, up):
        if d is not None:
            least[u] = min(least.get(u, d), d)
    return sorted(((-1 if d is None else d), len(s), -1 if d is None else least[u]) for (d, _), s, u in zip(rows, sets, up))


def near_copies(seed):
    r, out = random.Random(seed), []
    for base in prose(seed, 12, 90):
        out.append(base)
        now = base.split()
        for _ in range(r.randint(0, 8)):  # a chain: each copy changes the one before
            now = now.copy()
            for _ in range(r.randint(0, 2)):
                now[r.randrange(len(now))] = r.choice(["Xx", "yy", "zz"])
            out.append(" ".join(now).upper() if r.random() < 0.2 else " ".join(now))
    passage = prose(99, 1, 60)[0]
    return out + [f"{passage} {t}" for t in prose(seed + 1, 20, 20)] + ["a b c", "A b  c", "a b c d"]


@pytest.mark.parametrize(("seed", "stars", "common", "block"), [(1, 2, 64, 60_000), (2, 0, 2, 60_000), (3, 1, 1, 9), (4, 2, 64, 5)])
def test_components_equal_brute_force(spark, hard, monkeypatch, seed, stars, common, block):
    """Also with so few texts in a block that equal sets come in many blocks, and so that most n-grams are common ones."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 500)
    docs = docs_of(spark, near_copies(seed) * (1 if block > 9 else 2)).coalesce(3)
    if seed == 1:
        docs = docs.withColumn("doc_id", F.col("doc_id") + 50).unionByName(hard)
    real = ngram_join.node_components
    monkeypatch.setattr(ngram_join, "node_components", lambda n, p, spent: real(n, p, stars, spent))
    got = [((-1 if d is None else d), n, -1 if c is None else c) for d, n, c in ngram_join.document_components(docs).collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    if seed != 1:
        assert sorted(got) == plain_components(rows)
    else:  # rows that repeat an id
        assert sorted(set(got)) == sorted(set(plain_components(rows)))


def test_equal_tags_of_different_sets_are_found_out(spark, monkeypatch):
    """With tags of one byte different sets are taken for copies; whole digests tell, and other bytes are tried."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 9)
    passage = prose(99, 1, 60)[0]
    texts = [f"{passage} {t}" for t in prose(31, 90, 8)]
    docs = docs_of(spark, texts + texts[:40]).coalesce(3)
    tried, real = [], ngram_join._tagged_grams
    monkeypatch.setattr(ngram_join, "_tagged_grams", lambda *a: tried.append(a[-1]) or real(*a))
    monkeypatch.setattr(ngram_join, "TAGS", ((0, 1), (6, 12)))
    got = sorted((d, n, c) for d, n, c in ngram_join.document_components(docs).collect())
    assert tried == [(0, 1), (6, 12)] and got == plain_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(ngram_join, "TAGS", ((0, 1),))
    with pytest.raises(RuntimeError):
        ngram_join.document_components(docs)


def test_sizes_grow_with_the_square_root(spark, monkeypatch):
    """Blocks and fragments that grow give the same components."""
    docs = docs_of(spark, near_copies(7) * 2).coalesce(3)
    want = plain_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 700)
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 500)
    for least in (1, 10_000_000):
        monkeypatch.setattr(ngram_join, "GROWTH_BYTES", least)
        assert sorted(tuple(r) for r in ngram_join.document_components(docs).collect()) == want


def test_join_of_nothing(spark, empty):
    assert ngram_join.document_components(empty).count() == 0
    kept = ngram_join.one_of_each_group(docs_of(spark, ["a b c d e f", "a b c d e f", None, "q"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_connected_components(spark):
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(200, 200), (None, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {n: n for p in pairs if None not in p for n in p}
    for _ in range(200):
        for a, b in pairs:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    assert got == {n: c for n, c in up.items() if n != 200}


def test_overlaps_are_counted_by_fragment_and_summed(spark):
    """Fragments are ranges of the order with about equally many entries, and a pair's overlap is the sum of their counts."""
    docs = docs_of(spark, near_copies(5) * 2)
    nodes = ngram_join.shared_grams(docs)[0].dropDuplicates(["sig"])
    cuts = ngram_join.borders(nodes, 4)
    parts = ngram_join.segments(nodes, cuts).collect()
    assert len({r.part for r in parts}) == len(cuts) + 1 > 1
    whole = {bytes(r.sig): r["keys"] for r in nodes.collect()}
    joined = {}
    for r in sorted(parts, key=lambda r: r.part):
        keys = np.array(r["keys"], np.int64).view(np.uint64)
        assert (np.searchsorted(np.array(cuts, np.uint64), keys, "right") == r.part).all()
        joined.setdefault(bytes(r.sig), []).extend(r["keys"])
    assert joined == whole
    pairs = spark.createDataFrame([(bytearray(a), bytearray(b)) for a in whole for b in whole if a < b], "a binary, b binary")
    got = {(bytes(r.a), bytes(r.b)): r.o for r in ngram_join.overlaps(pairs, ngram_join.segments(nodes, cuts)).collect()}
    want = {(a, b): n for a in whole for b in whole if a < b and (n := len(set(whole[a]) & set(whole[b])))}
    assert got == want


def test_a_place_where_many_meet_but_none_link(spark):
    """Many documents share a passage that falls just short of a link: no pairs are made of them, and near copies among
    them are still found."""
    passage = " ".join(f"p{i}" for i in range(64))
    texts = [f"{passage} " + " ".join(f"w{i}x{k}" for k in range(19)) for i in range(300)]  # 60 of 79 n-grams each, 60 of 98 in common
    texts += [f"{t} end" for t in texts[:3]]
    found = {r.doc_id: r.component_id for r in ngram_join.document_components(docs_of(spark, texts)).collect()}
    assert found == {**{i: i for i in range(300)}, 300: 0, 301: 1, 302: 2}
