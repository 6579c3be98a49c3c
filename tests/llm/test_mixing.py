"""Source mixing against targets worked out plainly, and its schedule."""

from cases import docs_of, prose
from pyspark.sql import functions as F

from fieldspark.llm import mixing
from fieldspark.llm.common import numbered


def targets(sizes):
    """Shares by weight, the excess of those above twice their size reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        t = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        more = {s for s in free if t[s] > 2 * sizes[s]}
        if not more:
            return t
        capped |= more


def test_mix_meets_targets(spark, hard, empty):
    texts = prose(1, 300)
    docs = docs_of(spark, texts, lambda i: [None, "", "é", "z", "a"][0 if i < 100 else i % 5]).unionByName(hard.limit(5))
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count() and mixing.mix_documents(empty).count() == 0
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = targets(sizes)
    assert sorted({round(r.target, 6) for r in rows}) == sorted({round(v, 6) for v in want.values()})
    for s, size in sizes.items():
        own = [r for r in rows if r.source_size == size]
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * sum(r.taken < 0 for r in own) + 2
    assert all(0 <= r.taken <= 2 * r["size"] and (r.first_slot is None) == (r.taken == 0) for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_documents(docs.repartition(7)).collect()), key=str)


def test_schedule_fills_every_rank_once(spark):
    goals = spark.createDataFrame([("a", 9, 0, 5000.0), ("b", 9, 1, 10.0), ("c", 9, 2, 990.0)], "source string, source_size long, src int, target double")
    got = mixing.schedule(goals, 6000.0, 64).collect()
    for src, target in ((0, 5000), (1, 10), (2, 990)):
        assert sorted(r.rank for r in got if r.src == src) == list(range(-(-target // 64)))
    early = [r.src for r in sorted(got, key=lambda r: r.slot)[:24]]
    assert abs(early.count(0) - 20) <= 2  # low discrepancy: shares hold in short prefixes


def test_mixed_corpus_keeps_columns_and_words(spark):
    docs = docs_of(spark, prose(2, 200))
    taken = mixing.mix_documents(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_corpus(docs)
    rows = out.collect()
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in rows) == taken
    assert all(r.n_chars == len(r.text) for r in rows)
    whole = dict(enumerate(prose(2, 200)))
    assert all(whole[r.doc_id].startswith(r.text) for r in rows)


def test_prefixes_of_the_mix_hold_the_shares(spark):
    """Slots decide the order: in every prefix each source has its share but for a few blocks, which no order by source or rank gives."""
    docs = docs_of(spark, prose(4, 600), lambda i: "abc"[i % 3])
    block = 16
    pieces = mixing.mix_pieces(mixing._sized(docs), block).where("slot is not null").select("slot", "source", "part", "target").collect()
    words, total = {}, sum({r.source: r.target for r in pieces}.values())
    by_slot = {}
    for r in pieces:
        by_slot.setdefault(r.slot, []).append(r)
    worst = {s: 0.0 for s in "abc"}
    taken = 0
    for slot in sorted(by_slot)[: int(0.95 * len(by_slot))]:
        for r in by_slot[slot]:
            words[r.source] = words.get(r.source, 0) + r.part
            taken += r.part
        assert len({r.source for r in by_slot[slot]}) == 1 and sum(r.part for r in by_slot[slot]) <= block
        for r in pieces[:3]:
            worst[r.source] = max(worst[r.source], abs(words.get(r.source, 0) - taken * r.target / total))
    assert max(worst.values()) <= 5 * block


def test_mixed_corpus_stands_in_slot_order(spark):
    docs = docs_of(spark, [f"{t} {t} {t} {t}" for t in prose(6, 900)], lambda i: "abc"[i // 300])
    want = {r.doc_id: (r.first_slot, r.target, r.source_size) for r in mixing.mix_documents(docs).collect()}
    rows = mixing.mixed_corpus(docs).collect()
    first = {}
    for at, r in enumerate(rows):
        first.setdefault(r.doc_id, at)
    order = sorted(first, key=first.get)
    assert [want[d][0] for d in order] == sorted(want[d][0] for d in order)
    targets = {r.source: want[r.doc_id][1] for r in rows}
    half, words = rows[: len(rows) // 2], {}
    for r in half:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for s, t in targets.items():
        assert abs(words[s] / sum(words.values()) - t / sum(targets.values())) < 0.05
    copies = docs_of(spark, ["a b c"] * 3000 + ["d e f g"], lambda i: "a").withColumn("doc_id", F.lit(7).cast("long"))
    out = mixing.mixed_corpus(copies)
    assert out.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == mixing.mix_documents(copies).agg(F.sum("taken")).first()[0]


def test_taken_words_follow_the_shuffled_stream(spark):
    """Every document's words, from the streams read plainly: sources' documents in the order of their hashes, again from
    the start, until the target is reached."""
    docs = docs_of(spark, prose(9, 500), lambda i: "abc"[i % 7 % 3])
    rows = mixing.mix_documents(docs).collect()
    order = {r.doc_id: (r.bucket, r.h) for r in mixing._sized(docs).withColumn("h", F.xxhash64(F.lit("order"), "doc_id", "digest", "size")).withColumn("bucket", F.pmod("h", F.lit(max(1, len(rows) // mixing.BUCKET_ROWS)))).collect()}
    for size in {r.source_size for r in rows}:
        own = sorted((r for r in rows if r.source_size == size), key=lambda r: order[r.doc_id])
        left, want = int(own[0].target), dict.fromkeys((r.doc_id for r in own), 0)
        for _ in range(2):
            for r in own:
                n = min(left, r["size"])
                want[r.doc_id] += n
                left -= n
        assert {r.doc_id: r.taken for r in own} == want and left == 0


def test_very_many_copies_of_one_row(spark):
    """A unit of very many equal rows covers slots in runs, and every copy has its row."""
    hot = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("word " * 120).alias("text"), F.lit("a").alias("source"))
    docs = hot.unionByName(docs_of(spark, prose(3, 50), lambda i: "b").select("doc_id", "text", "source"))
    rows = mixing.mix_documents(docs)
    assert rows.count() == 40_050 and rows.where("doc_id = 7 and size = 120").select("taken").distinct().count() == 1
    got = rows.groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 40_000 + 2 for r in got)  # copies take equally much, in whole words
    sums = [r.n for r in numbered(spark.range(1), F.lit(5), F.lit(20_003), "k").select(F.sum("k").alias("n")).collect()]
    assert sums == [sum(range(5, 20_004))] and numbered(spark.range(1), F.lit(5), F.lit(4), "k").count() == 0
