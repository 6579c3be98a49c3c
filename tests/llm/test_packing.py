"""Packing against bounds, and the sum-of-squares rule."""

import random
import zlib

import numpy as np
import pyarrow as pa
from cases import docs_of, prose
from pyspark.sql import functions as F

from fieldspark.llm import packing, tokens
from fieldspark.llm.common import vocabulary


def test_one_large_group_of_repeated_rows_is_packed(spark):
    docs = docs_of(spark, ["the same few words"] * 4000 + ["else"]).withColumn("doc_id", F.lit(5).cast("long"))
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 4001 and len(used) <= sum(r.length for r in rows) // 1024 + 2
    assert all(o == sum(n for _, n in sorted(v)[:k]) for v in used.values() for k, (o, _) in enumerate(sorted(v)))


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_sum_of_squares_takes_the_least_sum():
    r, lengths = random.Random(5), []
    lengths = [r.randint(1, 20) for _ in range(200)]
    got = packing.sum_of_squares(lengths, 20)
    gaps, where = [], {i: b for b, m in enumerate(got) for i in m}
    for i, s in enumerate(lengths):  # each step against every choice
        def total(change):
            counts = {}
            for g in change:
                if 0 < g < 20:
                    counts[g] = counts.get(g, 0) + 1
            return sum(c * c for c in counts.values())

        options = [total([*gaps[:b], g - s, *gaps[b + 1 :]]) for b, g in enumerate(gaps) if g >= s] + [total([*gaps, 20 - s])]
        b = where[i]
        if b == len(gaps):
            gaps.append(20)
        gaps[b] -= s
        assert gaps[b] >= 0 and total(gaps) == min(options)


def test_packed_sequences_are_whole(spark, hard, empty):
    name = vocabulary("byte_bpe_50k.json")
    docs = hard.unionByName(docs_of(spark, prose(6, 300, 400)).withColumn("doc_id", F.col("doc_id") + 100))
    rows = packing.pack_documents(docs, name).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 1024
    coder = tokens.UnitEncoder(name).tokenizer
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = np.array(coder.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(-1 if d is None else d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack_documents(empty, name).count() == 0


def test_a_worker_knows_whether_it_has_the_encoder():
    """What decides whether packing frees what stages before have left in a worker; and its own memory is small."""
    path, other = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    tokens.encoder(other)
    assert tokens.holds(other) and not tokens.holds(path)
    tokens.encoder(path)
    assert tokens.holds(path) and not tokens.holds(other)
    tokens.forget()
    assert packing.MEMORY <= 200_000 and packing.SLICE <= 1_000_000


def test_units_met_again_stay_when_room_is_made():
    """What packing costs with a small memory: common words are encoded once, not anew each time that it is full."""
    coder, learned = tokens.UnitEncoder(vocabulary("byte_bpe_50k.json")), []
    coder.memory, learn = 60, coder._learn
    coder._learn = lambda units: (learned.extend(units), learn(units))
    for k in range(20):
        coder.encode(pa.array([f"the common words of all {' '.join(f'w{k}x{i}' for i in range(20))} end."]))
    assert learned.count(" common") == 1 and len(set(learned)) > 400
    only = tokens.UnitEncoder(vocabulary("byte_bpe_50k.json"))  # what is left may have no ids at all
    only.memory = 2
    for t in ("", "", "a b", "", "c d\n\ne"):
        assert only.encode(pa.array([t]), None)[0].tolist() == only.tokenizer.encode(t, add_special_tokens=False).ids


def test_units_encoded_by_lines_are_those_of_whole_texts():
    coder = tokens.UnitEncoder(vocabulary("byte_bpe_50k.json"))
    texts = ["a\nb", "\na", "a\n", "a b\n\nc", "it's 5's\n's x", "a\u00a0b c\u2028d", " a", "b ", "\x01a b", "a\x1cb c", "", "\n", "x\x85y z", "a,\nb. c", "\u0120\u010a \u010a", "e\u0301 \u3000f", "<|endoftext|> a", "\x00 a\x00b", "\r\na", "z\u180ey \u200b"]
    for memory in (5, 40, None):
        coder.memory = memory
        for k in range(1, len(texts) + 1):
            ids, ends = coder.encode(pa.array(texts[:k]), None)
            want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:k]]
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
