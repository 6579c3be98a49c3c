import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import docs_of

from fieldspark.llm import spelling as S


def near(a, b):
    """Whether one inserted, deleted or replaced code point tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """The contract, word by word."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c in S.UPPER else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(by[w]), words.get(form[w]))
    return out


def found(docs):
    rows = S.spelling_variants(docs).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def corpus(seed, words=40, docs=40):
    """Words with variants of falling frequency, so that forms lead to forms, and with damage by the hash."""
    r = random.Random(seed)
    base = ["".join(r.choice("aeiouabcdäéÿÀß") for _ in range(r.randint(6, 11))) for _ in range(words)]
    base += ["a" * k for k in (7, 8, 9, 12)] + ["abababab", "ababababa", "Bababab", "x×÷yzabc"]
    texts = []
    for _ in range(docs):
        out = []
        for _ in range(r.randint(0, 120)):
            w = base[int(len(base) * r.random() ** 3)]
            for _ in range(r.choice((0, 0, 0, 0, 0, 0, 0, 1, 1, 2))):
                k = r.randrange(len(w) + 1)
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + r.choice("abcé") + w[k + 1 :])) or "a"
            out.append(r.choice((w, w, w.upper() if w.isascii() else w, w.capitalize())))
        texts.append(r.choice((" ", "-", "1", ", ")).join(out))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_equal_brute_force(spark, seed):
    texts = [*corpus(seed), "wonderful " * 310, "wonderfull " * 28, "wonderfulll " * 2, None, "", "x" * 30_000, "x" * 30_001, "y" * 29_999 + "z", "x" * 30_000, "x" * 30_001, "y" * 29_999 + "z", "y" * 30_000, "y" * 30_000, "wörterĀwörterei wörterei İstanbul ſtrasse"]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.withColumn("doc_id", docs.doc_id + 7))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute(rows)
    assert sum(v[3] > 0 for v in expected.values()) > 20 and expected["wonderfulll"][1] == "wonderful"
    assert found(docs) == expected


def test_null_ids_and_empty_tables(spark, hard, empty):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert found(hard) == brute(rows)
    twice = docs_of(spark, ["wonderful wonderfull wonderful"] * 2).withColumn("doc_id", S.F.lit(None).cast("long"))
    assert found(twice) == brute([(None, "wonderful wonderfull wonderful")] * 2)
    assert S.spelling_variants(empty).count() == 0


def test_words_without_near_ones(spark):
    assert found(docs_of(spark, ["alphabet zeppelin"] * 3)) == brute([(i, "alphabet zeppelin") for i in range(3)])


def test_pivots_are_the_cheapest_of_all_choices():
    r = random.Random(3)
    for _ in range(300):
        places = sorted(r.sample(range(20), r.randint(3, 7)))
        costs = [r.randint(1, 9) for _ in places]
        chosen = S.pivots(places, costs)
        ways = [a + b for (i, a), (j, b) in itertools.combinations(zip(places, costs), 2) if j - i >= 2]
        assert chosen[1] - chosen[0] >= 2 and sum(costs[places.index(p)] for p in chosen) == min(ways)
    with pytest.raises(ValueError):
        S.pivots([3, 4], [1, 1])


def test_every_near_pair_meets_in_a_key():
    """Whatever the order of the bigrams, one of two near words has a pivot that meets the other's prefix."""
    r = random.Random(9)
    for _ in range(2000):
        a = "".join(r.choice("abcd" if r.random() < 0.5 else "ab") for _ in range(r.randint(7, 14)))
        k = r.randrange(len(a) + 1)
        b = r.choice((a[:k] + r.choice("abcde") + a[k:], a[:k] + r.choice("abcde") + a[k + 1 :]))
        if not near(a, b) or len(b) < 7:
            continue
        order = np.zeros((2, 1 << 16), np.int64)
        order[0] = np.random.default_rng(r.randrange(1 << 30)).permutation(1 << 16)
        order[1] = order[0]
        t = [x for batch in S.index_rows([a, b], [1, 1], order) for x in batch.to_pylist()]
        assert any(p["key"] == q["key"] and p["pivot"] and not q["pivot"] and p["word"] != q["word"] and p["last"] <= q["last"] for p in t for q in t), (a, b)
