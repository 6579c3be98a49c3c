"""Spelling variants by pivotal grams.

A word's bigrams are put in one global order, rare ones first. Its gram prefix is its bigrams up to the third of its own
in that order; two disjoint bigrams of the prefix, chosen by dynamic programming so that they are as rare as may be,
are its pivots. One inserted, deleted or replaced character touches at most one of two disjoint bigrams, so of two near
words the one whose prefix ends first has a pivot that the other word holds untouched, and within its prefix. All of
the word on one side of that bigram is untouched too: its place from the start or from the end must agree, with what
lies on that side. Pivots are indexed by it, met with the other words' prefixes, and each meeting is verified.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from fieldspark.llm.common import discard, put, written

#: The characters of runs, as Latin-1 holds them, the least length of a word and number of its occurrences,
#: which occurrences are damaged, and how much more frequent a form is.
RUN, LEAST, TWICE, DAMAGED, FORM = "[A-Za-zÀ-ÿ]{7,}", 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bigrams of a prefix that one edit can't all touch; most words indexed at once, and characters of their rows.
PREFIX, WORDS, CHARS = 3, 50_000, 64_000_000
#: Length from which words are compared from both ends.
LONG = 256
#: Characters on the untouched side of a bigram up to which a key holds half of the rest as well.
SHORT = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
GRAMS, INDEX = "gram int, n long", "key long, pivot boolean, word string, n long, last int"


def words(docs: DataFrame) -> DataFrame:
    """word, n: lower-cased runs (A-Z only) after the damage, of at least 7 code points and 2 occurrences. Runs of fewer
    than 7 give no word, as damage only shortens them. A null text has none, a null id is written as nothing."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = run.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    h = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    word = h.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= TWICE) & (F.length("word") >= LEAST))


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters, each word's start, and for each place but the last of a word the bigram there (else -1)."""
    flat = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    grams = np.full(len(flat), -1, np.int64)
    grams[:-1] = flat[:-1].astype(np.int64) << 8 | flat[1:]
    grams[starts[1:] - 1] = -1
    return flat, starts, grams


def gram_order(vocabulary: DataFrame) -> np.ndarray:
    """Place of each bigram in the global order, rare ones first, then by code points; and its number, by bigram.

    Bigrams are of 90 characters, so the driver gets 8100 rows at most, whatever the size of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = _flat(batch.column("word").to_pylist())[2]
            counts = np.bincount(grams[grams >= 0], minlength=1)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["gram", "n"])

    out = np.zeros((2, 1 << 16), np.int64)
    rows = vocabulary.select("word").mapInArrow(run, GRAMS).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    for place, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"]))):
        out[:, r["gram"]] = place, r["n"]
    return out


def pivots(places: list[int], costs: list[int], k: int = 2) -> tuple[int, ...]:
    """The ``k`` places, each two or more apart, whose costs sum to the least; ``places`` ascend.

    Dynamic programming over places: the best choice of j places that ends at or before a place follows from the best of
    j - 1 that ends two or more before it. Ties go to the first found.
    """
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] * (len(places) + 1)
    for _ in range(k):
        now: list[tuple[int, tuple[int, ...]] | None] = [None]
        before = 0
        for i, (place, cost) in enumerate(zip(places, costs)):
            while places[before] <= place - 2:
                before += 1
            way = best[before]
            found = (way[0] + cost, (*way[1], place)) if way is not None else None
            now.append(found if now[-1] is None or (found is not None and found[0] < now[-1][0]) else now[-1])
        best = now
    if best[-1] is None:
        raise ValueError(f"no {k} places are apart from each other")
    return best[-1][1]


def _keys(flat: np.ndarray, starts: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which the bigrams at ``at`` of the words ``word`` meet, and whose they are (indices of ``at``).

    A key holds a side, and all characters from the word's end on that side to the bigram's other end. Where these are
    ``SHORT`` or fewer, the key also holds one half of the rest, which has the edit in its other half: with b characters
    in the shorter rest, either the first b // 2 or the last b - b // 2 agree.
    """
    with np.errstate(over="ignore"):
        local = (np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.uint64)
        size = int(local.max()) + 2 if len(flat) else 1
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE))])
        inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64))))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[local])])
        begin, end = starts[word], starts[word + 1]

        def part(lo: np.ndarray, hi: np.ndarray, begin: np.ndarray) -> np.ndarray:
            h = (sums[hi] - sums[lo]) * inverse[lo - begin] ^ (hi - lo).astype(np.uint64)
            return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

        keys, owners = [], []
        for side, lo, hi, rest_lo, rest_hi in ((1, begin, at + 2, at + 2, end), (2, at, end, begin, at)):
            key = part(lo, hi, begin) + np.uint64(side)
            whole = np.flatnonzero(hi - lo > SHORT)
            keys.append(key[whole])
            owners.append(whole)
            for less in (0, 1):
                few = np.flatnonzero((hi - lo <= SHORT) & (rest_hi - rest_lo >= less))
                x, y, z = rest_lo[few], rest_hi[few], begin[few]
                b = y - x - less
                for half, h in ((3, part(x, x + b // 2, z)), (5, part(y - (b - b // 2), y, z))):
                    k = (key[few] ^ h * np.uint64(half)) + b.astype(np.uint64) * _BASE
                    keys.append((k ^ k >> np.uint64(31)) * np.uint64(0x94D049BB133111EB))
                    owners.append(few)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def index_rows(texts: list[str], counts: list[int], order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each key of each bigram of a word's prefix, and of its pivots: key, pivot, word, n and last, the place
    in the order at which its prefix ends. Bigrams equal to the third belong to the prefix, too, but no more than the
    first five: a pivot is one of the first three of its word, and an edit puts no more than two before it."""
    flat, starts, grams = _flat(texts)
    at = np.flatnonzero(grams >= 0)
    word = np.repeat(np.arange(len(texts)), np.diff(starts) - 1)
    rank = order[0, grams[at]]
    sort = np.lexsort((at, rank, word))
    third = np.concatenate([[0], np.cumsum(np.diff(starts) - 1)])[:-1] + PREFIX - 1
    last = rank[sort][third]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(word[sort]) != 0) | (np.diff(rank[sort]) != 0)])) if len(sort) else sort
    before = np.empty_like(sort)  # bigrams like it before it in its word
    before[sort] = np.arange(len(sort)) - np.repeat(first, np.diff(np.append(first, len(sort))))
    keep = (rank < last[word]) | ((rank == last[word]) & (before < PREFIX + 2))
    at, word, early = at[keep], word[keep], before[keep] < PREFIX
    ends = np.searchsorted(word[early], np.arange(len(texts) + 1)).tolist()
    places, costs, chosen = at[early].tolist(), order[1, grams[at[early]]].tolist(), []
    for a, b in zip(ends, ends[1:]):
        chosen += pivots(places[a:b], costs[a:b])
    chosen, owner = np.array(chosen, np.int64), np.repeat(np.arange(len(texts)), 2)
    (keys, a), (pivot_keys, b) = _keys(flat, starts, at, word), _keys(flat, starts, chosen, owner)
    whose = np.concatenate([word[a], owner[b]])
    pivot, names, n = np.arange(len(whose)) >= len(a), pa.array(texts, pa.string()), np.array(counts, np.int64)
    keys, ends = np.concatenate([keys, pivot_keys]), np.cumsum(np.diff(starts)[whose])
    at = 0
    while at < len(whose):  # few rows at once of very long words
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right")))
        own = whose[at:to]
        cols = [pa.array(keys[at:to]), pa.array(pivot[at:to]), names.take(pa.array(own)), pa.array(n[own]), pa.array(last[own], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "pivot", "word", "n", "last"])
        at = to


def one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose a and b differ by one edit, in time that grows with their length."""

    def near(a: str, b: str) -> bool:
        k = len(os.path.commonprefix((a, b)))
        return a != b and (a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:])

    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        yield batch.filter(pa.array([near(a, b) for a, b in pairs], pa.bool_()))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, b, na, nb: each two words of ``vocabulary`` (word, n) that differ by one edit, in both orders."""
    order = gram_order(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS):
                part = batch.slice(at, WORDS)
                yield from index_rows(part.column("word").to_pylist(), part.column("n").to_pylist(), order)

    index = written(vocabulary.select("word", "n").mapInArrow(run, INDEX), "pivots")

    def met(rows: DataFrame) -> DataFrame:
        of = lambda pivot, x: rows.where("pivot" if pivot else "not pivot").select("key", F.col("word").alias(x), F.col("n").alias(f"n{x}"), F.col("last").alias(f"last_{x}"), F.length("word").alias(f"len_{x}"))
        return of(True, "a").join(of(False, "b"), "key").where("last_a <= last_b and a <> b and abs(len_a - len_b) <= 1")

    # Spark's levenshtein takes time with the square of the length, so long words are compared from both ends instead.
    short, long = met(index).where(f"len_a <= {LONG}"), met(index.where(F.length("word") >= LONG)).where(f"len_a > {LONG}")
    near = short.where(F.levenshtein("a", "b", 1) == 1).unionByName(long.mapInArrow(one_edit, long.schema))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb")).distinct()
    near = written(near, "near")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) of each word lead to in the end.

    Each round doubles the steps taken. A form is ten times as frequent as its word, so counts of 64 bits allow for 19
    steps, and there are five rounds at most.
    """
    spark = forms.sparkSession
    now, path = put(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(5):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        nxt, p = put(now.join(far, "root", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_on")), "forms")
        discard(spark, path)
        now, path = nxt.select("word", "root"), p
        if not nxt.where("_on").limit(1).count():
            break
    return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``documents`` (doc_id, text).

    Repeated rows count as often as they stand there. An empty table has no rows; further columns are not read.
    """
    vocabulary = written(words(docs), "words")
    best = F.min(F.struct((-F.col("nb")).alias("minus"), F.col("b").alias("b")))
    tops = near_words(vocabulary).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    every = vocabulary.join(tops, "word", "left").withColumn("fits", -F.col("best.minus") >= FORM * F.col("n"))
    every = written(every.select("word", F.when(F.col("fits"), F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("best.minus")).alias("form_n")), "variants")
    found = roots(every.where("form is not null").select("word", "form"))
    return every.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
