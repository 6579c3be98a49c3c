"""Jaccard self-join on word n-grams by vertical partitioning.

1. Every text becomes its set of hashed n-grams; texts with equal sets are one node, named by a 16-byte digest. Texts go
   on in blocks; within a block a node goes by its place. Of equal sets in several blocks the first block's goes on.
2. By hash of the n-gram, frequencies are counted, and those that occur in two nodes or more get their place in the
   global order: rare ones first, by class of frequency, then by hash. n-grams of a single node come before all others
   and need no place, as they match nothing.
3. The order is cut into fragments, ranges with about equal numbers of entries, and every node's n-grams with it: one
   row for each node and fragment.
4. Two nodes can only reach the threshold if they share one of the first ``shared - least overlap + 1`` of their shared
   n-grams. Nodes that meet there are tried first with one partner each, then all pairs that can still reach the
   threshold and are not connected yet. A pair's overlap is counted in each fragment by itself, from that fragment's
   rows, and these partial counts are summed for each pair.

n-grams are compared by 56 bits of a hash: the chance that this changes the overlap of a pair of documents is that of a
collision among their own n-grams, below 1e-10 for 1000 of each. Nodes that share an n-gram are taken for copies by 48
bits of their digests; then the whole digests are compared, and if any node was taken for a copy of another set, all is
done again with other bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldspark.llm.common import components, discard, lean_worker, put, written
from fieldspark.llm.tokens import slices

#: Words in an n-gram, and the least Jaccard similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Bytes of text behind one fragment, and of a block of texts, about; most documents in a block; from how many nodes of a block an n-gram is common.
FRAGMENT_BYTES, BLOCK_BYTES, BLOCK_DOCS, COMMON = 16_000_000, 5_000_000, 60_000, 64
#: Fragments of the global order by which overlaps are counted, and rounds with one partner for each node.
PARTS, STAR_ROUNDS = 4, 2
#: Logarithmic width of the classes of size in which all pairs of a place are sought.
BAND = 0.05
_HEAD = struct.Struct("<IIII")
_NONE = np.zeros(0, np.uint64)
#: Rows for a fragment (kind 0, id) with n-grams of a block, or for a block (kind 1, id).
BLOBS = "kind int, id long, block long, blob binary"
NODES = "sig binary, n int, shared int, first array<long>, keys array<long>, follows boolean"
#: Bytes of a node's digest by which copies are known, one pair after the other is tried.
TAGS = ((0, 6), (6, 12), (10, 16))
#: Bytes of text up to which fragments and blocks have their sizes; beyond they grow with the square root, to four times.
GROWTH_BYTES, GROWTH = 64_000_000_000, 4
SEGMENTS = "part int, sig binary, n int, keys array<long>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams, A-Z in lower case, words parted by ASCII white space.

    A text of fewer words has its whole sequence as one n-gram; one without words, or null, has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])))
    found = lists.flatten().dictionary_encode()
    unique = found.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique))
    codes = np.asarray(found.indices)
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    if "" in unique:
        real = codes != unique.index("")
        codes, owner = codes[real], owner[real]
    h = hashes[codes]
    counts = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(grams)]
        grams = _mixed(grams)
        out, at = [], 0
        for n in counts.tolist():
            if n >= words:
                out.append(np.unique(grams[at : at + n - words + 1]))
            elif n:
                short = np.uint64(n)
                for x in h[at : at + n]:
                    short = short * np.uint64(0x9E3779B97F4A7C15) + x
                out.append(_mixed(np.array([short], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def signature(grams: np.ndarray) -> bytes | None:
    """128-bit digest of a set; none for the empty set."""
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, sig for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in slices(batch.column("text"), BLOCK_BYTES):
                sets = shingle_sets(batch.column("text").slice(at, size), words)
                out = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, size), "n_shingles": pa.array(map(len, sets), pa.int64()), "sig": pa.array(map(signature, sets), pa.binary())})
                del sets
                lean_worker()
                yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, sig binary")


def _blob(keys: np.ndarray, refs: np.ndarray, tags: np.ndarray | None = None, marked: np.ndarray = _NONE, table: bytes = b"", part: tuple[int, int] = TAGS[0]) -> bytes:
    """Keys by byte planes, the places of their nodes in the block, these nodes' tags where a fragment needs them, marked
    keys, and the records of a block's nodes."""
    planes = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T)
    used, place = (np.unique(refs, return_inverse=True) if tags is not None else (np.zeros(0, np.int64), refs))
    own = b"" if tags is None else used.astype("<u2").tobytes() + np.ascontiguousarray(tags[used, slice(*part)]).tobytes()
    return b"".join([_HEAD.pack(len(keys), len(used), len(marked), len(table) // 20), planes.tobytes(), place.astype("<u2").tobytes(), own, marked.tobytes(), table])


def _opened(blobs: list[bytes], wide_tags: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Keys, whose they are (place of the blob times 65536, and the node's place in the block), these nodes' tags, marked
    keys, and records."""
    keys, whose, tags, marked, table = [_NONE], [np.zeros(0, np.int64)], [_NONE], [_NONE], []
    for k, blob in enumerate(blobs):
        n, m, c, t = _HEAD.unpack_from(blob)
        at = _HEAD.size
        keys.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel())
        at += 8 * n
        place = np.frombuffer(blob, "<u2", n, at)
        at += 2 * n
        if m:
            used = np.frombuffer(blob, "<u2", m, at)
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :wide_tags] = np.frombuffer(blob, np.uint8, wide_tags * m, at + 2 * m).reshape(m, wide_tags)
            tags.append(wide.view(np.uint64).ravel()[place])
            place = used[place]
            at += (2 + wide_tags) * m
        whose.append(place.astype(np.int64) | k << 16)
        marked.append(np.frombuffer(blob, np.uint64, c, at))
        at += 8 * c
        table.append(blob[at : at + 20 * t])
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(tags), np.concatenate(marked), b"".join(table)


_TOP = np.uint64(0xFF) << np.uint64(56)


def shared_grams(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, str]:
    """Written nodes that may have links, and their table's path: sig, n, shared n-grams, first (places to meet in), keys (shared ones in order).

    A node that an n-gram names the first of equal sets, or that none says to follow another, has all its n-grams here.
    Equal sets all of whose n-grams are common in one of their blocks may come twice, with the same n-grams.

    A node left out as a copy must have its whole digest among the nodes that stay. If one has not, the tags of two
    different sets were equal, and all is done again with other tags.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for part in TAGS:
        nodes, path = put(_tagged_grams(docs, total, words, percent, part), "nodes")
        lost = nodes.where("follows").select("sig").join(nodes.where("not follows").select("sig"), "sig", "left_anti").limit(1).count()
        if not lost:
            return nodes.where("shared > 0").drop("follows"), path
        discard(docs.sparkSession, path)
    raise RuntimeError("different sets have equal tags, whichever bytes are taken")


def _tagged_grams(docs: DataFrame, total: int, words: int, percent: int, part: tuple[int, int]) -> DataFrame:
    """Rows of ``NODES``: nodes that may have links; with ``shared`` 0 those that can't have any, and those that follow
    others."""
    growth = min(GROWTH, max(1.0, (total / GROWTH_BYTES) ** 0.5))
    fragments = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // int(FRAGMENT_BYTES * growth)))
    wide = part[1] - part[0]

    block_bytes, block_docs, common_from = int(BLOCK_BYTES * growth), BLOCK_DOCS, COMMON

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([(f << 56) // fragments for f in range(1, fragments)], np.uint64)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for whole, size in slices(batch.column("text"), block_bytes):
                for at in range(whole, whole + size, block_docs):
                    k = min(block_docs, whole + size - at)
                    sets = {signature(s): s for s in shingle_sets(batch.column("text").slice(at, k), words) if len(s)}
                    if not sets:
                        continue
                    sizes = np.array(list(map(len, sets.values())))
                    records = np.concatenate([np.frombuffer(b"".join(sets), np.uint8).reshape(-1, 16), sizes.astype("<u4").view(np.uint8).reshape(-1, 4)], 1)
                    keys, refs = np.concatenate(list(sets.values())) >> np.uint64(8), np.repeat(np.arange(len(sizes)), sizes)
                    order = np.argsort(keys)
                    keys, refs = keys[order], refs[order]
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    counts = np.diff(np.append(first, len(keys)))
                    common = np.repeat(counts > common_from, counts)
                    marked = keys[first[counts > common_from]]
                    rows = [(1, block, _blob(keys[common] | _TOP, refs[common], table=records.tobytes()))]  # common keys need no counting
                    keys, refs = keys[~common], refs[~common]
                    ends = [np.concatenate([[0], np.searchsorted(x, borders), [len(x)]]) for x in (keys, marked)]
                    for f in range(fragments):
                        (a, b), (c, d) = ((e[f], e[f + 1]) for e in ends)
                        if b > a or d > c:
                            rows.append((0, f, _blob(keys[a:b], refs[a:b], records, marked[c:d], part=part)))
                    kinds, ids, blobs = zip(*rows)
                    out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ids, pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "id", "block", "blob"])
                    block += 1
                    del sets, sizes, records, keys, refs, order, first, counts, common, rows, blobs
                    lean_worker()
                    yield out

    def order_fragment(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py():
            return group
        lean_worker()
        group = group.sort_by("block")
        blocks = group.column("block").to_pylist()
        keys, whose, tags, marked, _ = _opened(group.column("blob").to_pylist(), wide)
        order = np.lexsort((whose, tags, keys))
        keys, whose, tags = keys[order], whose[order], tags[order]
        # Of nodes with one tag the first block's stays; the others are left out and said to follow it.
        again = np.zeros(len(keys), bool)
        again[1:] = (keys[1:] == keys[:-1]) & (tags[1:] == tags[:-1])
        follow = np.unique(whose[again])
        keys, whose = keys[~again], whose[~again]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        kind = np.minimum(254, np.log2(np.maximum(counts, 1)) * 8).astype(np.uint64)
        kind[np.isin(keys[first], marked)] = 255
        keep, kind = np.repeat((counts > 1) | (kind == 255), counts), np.repeat(kind, counts)
        keys, whose = keys[keep] | kind[keep] << np.uint64(56), whose[keep]
        order = np.argsort(whose >> 16, kind="stable")
        keys, whose = keys[order], whose[order]
        ends, gone = (np.searchsorted(v >> 16, np.arange(len(blocks) + 1)) for v in (whose, follow))
        rows = []
        for k, block in enumerate(blocks):
            (a, b), (c, d) = ends[k : k + 2], gone[k : k + 2]
            if b > a or d > c:
                rows.append((block, _blob(keys[a:b], whose[a:b] & 0xFFFF, marked=(follow[c:d] & 0xFFFF).astype(np.uint64))))
        ids = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({"kind": pa.array([1] * len(rows), pa.int32()), "id": ids, "block": ids, "blob": pa.array([r[1] for r in rows], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        lean_worker()
        keys, refs, _, follow, table = _opened(group.column("blob").to_pylist())
        refs, follow = refs & 0xFFFF, set(follow.tolist())
        order = np.lexsort((keys, refs))
        keys, refs = keys[order].view(np.int64), refs[order]
        ends = np.searchsorted(refs, np.arange(len(table) // 20 + 1))
        rows = []
        for i in range(len(table) // 20):
            own, node = keys[ends[i] : ends[i + 1]], table[20 * i : 20 * i + 16]
            n = int.from_bytes(table[20 * i + 16 : 20 * i + 20], "little")
            least = (percent * n + 99) // 100
            if i in follow or len(own) < least:
                rows.append((node, n, 0, None, None, i in follow))
            else:
                rows.append((node, n, len(own), own[: len(own) - least + 1], own, False))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sig", "n", "shared", "first", "keys", "follows"])

    blobs = docs.select("text").mapInArrow(cut, BLOBS)
    return blobs.groupBy("kind", "id").applyInArrow(order_fragment, BLOBS).groupBy("id").applyInArrow(gather, NODES)


def borders(nodes: DataFrame, parts: int = PARTS) -> list[int]:
    """Where the global order is cut: the first keys of all fragments but the first, so that about equally many entries
    lie in each. Counted over all entries by the highest 12 bits of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4096, np.int64)
        for batch in batches:
            keys = np.asarray(batch.column("keys").flatten()).view(np.uint64)
            total += np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=4096)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    total = np.zeros(4096, np.int64)
    for r in nodes.select("keys").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        total[r["at"]] = r["n"]
    ends = np.cumsum(total)
    cuts = np.searchsorted(ends, [ends[-1] * k / parts for k in range(1, parts)]) + 1
    return [int(c) << 52 for c in cuts.tolist() if c < 4096]


def segments(nodes: DataFrame, cuts: list[int]) -> DataFrame:
    """part, sig, n, keys: each node's part of each fragment of the order that it has n-grams in."""
    edges = np.array(cuts, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(lists)))
            part = np.searchsorted(edges, np.asarray(flat).view(np.uint64), "right")
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])) if len(flat) else np.zeros(0, np.int64)
            own = pa.array(owner[first])
            keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), batch.column("sig").take(own), batch.column("n").take(own), keys], names=["part", "sig", "n", "keys"])

    return nodes.select("sig", "n", "keys").mapInArrow(run, SEGMENTS)


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The columns of ``pairs`` (a, b, ...; each pair once) with their sets' sizes na, nb and overlap o; pairs without a
    common n-gram are left out. Each fragment counts its part of the overlap, and the parts are summed for each pair."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    right = parts.select("part", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    left = parts.select("part", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    partial = pairs.join(right, "b").join(left, ["a", "part"]).select("a", "b", *more, "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("o"))
    return partial.where("o > 0").groupBy("a", "b", "na", "nb", *more).agg(F.sum("o").alias("o"))


def linked(pairs: DataFrame, parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    return overlaps(pairs, parts).where(F.expr(f"100 * o >= {percent} * (na + nb - o)"))


def _wider(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after ``links`` (c, d) between the components of ``found``, or nodes that have none yet."""
    new = components(links.select(F.col("c").alias("a"), F.col("d").alias("b")))
    if found is None:
        return written(new, "components")
    new = written(new, "joined")
    moved = found.join(new.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return written(moved.unionByName(new.join(found, "node", "left_anti")), "components")


def _meetings(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b (c, d: their components), each once, of nodes that meet in a place and may reach the threshold.

    With ``left`` shared n-grams from the place on, a partner of size m needs ``left >= percent / (100 + percent) *
    (n + m)``, so m is at most ``cap``; and the smaller set has ``percent`` / 100 of the larger one's size at least. The
    larger node looks for the smaller one in the classes of size between these bounds, so that nodes whose bounds don't
    meet are never paired, however many meet in the place.
    """
    band = lambda size: F.floor(F.ln(size.cast("double")) / BAND).cast("int")
    cap = F.floor(F.col("left") * F.lit((100 + percent) / percent) + 1e-6) - F.col("n")
    rows = open_.withColumn("cap", cap).withColumn("low", F.ceil(F.col("n") * percent / 100 - 1e-6)).where("cap >= low")
    small = rows.where("cap >= n").select("k", band(F.col("n")).alias("band"), F.col("sig").alias("s"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("cap").alias("cap_s"))
    large = rows.select("k", "sig", "n", "c", "cap", "low", F.explode(F.sequence(band(F.col("low")), band(F.least("cap", "n")))).alias("band"))
    met = large.join(small, ["k", "band"]).where((F.col("c") != F.col("d")) & (F.col("m") >= F.col("low")) & (F.col("m") <= F.col("cap")) & (F.col("n") <= F.col("cap_s")))
    met = met.where((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("s") < F.col("sig"))))
    return met.select(F.col("sig").alias("a"), F.col("s").alias("b"), "c", "d").distinct()


def node_components(nodes: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, spent: str | None = None) -> DataFrame:
    """node, component (digests) of all nodes of ``shared_grams`` that have links. The nodes' table at ``spent`` is deleted as
    soon as it isn't needed any more.

    In a round, the nodes that meet in a place and are not connected to one of them, its partner in turn, are compared
    with a partner: first the node with the fewest n-grams of its own, which is closest to the others, then others by
    hash. Each node takes the partner that it meets most often. The last round compares what is left, all pairs. Each
    round's links go between the components found before, so components are never sought anew.
    """
    # From their first common place on, both nodes must have as many shared n-grams left as the pair's least overlap:
    # o >= percent / 100 * (n + m - o). ``left`` counts them, the place itself included.
    least = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    near = (F.col("left") >= least) & (F.col("left_m") >= least)
    spark = nodes.sparkSession
    if nodes.count() > nodes.select("sig").distinct().count():  # rare, see there
        nodes = nodes.dropDuplicates(["sig"])
    parts, parts_at = put(segments(nodes, borders(nodes)), "segments")
    entries = nodes.select("sig", "n", "shared", ((F.col("n") - F.col("shared")) / F.col("n")).alias("own"), F.posexplode("first").alias("i", "k"))
    entries, entries_at = put(entries.withColumn("left", F.col("shared") - F.col("i")).drop("i", "shared"), "entries")
    if spent:
        discard(spark, spent)
    found = None
    for k in range(star_rounds + 1):
        if found is None:
            own = entries.withColumn("c", F.col("sig"))
        else:
            own = entries.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component")
        order = F.col("own") if k == 0 else F.xxhash64(F.lit(k), "c")
        places = own.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(order.alias("o"), "own", "sig", "n", "c", "left")).alias("p")).where("lo < hi")
        if k < star_rounds:
            met = own.join(places.select("k", F.col("p.sig").alias("b"), F.col("p.n").alias("m"), F.col("p.c").alias("d"), F.col("p.left").alias("left_m")), "k").where((F.col("c") != F.col("d")) & near)
            tally = met.groupBy(F.col("sig").alias("a"), "b", "c", "d").agg(F.count(F.lit(1)).alias("t"))
            pairs = tally.groupBy("a").agg(F.max(F.struct("t", "b", "c", "d")).alias("x")).select("a", "x.b", "x.c", "x.d")
        else:
            pairs = _meetings(own.join(places.select("k"), "k", "left_semi"), percent)
        pairs, pairs_at = put(pairs, "pairs")
        found = _wider(found, linked(pairs, parts, percent).select("c", "d"))
        discard(spark, pairs_at)
    discard(spark, parts_at, entries_at)
    return found


def document_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Rows without words, and rows with a null id, link with nothing: their component is their own id (null for null).
    Repeated rows are equal sets like other copies. An empty table has no rows.
    """
    rows = written(document_sets(docs, words), "sets")
    nodes, path = shared_grams(docs.where("doc_id is not null"), words, percent)
    found = node_components(nodes, percent, spent=path)
    named = rows.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "sig")))
    # Written, so that the join deals its own sides, and can split a component that holds many rows.
    least = written(named.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "least")
    return named.join(least, "c", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; rows with null ids stay, as do repeated rows of
    a kept id."""
    gone = document_components(docs.select("doc_id", "text"), words, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
