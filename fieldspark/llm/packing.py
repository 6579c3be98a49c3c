"""Sum-of-squares packing of tokenised documents into sequences.

A piece goes where the sum of the squared counts of open sequences per residual gap becomes smallest: into an open
sequence of some gap, or into a new one. Pieces are packed in groups of tens of thousands by a hash, largest first;
what a round leaves open is taken out again and packed by the same rule in the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldspark.llm import tokens
from fieldspark.llm.common import lean_worker, written

#: Tokens in a sequence, pieces in a group on average, rounds of a group.
CAPACITY, GROUP_ROWS, ROUNDS = 1024, 40_000, 16
#: Distinct units that a worker remembers, and bytes of text at once: few, as packing may follow stages that have filled
#: the executor's heap.
MEMORY, SLICE = 200_000, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the rest."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), each with the crc32 of its ids; a null text is empty: its end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokens.holds(tokenizer):  # a worker's first task here: stages before have left their own
            lean_worker()
        coder, salt = tokens.encoder(tokenizer, MEMORY), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at, size in tokens.slices(texts, SLICE):
                flat, offsets = coder.encode(texts.slice(at, size))
                raw, ends = memoryview(flat.astype("<u4")).cast("B"), offsets.tolist()
                rows = []
                for doc, lo, hi in zip(ids[at : at + size], ends, ends[1:]):
                    rows += [(doc, k, s, n, zlib.crc32(raw[4 * (lo + s) : 4 * (lo + s + n)])) for k, (s, n) in enumerate(cut(hi - lo, capacity))]
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(range(salt, salt + len(rows)), pa.int64())], names=[c.split()[0] for c in PIECES.split(", ")])
                salt += len(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences, as lists of places in ``lengths``, by one pass of the rule in the given order; ties: smallest gap."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    count, out = np.zeros(capacity + 1, np.int64), []
    far = np.int64(1) << 40
    for i, s in enumerate(lengths):
        # What the sum changes by if a sequence of gap g, from s up, takes the piece: that gap loses one, g - s gains one.
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        if len(change):
            change[0] = 1 - 2 * count[s]
            change[count[s:capacity] == 0] = far
        k = int(change.argmin()) if len(change) else -1
        if k >= 0 and change[k] <= 2 * count[capacity - s] + 1 and change[k] < far:
            b = open_[s + k].pop()
            count[s + k] -= 1
            out[b].append(i)
            gap = k
        else:
            b, gap = len(out), capacity - s
            out.append([i])
        if gap:
            open_[gap].append(b)
            count[gap] += 1
    return out


def pack(lengths: list[int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[list[int]]:
    """Rounds of the rule, largest first; a round keeps sequences with at most 2 tokens a round before free."""
    todo = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    done: list[list[int]] = []
    for k in range(rounds):
        found = [[todo[i] for i in b] for b in sum_of_squares([lengths[i] for i in todo], capacity)]
        slack = capacity - (2 * k if k + 1 < rounds else capacity)
        full = [sum(lengths[i] for i in b) >= slack for b in found]
        done += [b for b, f in zip(found, full) if f]
        todo = sorted((i for b, f in zip(found, full) if not f for i in b), key=lambda i: (-lengths[i], i))
        if not todo:
            break
    return done


def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for ``pieces``; full pieces are sequences of their own. ``rows`` must be a written table."""
    groups = max(1, round(rows.count() / GROUP_ROWS))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("salt")
        lengths = group.column("length").to_pylist()
        key = group.column("group")[0].as_py()
        ids, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(pack(lengths, capacity)):
            used = 0
            for i in members:
                ids[i], at[i] = (key << 32) + k, used
                used += lengths[i]
        kept = group.drop_columns(["salt", "group"])
        return kept.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(at))

    keyed = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)))
    return keyed.groupBy("group").applyInArrow(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Digest of ``documents``: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed
    like others; an empty table has no rows."""
    return placed(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
