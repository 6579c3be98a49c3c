"""Token ids as wavelet-matrix files: succinct bit planes with rank and select, read without decoding the rest.

A file holds the ids of a run of documents: a header, the documents' ids and offsets, then for each bit, highest
first, the plane of that bit in the order that the planes above leave (zeros before ones) and a rank directory with
the number of ones before each 512-bit block. Files are cells of a Parquet table in the shared folder, so that any
store that Spark reaches can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from fieldspark.llm import tokens
from fieldspark.llm.common import shared_dir

#: Bytes of text in a file, about.
FILE_BYTES = 8_000_000
#: Distinct units that a worker remembers, and bytes of text encoded at once: an executor has a worker for each core.
MEMORY, SLICE = 500_000, 2_000_000
#: Fixed values of the file format.
MAGIC, HEAD, BLOCK = b"WVMX", struct.Struct("<4sHHQQ"), 512
FILES = "part int, file int, n_docs long, n_tokens long, payload binary"
ROWS = "part int, file int, doc_id long, local_start long, n_tokens long, ids_crc32 long, local_end long, ends_within long"


def pack(ids: np.ndarray, offsets: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of ``ids``; document k has ids ``offsets[k]`` to ``offsets[k + 1]``. Empty inputs make an empty file."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out = [
        HEAD.pack(MAGIC, 1, bits, n, len(doc_ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(offsets, "<u8").tobytes(),
    ]
    for b in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << b)).astype(bool)
        plane = np.packbits(ones, bitorder="little")
        plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        out += [np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes(), plane.tobytes()]
        now = np.concatenate([now[~ones], now[ones]])
    return b"".join(out)


class WaveletMatrix:
    """A file opened for access, counting, occurrence lookup or full decoding."""

    def __init__(self, payload: bytes) -> None:
        magic, _, self.bits, self.n, docs = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        at = HEAD.size
        ids = np.frombuffer(payload, "<i8", docs, at)
        at += 8 * docs
        null = np.frombuffer(payload, np.uint8, docs, at)
        at += docs
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.offsets = np.frombuffer(payload, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        blocks = -(-self.n // BLOCK)
        self.ranks, self.planes = [], []
        for _ in range(self.bits):
            self.ranks.append(np.frombuffer(payload, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
            self.planes.append(np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8].copy()
        if rest % 8:
            part[-1] &= (1 << rest % 8) - 1
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place ``i``."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        cell = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(cell == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._nth(level, bit, i - self.zeros[level] if bit else i)
        return i

    def rank_many(self, token: int, places: np.ndarray) -> np.ndarray:
        """``rank`` of many places at once."""
        lo, hi = 0, places.astype(np.int64)
        if token >> self.bits:
            return np.zeros(len(hi), np.int64)
        for level in range(self.bits):
            words = np.append(self.planes[level].view("<u8"), np.uint64(0))
            word, rest = hi >> 6, (hi & 63).astype(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))
            a = self._ones(level, lo)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + ones) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - ones)
        return hi - lo

    def select_many(self, token: int, ks: np.ndarray) -> np.ndarray:
        """``select`` of many occurrences at once, all of which must be there."""
        lo, hi = self._range(token, self.n)
        if len(ks) and not (0 <= ks.min() and ks.max() < hi - lo):
            raise IndexError(int(ks.max()))
        i = lo + ks.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            cells = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            i = np.flatnonzero(cells == bit)[i - self.zeros[level] if bit else i]
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[~ones] = now[: self.zeros[level]]
            up[ones] = now[self.zeros[level] :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = up
        return now


def encoded(coder: tokens.UnitEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``coder.encode`` of all texts, about ``SLICE`` bytes at once."""
    parts = [coder.encode(texts.slice(at, size)) for at, size in tokens.slices(texts, SLICE)]
    ends = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *(offsets[1:] + base for base, (_, offsets) in zip(ends, parts))])


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encodes ``docs`` (doc_id, text) and writes their files in order of doc_id, nulls first, to a table at ``path``.

    Rows with one doc_id follow each other by a hash of the text. Each part covers a range of doc_id; each of its
    files takes about 8 MB of text, or one longer text. A null text is empty, so it has the end id alone.
    """

    file_bytes = FILE_BYTES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k = tokens.encoder(tokenizer, MEMORY), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at, size in tokens.slices(texts, file_bytes):
                flat, offsets = encoded(coder, texts.slice(at, size))
                payload = pack(flat, offsets, ids[at : at + size])
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([k], pa.int32()), "n_docs": [size], "n_tokens": [len(flat)], "payload": pa.array([payload], pa.binary())})
                k += 1

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(encode, FILES).write.option("compression", "zstd").parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """One row for each document in the files: part, file, doc_id, local_start, n_tokens and, decoded, ids_crc32. The end id
    may occur within texts, too: by rank, ends_within, how often it does in this one, and which occurrence is the end of
    the document; by select, local_end, where that is in the file."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "payload"))):
                matrix = WaveletMatrix(payload)
                raw, ends = memoryview(matrix.decode().astype("<u4")).cast("B"), (matrix.offsets * 4).tolist()
                n = len(matrix.doc_ids)
                marks = matrix.rank_many(tokens.END, matrix.offsets)
                last = matrix.select_many(tokens.END, marks[1:] - 1)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int32()), "file": pa.array([file] * n, pa.int32()), "doc_id": pa.array(matrix.doc_ids, pa.int64()),
                    "local_start": matrix.offsets[:-1], "n_tokens": np.diff(matrix.offsets), "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                    "local_end": last, "ends_within": np.diff(marks) - 1,
                })

    return files.select("part", "file", "payload").mapInArrow(decode, ROWS)


def file_starts(files: DataFrame) -> DataFrame:
    """part, file, base: ids in all files before. Sums by part come first, so the one task of the last window gets a row
    for each part, of which there are as many as shuffle partitions."""
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("part", "file", inner.alias("inner")).join(parts, "part").select("part", "file", (F.col("before") + F.col("inner")).alias("base"))


def token_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digest of ``documents`` from their files: doc_id, start, n_tokens, ids_crc32, end (the place of its end id among all
    ids, by rank and select) and inner_ends (how often the end id occurs in its text, by rank). An empty table gives no
    rows."""
    spark = docs.sparkSession
    path = shared_dir(spark, "wavelet")
    write_tokens(docs, tokenizer, path)
    files = spark.read.schema(FILES).parquet(path)
    return read_tokens(files).join(file_starts(files.drop("payload")), ["part", "file"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32",
        (F.col("base") + F.col("local_end")).alias("end"), F.col("ends_within").alias("inner_ends"),
    )
