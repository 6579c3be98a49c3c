"""GIF media column: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``encode`` stores rows of 64 samples as frames of at most 1024 rows in a palette of 256 colours; rows that the frame before
has in the same place are transparent, and before a lower last frame the screen is cleared. ``frames`` reads any GIF 87a
or 89a, and ``shown`` composes what each frame shows. Stored media have their timing and the colour histograms of all that they show
as columns; ``timed_frames`` gives both for every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import shared_dir

#: Samples in a row, rows in a frame, hundredths of a second that each frame shows.
WIDTH, ROWS, DELAY = 64, 1024, 10
#: Codes between two clear codes: then the last free entry of the 4096 has been made.
RUN = 3838
#: Width of the j-th code after a clear code, for 8-bit samples: entry 257 + j is made when it is read.
_WIDTHS = np.minimum(12, np.concatenate([[9], np.array([(257 + j).bit_length() for j in range(1, 8192)])]))
#: The palette: red is the sample, green what it lacks, blue its Gray code. No UTF-8 text has the transparent sample.
_PALETTE = np.stack([(c := np.arange(256)), 255 - c, c ^ c >> 1], 1).astype(np.uint8)
CLEAR = 255
#: Most samples of a screen or frame that is read, and how many a byte of the file can stand for at most: codes of three
#: bits or more, of at most 4096 samples each. What claims more is damaged, and reading ends there.
LARGEST, PER_BYTE = 1 << 26, 4096 * 8 // 3
BINS = 16
MEDIA = "doc_id long, n_bytes long, payload_bytes long, media binary, n_frames long, duration_cs long, red array<long>, green array<long>, blue array<long>"
FRAMES = "doc_id long, frame long, start_cs long, delay_cs long, shown_pixels long, red array<long>, green array<long>, blue array<long>"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _codes(samples: bytes) -> np.ndarray:
    """LZW codes of 8-bit samples, with a clear code (256) first and after every ``RUN`` codes, and the end code 257."""
    out = [256]
    add, table, free, stop = out.append, {}, 258, 258 + RUN - 1
    get, cur = table.get, samples[0]
    for b in samples[1:]:
        if (code := get(key := cur << 8 | b)) is None:
            add(cur)
            if free == stop:
                add(256)
                table.clear()
                free = 258
            else:
                table[key] = free
                free += 1
            cur = b
        else:
            cur = code
    add(cur)
    add(257)
    return np.array(out, np.int64)


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bits of each code of ``_codes``: 9 for the first, then by its place after the last clear code."""
    clear = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - np.repeat(clear, np.diff(np.append(clear, len(codes)))) - 1
    since[clear[1:]] = clear[1:] - clear[:-1] - 1  # a clear code still has the width of its place
    since[0] = 0
    return _WIDTHS[since]


_MASKS = np.arange(16) < np.arange(13)[:, None]


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(bits[_MASKS[widths]], bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([min(255, len(data) - i)]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes) -> bytes:
    """A looping GIF 89a of ``payload``, whose length is a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(rows), ROWS), 0xF7, 0, 0), _PALETTE.tobytes()]
    sparse = len(rows) > ROWS and CLEAR not in payload
    before = None
    for top in range(0, len(rows), ROWS):
        part = rows[top : top + ROWS]
        rest = len(rows) - top - len(part)
        disposal = 2 if 0 < rest < ROWS else 1
        again = (part == before).all(1) if sparse and before is not None else np.zeros(0, bool)
        drawn = np.where(again[:, None], np.uint8(CLEAR), part) if again.any() else part
        codes = _codes(drawn.tobytes())
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | bool(again.any()), DELAY, CLEAR, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part), 0), b"\x08", _blocks(_pack(codes, _widths(codes)))]
        before = part if disposal == 1 else None
    return b"".join([*out, b";"])


def _chased(up: np.ndarray) -> np.ndarray:
    """Where each place ends by following ``up``, in which ends point to themselves; doubles the stride each time."""
    while True:
        on = up[up]
        if (on == up).all():
            return up
        up = on


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes, which must start with a sample.

    Entry ``clear + 2 + k`` of the table is phrase k and the first sample of the next one: the output from phrase k's
    start on, one sample more than the phrase has. So every phrase is a copy of earlier output, its length one more
    than that of the phrase it continues, and all lengths, then all samples, follow by chasing those references. A code
    whose entry isn't made yet stands for the phrase before and its first sample.
    """
    n = len(codes)
    place = np.arange(n)
    literal = codes < clear
    back = np.where(literal, place, np.minimum(codes - clear - 2, place - 1))
    up, steps = back, (~literal).astype(np.int64)  # to the literal that a phrase goes back to
    while steps[up].any():
        steps, up = steps + steps[up], up[up]
    size = steps + 1
    start = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(start[-1]) + np.repeat(start[back] - start[:-1], size)
    values = np.zeros(start[-1], np.uint8)
    values[start[:-1][literal]] = codes[literal]
    return values[_chased(source)]


def lzw_decode(data: bytes, least: int, most: int) -> np.ndarray:
    """Up to ``most`` samples of a GIF code stream with ``least``-bit samples; stops at the end code or the data's end,
    and at a code that can't be: the first after a clear code when it is no sample. Sample sizes other than 1 to 8 bits
    give none.

    Between two clear codes the width of each code follows from its place alone, so a run's codes are cut out at once.
    """
    if not 1 <= least <= 8:
        return np.zeros(0, np.uint8)
    clear, end = 1 << least, (1 << least) + 1
    widths = _WIDTHS if least == 8 else np.minimum(12, np.concatenate([[least + 1], np.array([(clear + 1 + j).bit_length() for j in range(1, 8192)])]))
    buf = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out: list[np.ndarray] = []
    at, total, got = 0, 8 * len(data), 0
    while got < most and at + least + 1 <= total:
        ends = at + np.cumsum(widths[: min(len(widths), (total - at) // (least + 1) + 1)])
        while ends[-1] < total and len(ends) < total:  # no clear code for long: 12 bits each from here on
            ends = np.concatenate([ends, ends[-1] + 12 * np.arange(1, len(ends) + 1)])
        n = int(np.searchsorted(ends, total, "right"))
        starts = np.concatenate([[at], ends[: n - 1]]) if n else np.zeros(0, np.int64)
        size = ends[:n] - starts
        i = starts >> 3
        codes = (buf[i] | buf[i + 1] << 8 | buf[i + 2] << 16) >> (starts & 7) & ((1 << size) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stops[0]) if len(stops) else n
        if k:
            if codes[0] > end:
                break
            out.append(_expanded(codes[:k], clear))
            got += len(out[-1])
        if k == n or codes[k] == end:
            break
        at = int(ends[k])
    return np.concatenate(out)[:most] if out else np.zeros(0, np.uint8)


@dataclass
class Frame:
    indices: np.ndarray  #: palette indices, rows by columns, in the frame's own rectangle
    left: int
    top: int
    delay_cs: int
    disposal: int  #: 2: the rectangle is cleared afterwards, 3: what was there before comes back
    clear: int  #: the index that is not drawn, or -1
    colours: np.ndarray  #: 256 by RGB


def frames(data: bytes) -> list[Frame]:
    """The frames of a GIF in order.

    Interlaced rows are put in order, missing samples are 0, a sample beyond the palette is black. A file cut short
    gives the frames whose image data has begun, the last one with what there is of it; nothing but another signature
    is refused.
    """
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    if len(data) < 13:
        return []
    flags, at = data[10], 13

    def palette(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 * (2 << (flags & 7))
        raw = data[at : at + n]
        return np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3), at + n

    def body(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    common, at = palette(flags, at)
    out: list[Frame] = []
    disposal, delay, clear = 0, 0, -1
    while at + 1 < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label, (block, at) = data[at + 1], body(at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay, clear = block[0] >> 2 & 7, block[1] | block[2] << 8, block[3] if block[0] & 1 else -1
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = palette(local, at + 10)
        if at >= len(data):
            break
        least = data[at]
        stream, at = body(at + 1)
        if w * h > min(LARGEST, PER_BYTE * len(data)):
            break
        flat = np.zeros(w * h, np.uint8)
        got = lzw_decode(stream, least, w * h)
        flat[: len(got)] = got
        indices = flat.reshape(h, w)
        if local & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        colours = np.zeros((256, 3), np.uint8)
        table = own if own is not None else common
        if table is not None:
            colours[: len(table)] = table
        out.append(Frame(indices, left, top, delay, disposal, clear, colours))
        disposal, delay, clear = 0, 0, -1
    return out


def shown(data: bytes, read: list[Frame] | None = None) -> Iterator[np.ndarray]:
    """The screen (rows by columns by RGBA) as each frame shows it: transparent samples keep what is there, and the
    frame before is disposed of first. Parts of a frame beyond the screen are cut off. ``read``: the frames, if at hand.
    A screen is only valid until the next one is asked for."""
    if len(data) < 13:
        return
    width, height = struct.unpack_from("<HH", data, 6)
    if width * height > min(LARGEST, PER_BYTE * len(data)):
        return
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames(data) if read is None else read:
        place = np.s_[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]
        part = canvas[place]
        before = part.copy() if f.disposal == 3 else None
        indices = f.indices[: part.shape[0], : part.shape[1]]
        drawn = np.concatenate([f.colours, np.full((256, 1), 255, np.uint8)], 1)[indices]
        if f.clear >= 0:
            drawn = np.where((indices != f.clear)[..., None], drawn, part)
        part[...] = drawn
        yield canvas
        if f.disposal == 2:
            part[...] = 0
        elif f.disposal == 3:
            part[...] = before


def histograms(screen: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels of a screen that anything was drawn on, by red, green and blue in equal bins: a row each."""
    flat = screen.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    channels = [np.ascontiguousarray(flat[:, c]) for c in range(3)]
    out: list[np.ndarray] = []
    for c, values in enumerate(channels):
        same = next((k for k in range(c) if np.array_equal(channels[k], values)), None)  # grey
        out.append(np.bincount(values, minlength=256).reshape(bins, -1).sum(1) if same is None else out[same])
    return np.array(out, np.int64)


def described(data: bytes, read: list[Frame] | None = None) -> tuple[int, int, np.ndarray]:
    """Frames, hundredths of a second that they take, and the histograms of all that they show, summed."""
    read = frames(data) if read is None else read
    total = np.zeros((3, BINS), np.int64)
    for screen in shown(data, read):
        total += histograms(screen)
    return len(read), sum(f.delay_cs for f in read), total


def samples(of: list[Frame]) -> bytes:
    """The bytes that ``encode`` stored: the red of each sample's colour, frame by frame, that of the frame before where it
    is transparent."""
    out, before = [], None
    for f in of:
        red = f.colours[:, 0][f.indices]
        if f.clear >= 0:
            red = np.where(f.indices == f.clear, before[: len(red)], red)
        out.append(red.tobytes())
        before = red
    return b"".join(out)


def store(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with their texts' bytes as GIF and what these show: doc_id, n_bytes, payload_bytes, media,
    n_frames, duration_cs, and red, green and blue, the colour histograms over all frames. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                raw = [t or b"" for t in part.column("body").to_pylist()]
                padded = [t + b"\0" * (-len(t) % WIDTH or WIDTH * (not t)) for t in raw]
                n = [-(-len(t) // (WIDTH * ROWS)) for t in padded]
                red, green, blue = (pa.array(h.tolist(), pa.list_(pa.int64())) for h in np.array([_shown(t) for t in padded]).reshape(-1, 3, BINS).swapaxes(0, 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(map(len, raw), pa.int64()), "payload_bytes": pa.array(map(len, padded), pa.int64()), "media": pa.array(map(encode, padded), pa.binary()),
                    "n_frames": pa.array(n, pa.int64()), "duration_cs": pa.array([DELAY * k for k in n], pa.int64()), "red": red, "green": green, "blue": blue,
                })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("body")).mapInArrow(run, MEDIA)


def _shown(payload: bytes) -> np.ndarray:
    """What ``described`` finds in ``encode(payload)``, from the payload: every row is shown once, by its own frame alone."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    out = np.zeros((3, BINS), np.int64)
    for c in range(3):
        np.add.at(out[c], _PALETTE[:, c] // (256 // BINS), counts)
    return out


def timed_frames(media: DataFrame) -> DataFrame:
    """A row for each frame of the GIFs in ``media`` (doc_id, media): frame (from 0), start_cs, delay_cs, shown_pixels and
    the colour histograms of the screen that it shows. Null media, and screens of more samples than ``LARGEST`` or than the file can hold, have no frames; other
    files than GIFs are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
        names = [c.split()[0] for c in FRAMES.split(", ")]
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                data = data.as_py() or b""
                read, start, rows = frames(data) if data else [], 0, []
                for k, (f, screen) in enumerate(zip(read, shown(data, read))):
                    h = histograms(screen)
                    rows.append((doc, k, start, f.delay_cs, int(h[0].sum()), *h.tolist()))
                    start += f.delay_cs
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, FRAMES)


def digest(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: payload and media digests and a feature of frames, time and the histograms
    of what they show. Media that don't show what their columns say are refused as damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, size, data, *said in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "payload_bytes", "media", "n_frames", "duration_cs", "red", "green", "blue"))):
                read = frames(data)
                body = samples(read)
                count, time, shows = described(data, read)
                if [count, time, *shows.tolist()] != said or len(body) != size:
                    raise ValueError(f"damaged media of doc_id {doc}")
                feature = f"frames={count};centiseconds={time};" + ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip(("red", "green", "blue"), shows.tolist()))
                rows.append((doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)


def gif_documents(docs: DataFrame) -> DataFrame:
    """Digest of ``documents``: each text stored as GIF in the shared folder, read back and described.

    Null and empty texts are one row of 64 zero bytes; equal texts have equal values; an empty table has no rows.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "gif")
    store(docs).write.parquet(path)
    return digest(spark.read.schema(MEDIA).parquet(path))
