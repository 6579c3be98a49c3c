"""GIF round trips, decoding rules and damaged files."""

import hashlib

import numpy as np
import pytest

from fieldspark.llm import gif


def test_gif_round_trip():
    r = np.random.default_rng(1)
    for body in (b"\0" * 64, b"a" * 6400, b"ab" * 40_000, r.bytes(64 * 2500), bytes(range(256)) * 300):
        data = gif.encode(body)
        assert gif.samples(gif.frames(data)) == body
        assert (gif.described(data)[2] == gif._shown(body)).all()
        screens = [s.copy() for s in gif.shown(data)]
        assert len(screens) == -(-len(body) // (64 * 1024)) and screens[0][0, 0, 0] == body[0]


def test_stored_frames_use_transparency_disposal_and_colours():
    """Rows that the frame before has in the same place are transparent, a lower last frame stands alone, and the three
    histograms differ."""
    r = np.random.default_rng(2)
    first = r.integers(32, 127, (1024, 64)).astype(np.uint8)
    second = first.copy()
    second[::2] = r.integers(32, 127, (512, 64))
    last = first[:100]
    for frames, disposals, clear in (([first, second, last], [1, 2, 1], [False, True, False]), ([first, second], [1, 1], [False, True]), ([first, first], [1, 1], [False, True]), ([first, last], [2, 1], [False, False])):
        body = b"".join(f.tobytes() for f in frames)
        data = gif.encode(body)
        read = gif.frames(data)
        assert gif.samples(read) == body and [f.disposal for f in read] == disposals and [f.clear >= 0 for f in read] == clear
        assert (gif.described(data)[2] == gif._shown(body)).all() and len({tuple(h) for h in gif._shown(body).tolist()}) == 3
        screens = [s.copy() for s in gif.shown(data)]
        assert all((s[: len(f), :, 0] == f).all() for s, f in zip(screens, frames))
        if disposals[-2] == 2:
            assert not screens[-1][100:, :, 3].any()
    odd = np.concatenate([first, first])
    odd[0, 0] = 255  # then no sample is free to be transparent
    assert gif.samples(gif.frames(gif.encode(odd.tobytes()))) == odd.tobytes()


def test_sizes_that_no_file_can_fill_end_the_reading(spark):
    head = b"GIF89a" + b"\xff\xff\xff\xff" + b"\0\0\0"
    small = b"GIF89a" + b"\x01\0\x01\0" + b"\0\0\0"
    image = b"\x2c\0\0\0\0\xff\xff\xff\xff\0\x08\x01\0\0;"
    assert gif.frames(small + image) == [] and list(gif.shown(head + image)) == [] and gif.frames(head + image) == []
    media = spark.createDataFrame([(1, bytearray(head + image)), (2, bytearray(gif.encode(b"a" * 64))), (3, None)], "doc_id long, media binary")
    assert [r.doc_id for r in gif.timed_frames(media).collect()] == [2]


def test_gif_disposal_transparency_palette_and_interlace():
    def frame(left, top, w, h, pixels, flags=0, clear=None, disposal=0, delay=3):
        codes = gif._codes(bytes(pixels))
        return bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, 0, clear or 0, 0, 0x2C, left, 0, top, 0, w, 0, h, 0, flags]) + b"\x08" + gif._blocks(gif._pack(codes, gif._widths(codes)))

    head = b"GIF89a\x02\0\x02\0\xf7\0\0" + bytes(v for c in range(256) for v in (c, 0, 255 - c))
    data = head + frame(0, 0, 2, 2, [1, 2, 3, 4], disposal=1) + frame(0, 0, 2, 1, [9, 8], clear=9, disposal=3) + frame(1, 1, 1, 1, [7], disposal=2) + frame(0, 0, 1, 1, [5]) + b";"
    a, b, c, d = [s.copy() for s in gif.shown(data)]
    assert a[:, :, 0].tolist() == [[1, 2], [3, 4]] and b[:, :, 0].tolist() == [[1, 8], [3, 4]]
    assert c[:, :, 0].tolist() == [[1, 2], [3, 7]] and d[:, :, 0].tolist() == [[5, 2], [3, 0]] and d[1, 1, 3] == 0
    assert [f.delay_cs for f in gif.frames(data)] == [3] * 4
    assert [gif.histograms(s, 2)[2].tolist() for s in (a, b, d)] == [[0, 4], [0, 4], [0, 3]] and gif.described(data)[:2] == (4, 12)
    rows = head[:6] + b"\x01\0\x05\0" + head[10:] + frame(0, 0, 1, 5, [0, 4, 2, 1, 3], flags=0x40) + b";"
    assert gif.frames(rows)[0].indices.ravel().tolist() == [0, 1, 2, 3, 4]
    assert gif.frames(data[:-30])[0].indices.ravel().tolist() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        gif.frames(b"no image")


def test_gif_small_palette_stream():
    # 2-bit samples: clear 4, then 1, 6 (not yet made: 1 1), 6, 2, end 5, with widths 3 3 3 3 4 4 by the growing table.
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in ((4, 3), (1, 3), (6, 3), (6, 3), (2, 4), (5, 4)))
    raw = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    assert gif.lzw_decode(raw, 2, 99).tolist() == [1, 1, 1, 1, 1, 2]


def plain_lzw(codes, least):
    """Samples by the table that grows code by code."""
    clear, out, table, prev = 1 << least, [], None, None
    for c in codes:
        if c == clear:
            table, prev = [bytes([i]) for i in range(clear)] + [b"", b""], None
        elif c == clear + 1:
            break
        else:
            text = table[c] if c < len(table) else prev + prev[:1]
            if prev is not None and len(table) < 4096:
                table.append(prev + text[:1])
            out.append(text)
            prev = text
    return b"".join(out)


def test_lzw_equals_the_growing_table():
    r = np.random.default_rng(4)
    for body in (b"aaaaaaaaaaaaaaaa" * 300, b"abababa" * 999, r.bytes(9000), bytes(r.integers(0, 3, 20_000).tolist()), b"q"):
        codes = gif._codes(body)
        assert plain_lzw(codes.tolist(), 8) == body == gif.lzw_decode(gif._pack(codes, gif._widths(codes)), 8, len(body)).tobytes()
    for _ in range(200):  # any codes, made or not, after a first sample
        codes = [256, int(r.integers(256)), *np.minimum(r.integers(0, 300, 60), 4095).tolist()]
        codes = np.array([c for k, c in enumerate(codes) if k == 0 or c not in (256, 257)] + [257])
        got = gif.lzw_decode(gif._pack(codes, gif._widths(codes)), 8, 10**6)
        assert got.tobytes() == plain_lzw(codes.tolist(), 8)


def test_files_cut_anywhere_give_what_they_hold():
    r = np.random.default_rng(6)
    data = gif.encode(bytes(r.integers(0, 5, 4096, np.uint8)))
    whole = gif.frames(data)[0].indices
    for n in range(3, len(data)):
        got = gif.frames(data[:n])
        assert len(got) in (0, 1) and list(gif.shown(data[:n])) is not None
        if got:
            same = got[0].indices == whole
            assert same.all() or (got[0].indices[~same] == 0).all()
    for _ in range(300):  # bytes changed anywhere behind the screen's size and the palette
        odd = bytearray(data)
        for at in r.integers(781 + 20, len(data), 5):
            odd[at] = r.integers(256)
        gif.frames(bytes(odd))


def test_timed_frames(spark):
    two = gif.encode(bytes(range(256)) * 300)
    rows = gif.timed_frames(spark.createDataFrame([(1, bytearray(two)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.frame, r.start_cs, r.delay_cs, r.shown_pixels) for r in rows] == [(1, 0, 0, 10, 65536), (1, 1, 10, 10, 11264)]  # the last frame alone
    assert all(r.red == r.green == r.blue and sum(r.red) == r.shown_pixels for r in rows)


def test_damaged_media_are_refused(spark, hard):
    media = gif.store(hard)
    assert gif.digest(media).count() == hard.count()
    with pytest.raises(Exception, match="damaged media"):
        gif.digest(media.withColumn("duration_cs", media["duration_cs"] + 1)).collect()


def test_gif_documents(spark, hard, empty):
    rows = gif.gif_documents(hard).collect()
    want = sorted(hashlib.sha256((b := (t or "").encode()) + b"\0" * (-len(b) % 64 or 64 * (not b))).hexdigest() for (t,) in hard.select("text").collect())
    assert sorted(r.payload_sha256 for r in rows) == want and gif.gif_documents(empty).count() == 0
    same = [r for r in rows if r.doc_id in (9, 10)]
    assert same[0][1:] == same[1][1:]
