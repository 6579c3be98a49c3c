"""Archives: round trips, damage, dictionaries."""

import hashlib

import pytest

from fieldspark.llm import warc


def test_archive_frames():
    records = [warc.record(i, f"http://x/{i}\r\n", (f"<p>page {i} " + "body text " * 30).encode(), "d", None, "2020-01-01T00:00:00Z") for i in range(400)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.records(data)) == records
    assert list(warc.records(warc.archive(records[:1]))) == records[:1] and list(warc.records(warc.archive([]))) == []


def test_pages_come_back(spark):
    html = "<html>" + "long page " * 50
    pages = [(3, "u", html), (2, "u\nv", html), (9, None, html), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", html), (2, "u\nv", html), (11, "ü", "é" * 50), (12, "u", "é" * 50)]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, first int, digest string")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.archive_pages(df).collect())
    want = []
    for page, _, text in pages:
        b = (text or "").encode()
        least = min((p for p, _, t in pages if t == text and p is not None), default=page) if len(b) >= 100 else page
        want.append((-1 if page is None else page, len(b), hashlib.sha256(b).hexdigest(), "response" if least == page else "revisit", -1 if least == page else least))
    assert got == sorted(want) and warc.archive_pages(df.limit(0)).count() == 0


def test_damaged_record_is_refused():
    good = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, "d")
    assert warc.parsed(good)[:2] == (1, 4)
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"body", b"bodz"))


def test_dictionary_sees_whole_records(monkeypatch):
    seen = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, pieces: seen.extend(pieces) or (_ for _ in ()).throw(warc.zstandard.ZstdError("few")))
    body = bytes(range(256)) * 40_000
    assert list(warc.records(warc.archive([body, b"x" * 200]))) == [body, b"x" * 200]
    assert len(seen) <= warc.SAMPLE_PIECES and seen[0] == body[: warc.PIECE_BYTES] and sum(map(len, seen)) > 2_000_000
