"""Tokens, and wavelet-matrix files against plain counting."""

import random
import zlib

from cases import HARD, docs_of, prose
import numpy as np
import pyarrow as pa
import pytest

from fieldspark.llm import tokens, wavelet
from fieldspark.llm.common import vocabulary


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    coder = tokens.UnitEncoder(vocabulary(name))
    texts = [t or "" for t in HARD] + prose(3, 50) + ["ends. Here,\nnext 1.5 'tis we'll", "<|endoftext|> a", " lead", "trail ", "Σας ΣΑΣ. ok", "a b c\x1cd\u0085e"]
    ids, at = coder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids + [2]
    assert coder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_words_are_encoded_by_lines():
    """Units of the word vocabulary next to each other in a line keep their own ids, whatever they hold but the bar."""
    name = vocabulary("word_bpe_49k.json")
    coder = tokens.UnitEncoder(name)
    units = ["word", "naïve", "ÉTÉ", "a|b", "|", "||", "", "x\t y\u00a0z", "\u0301e", "Σας", "ΣΑΣ", "it's", "<|endoftext|>", "###", "\u1100\u1161", "ﬁn", "1.5,", "\u0130i", "é" * 40, "e\u0301", "\u00b5m", "日本", *prose(6, 1, 400)[0].split()]
    calls, encoded = [], coder._encoded
    coder._encoded = lambda texts, normal=True: (calls.extend(texts), encoded(texts, normal))[1]
    ids, lengths = coder._ids(units)
    want = [coder.tokenizer.encode(u, add_special_tokens=False).ids for u in units]
    ends = np.cumsum(lengths)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths)] == want
    assert len(calls) < len(units) / 8


def test_texts_are_encoded_in_slices_to_one_file(monkeypatch):
    coder, texts = tokens.UnitEncoder(vocabulary("word_bpe_49k.json")), pa.array([*prose(8, 20), None, "", "last one"])
    want, sizes, encode = coder.encode(texts), [], coder.encode
    coder.encode = lambda some: (sizes.append(len(some)), encode(some))[1]
    monkeypatch.setattr(wavelet, "SLICE", 300)
    assert [x.tolist() for x in wavelet.encoded(coder, texts)] == [x.tolist() for x in want] and len(sizes) > 5


def test_unit_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 10)
    coder = tokens.UnitEncoder(vocabulary("byte_bpe_50k.json"))
    for t in prose(4, 20):
        assert coder.encode(pa.array([t]), None)[0].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_wavelet_matrix_answers_from_the_file():
    r = np.random.default_rng(0)
    ids = np.where(r.random(3000) < 0.3, 7, r.integers(0, 49_408, 3000)).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.pack(ids, np.array([0, 5, 5, 3000]), [3, None, -9]))
    assert m.decode().tolist() == ids.tolist() and m.doc_ids == [3, None, -9] and m.offsets.tolist() == [0, 5, 5, 3000]
    assert [m.access(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
    places = np.flatnonzero(ids == 7)
    assert m.count(7) == len(places) and [m.select(7, k) for k in range(0, len(places), 50)] == places[::50].tolist()
    assert m.rank(7, 1000) == (places < 1000).sum() and m.count(65_000) == m.count(1 << 20) == 0
    with pytest.raises(IndexError):
        m.select(7, len(places))
    none = wavelet.WaveletMatrix(wavelet.pack(ids[:0], np.zeros(1), []))
    assert none.decode().tolist() == [] and none.count(0) == 0


def test_many_ranks_and_selects_at_once():
    r = np.random.default_rng(11)
    ids = r.integers(0, 70, 3000).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.pack(ids, np.array([0, 3000]), [1]))
    for token in (0, 2, 63, 69, 500):
        at = np.flatnonzero(ids == token)
        assert m.select_many(token, np.arange(len(at))).tolist() == at.tolist()
        places = r.integers(0, 3001, 50)
        assert m.rank_many(token, places).tolist() == [int((ids[:p] == token).sum()) for p in places]
    with pytest.raises(IndexError):
        m.select_many(2, np.array([10_000]))


def test_token_documents(spark, hard, empty):
    name = vocabulary("word_bpe_49k.json")
    rows = wavelet.token_documents(hard, name).collect()
    coder = tokens.UnitEncoder(name).tokenizer
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    want = sorted((-1 if d is None else d, zlib.crc32(np.array(coder.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in hard.select("doc_id", "text").collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in rows) == want
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d) and wavelet.token_documents(empty, name).count() == 0


def test_files_of_few_texts_and_texts_longer_than_a_file(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "FILE_BYTES", 700)
    texts = prose(12, 60, 40) + ["word " * 2000, "other " * 1500]
    path = vocabulary("word_bpe_49k.json")
    rows = sorted(wavelet.token_documents(docs_of(spark, texts), path).collect(), key=lambda r: r.doc_id)
    coder, at = tokens.UnitEncoder(path), 0
    for r, t in zip(rows, texts):
        ids, _ = coder.encode(pa.array([t]))
        assert (r.start, r.n_tokens, r.ids_crc32, r.end) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), at + len(ids) - 1)
        at += len(ids)


def test_end_ids_within_texts_are_no_ends(spark, monkeypatch):
    """Id 2 stands for a # within a run, so ends come from rank, not from the number of the document."""
    texts = ["## heading", "#### x", "#!/bin/sh", "##", "#", "", "c## and f###", "# " * 50, "plain", *prose(4, 20, 12)]
    path = vocabulary("word_bpe_49k.json")
    coder = tokens.UnitEncoder(path).tokenizer
    for size in (wavelet.FILE_BYTES, 25):
        monkeypatch.setattr(wavelet, "FILE_BYTES", size)
        at = 0
        for r, t in zip(sorted(wavelet.token_documents(docs_of(spark, texts), path).collect(), key=lambda r: r.doc_id), texts):
            ids = coder.encode(t, add_special_tokens=False).ids + [2]
            assert (r.start, r.n_tokens, r.end, r.inner_ends) == (at, len(ids), at + len(ids) - 1, ids.count(2) - 1)
            at += len(ids)
