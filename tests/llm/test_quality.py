"""The quality discriminant on held-out rows."""

import random
import zlib

import numpy as np
from cases import docs_of, prose

from fieldspark.llm import quality


def test_quality_on_held_out_rows(spark, hard, empty):
    good = prose(10, 300)
    bad = [" ".join(f"{w}***" for w in t.split()) for t in prose(11, 60)] + ["Nd, " * 80] * 20
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(380)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == (r.doc_id < 300) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in quality.score_documents(hard, labels).collect())
    assert quality.score_documents(empty, labels).count() == 0
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_statistics_take_no_crash():
    for t in (b"", b" \n", b"a", "é".encode() * 9, b"\xff\xfe x", b"A" * 100_000):
        assert np.isfinite(quality.statistics(t)).all()


def test_scores_are_log_density_differences():
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 5)) @ r.normal(size=(5, 5)) + np.arange(5)
    y = (r.random(400) < 0.4).astype(float)
    x[y == 1] *= 1.5
    model = quality.fit(x, y)
    z = (x - model.centre) / model.scale
    fitted = np.arange(400) % 4 != 3
    pooled = np.mean([z[fitted & (y == c)].var(0) for c in (0, 1)], axis=0) + 1e-3
    density = []
    for c in (0, 1):
        own = z[fitted & (y == c)]
        cov = (1 - quality.SHRINKAGE) * np.cov(own.T, bias=True) + quality.SHRINKAGE * np.diag(pooled)
        d = z - own.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), density[1] - density[0])
