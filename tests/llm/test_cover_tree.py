"""Cover-tree links against brute force."""

import numpy as np
import pytest
from fieldspark.llm import cover_tree


def plain_links(rows, cosine=0.95):
    """vec_id, n_links, component_id, kept by comparing all vectors of equal length."""
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = np.zeros((len(ok), len(ok)), bool)
    for p, i in enumerate(ok):
        for q, j in enumerate(ok):
            if p != q and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                near[p, q] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    label = np.array([rows[i][0] for i in ok])
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(ok))])
        if (new == label).all():
            break
        label = new
    out = {i: (rows[i][0], 0, rows[i][0], rows[i][0] is not None) for i in range(len(rows))}
    for k, i in enumerate(ok):
        out[i] = (rows[i][0], int(near[k].sum()), int(label[k]), rows[i][0] == label[k])
    return sorted(out.values(), key=str)


@pytest.mark.parametrize(("chunk", "block", "dense"), [(4096, 1 << 21, 2048), (60, 300, 20)])
def test_vector_links_equal_brute_force(spark, monkeypatch, chunk, block, dense):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("DENSE", dense)):
        monkeypatch.setattr(cover_tree, name, value)
    r = np.random.default_rng(3)
    base = {d: r.normal(size=(20, d)) for d in (8, 5)}
    rows = []
    for i in range(300):  # two lengths, neither rare, exact copies among both
        d = 8 if i % 5 < 3 else 5
        rows.append((i, (base[d][r.integers(20)] + r.normal(size=d) * r.choice([0, 0.1, 0.3])).tolist()))
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [1.0, 2.0]), (505, []), (None, base[8][0].tolist()), (506, [float("inf")] + [0.0] * 7), (507, [2.0, 4.0])]
    df = spark.createDataFrame([(d, v, 1, 2, b"x") for d, v in rows], "vec_id long, embedding array<float>, label int, n int, sig binary")
    got = [tuple(x) for x in cover_tree.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=str) == plain_links(rows)


def test_vectors_of_nothing(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = cover_tree.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_copies_and_a_tight_group_are_one_component(spark):
    """A third of the rows are copies of one vector, a third lie close to another: no pair is lost, none is counted twice."""
    r = np.random.default_rng(5)
    a, b = r.normal(size=(2, 16))
    rows = [(i, a.tolist()) for i in range(200)] + [(200 + i, (b + 0.01 * r.normal(size=16)).tolist()) for i in range(200)] + [(400 + i, r.normal(size=16).tolist()) for i in range(200)]
    got = {x.vec_id: x for x in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links == 199 and got[i].component_id == i // 200 * 200 for i in range(400))


def built(x, reach):
    order, levels, _ = cover_tree.build(x, reach)
    return cover_tree.Tree(x[order], np.ones(len(x), np.int64), levels)


@pytest.mark.parametrize("d", [2, 8, 32])
def test_levels_halve_nest_cover_and_separate(d):
    r = np.random.default_rng(d)
    x = cover_tree.unit(r.normal(size=(300, d)) + 3 * r.normal(size=(1, d)))
    reach = float(np.arccos(0.95))
    tree, sizes = built(x, reach), cover_tree.radii(reach)
    assert all(b == a / 2 for a, b in zip(sizes, sizes[1:])) and len(tree.levels) == len(sizes) + 1
    for level, size, below in zip(tree.levels, sizes, tree.levels[1:]):
        assert set(level.centre) <= set(below.centre) and set(level.starts) <= set(below.starts)
        apart = cover_tree.angle(tree.x[level.centre] @ tree.x[level.centre].T)
        assert (apart[~np.eye(len(apart), dtype=bool)] > size - 1e-3).all()
        for k, c in enumerate(level.centre):
            own = tree.x[level.starts[k] : level.starts[k + 1]]
            assert level.starts[k] <= c < level.starts[k + 1] and cover_tree.angle(own @ tree.x[c]).max() <= level.radius[k] + cover_tree.SLACK
        assert (level.radius <= 2 * size).all()


def test_radii_prune_pairs_of_clustered_vectors():
    """Twenty clusters far apart: far fewer pairs of vectors are decided, or nodes compared, than there are pairs."""
    r = np.random.default_rng(1)
    base = r.normal(size=(20, 24))
    x = cover_tree.unit(base[np.arange(2000) % 20] + 0.02 * r.normal(size=(2000, 24)))
    met = cover_tree.Meeting(built(x, float(np.arccos(0.95))), None).run()
    assert met.counts.tolist() == [99] * 2000
    looked = cover_tree.build(x, float(np.arccos(0.95)))[2]
    assert met.compared + met.decided < 2000 * 2000 // 2 / 10 and met.compared + met.decided + looked < 2000 * 2000 // 2 / 4


def test_building_without_structure_costs_about_all_pairs_and_no_more():
    """Random directions have no clusters to prune by, so a tree looks at each pair once, as a plain product does."""
    x = cover_tree.unit(np.random.default_rng(5).normal(size=(2000, 64)))
    assert cover_tree.build(x, float(np.arccos(0.95)))[2] < 1.25 * 2000 * 1999 // 2


@pytest.mark.parametrize(("d", "block", "dense"), [(3, 1 << 21, 2048), (16, 500, 30), (64, 2000, 100)])
def test_blocks_of_pairs_give_the_same_links(monkeypatch, d, block, dense):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "DENSE", dense)
    r = np.random.default_rng(d)
    base = r.normal(size=(30, d))
    x = cover_tree.unit(base[r.integers(30, size=500)] + r.normal(size=(500, d)) * r.choice([0.01, 0.1, 0.3], size=(500, 1)))
    weights = r.integers(1, 4, 500)
    near = x @ x.T >= cover_tree.COSINE
    np.fill_diagonal(near, False)
    label = np.arange(500)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 500).min(1))
        if (new == label).all():
            break
        label = new
    counts, least = cover_tree.links(x, weights)
    assert (counts == near @ weights).all() and (least == label).all()
