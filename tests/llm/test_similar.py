import tracemalloc

import numpy as np
import pytest

from evidentia.llm import similar as S

SCHEMA = "vid long, emb array<float>, id long, cls string"


def exact(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosine = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-cosine[a, b], ids[b]))[:k]
        out[i] = [(ids[b], cosine[a, b]) for b in order]
    return out


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[n // 2 : n // 2 + n // 4] = base[: n // 4] + 0.1 * rng.normal(size=(n // 4, dim))
    base[-n // 10 :] = base[0] * rng.uniform(0.5, 2, size=(n // 10, 1))
    return {int(i): v.tolist() for i, v in enumerate(base)}


def test_pairs_equal_brute_force(spark):
    mine = vectors(300)
    mine |= {1000 + k: mine[5] for k in range(40)}  # a group of copies, larger than k
    rows = [(i, v, None, "x") for i, v in mine.items()]
    rows += [(7, mine[7], 1, None), (2000, None, 1, "x"), (2001, [1.0] * 15, 1, "x"), (2002, [0.0] * 16, 1, "x"), (2003, [float("nan")] + [1.0] * 15, 1, "x"), (2004, [float("inf")] + [1.0] * 15, 1, "x"), (2005, [None] + [1.0] * 15, 1, "x"), (None, [1.0] * 16, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(min(i, j), max(i, j)) for i, near in exact(mine, 10).items() for j, c in near if c >= 0.95}
    got = [tuple(r) for r in S.similar_pairs(df, "vid", "emb", dim=16, least=0.95, k=10).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("least", [0.9, None])
def test_passes_over_queries_find_the_same(spark, monkeypatch, least):
    mine = vectors(400, seed=2)
    index = S.Index(spark.createDataFrame([(i, v, 1, "x") for i, v in mine.items()], SCHEMA), "vid", "emb", dim=16, n_lists=64, probes=64)
    rows = lambda: sorted(map(tuple, index.neighbours(least=least).collect()))
    written, before = [], rows()
    monkeypatch.setattr(S, "ROWS_A_PASS", 150)
    monkeypatch.setattr(S, "ROWS_A_VECTOR", 0)
    monkeypatch.setattr(S, "cut", lambda df, label, real=S.cut: written.append(label) or real(df, label))
    assert rows() == before and len(before) > 500
    assert written.count("pairs") > 2
    if least:  # proven
        assert {(r[0], r[1]) for r in before} == {(i, j) for i, near in exact(mine, 10).items() for j, c in near if c >= least}


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    mine = vectors(500, seed=1)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in mine.items()], SCHEMA)
    index = S.Index(df, "vid", "emb", dim=16, n_lists=4, k=10)
    got = {}
    for r in index.neighbours(spark.range(0, 500, 10), exact=True).collect():
        got.setdefault(r.id, {})[r.pos] = (r.other, r.cosine)
    want = exact(mine, 10)
    assert set(got) == set(range(0, 500, 10))
    hits = sum(len({o for o, _ in found.values()} & {o for o, _ in want[i]}) for i, found in got.items())
    assert hits >= 0.9 * 10 * len(got)
    assert all([found[p][0] for p in sorted(found)] == [o for o, _ in want[i]] for i, found in got.items())  # proven for a stated set
    for found in got.values():
        assert [k for k in sorted(found)] == list(range(1, 11))
        order = [(-found[p][1], found[p][0]) for p in sorted(found)]
        assert order == sorted(order)


def test_codes_come_closer_with_more_books():
    rng = np.random.default_rng(0)
    x = S._units(rng.normal(size=(600, 16))).astype(np.float32)
    misses = [float(S.Quantiser(x, 4, books, 32, 3).encode(x)[3].mean()) for books in (1, 3, 6)]
    assert misses[0] > misses[1] > misses[2]
    q = S.Quantiser(x, 4, 4, 32, 3)
    lists, codes, size, miss = q.encode(x[:50])
    for k in range(4):
        mine = np.flatnonzero(lists == k)
        if len(mine):
            s = q.scores(x[100:110], k, codes[mine])
            assert np.all(np.abs(s - x[mine] @ x[100:110].T) <= miss[mine][:, None] + 1e-4)
    assert q.encode(x)[3].mean() <= S.Quantiser(x, 4, 4, 32, 1).encode(x)[3].mean() + 1e-6


def test_memory_of_fitting_does_not_grow_with_lists_times_sample():
    x = S._units(np.random.default_rng(5).normal(size=(8192, 8))).astype(np.float32)
    tracemalloc.start()
    q = S.Quantiser(x, 2048, 2, 16, 2)
    near = q.nearest(x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6  # 8192 x 2048 products alone are 67 MB
    assert len(q.centres) == 2048 and near.shape == (8192, 5)
    score = x[::64] @ q.centres.T - (q.centres * q.centres).sum(1) / 2
    np.testing.assert_allclose(np.take_along_axis(score, near[::64], 1), -np.sort(-score, axis=1)[:, :5], atol=1e-5)
    assert (q.nearest(x, 1)[:, 0] == near[:, 0]).mean() > 0.999


def test_a_sample_of_several_parts_is_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_SAMPLE", 64)
    monkeypatch.setattr(S, "Quantiser", lambda sample, n_lists, *rest: (sample, n_lists))
    mine = np.random.default_rng(6).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mine)], "id long, v array<float>")
    sample, n_lists = S.fit(df, 4, 16, 2, 16, 2, 0)
    assert n_lists == 16 and sample.dtype == np.float32 and sample.shape == (300, 4)
    np.testing.assert_array_equal(sample[np.lexsort(sample.T)], (u := S._units(mine).astype(np.float32))[np.lexsort(u.T)])


def test_no_list_that_may_hold_a_near_vector_is_left_out():
    rng = np.random.default_rng(3)
    x = S._units(np.concatenate((rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(4, 8)), 100, 0) + 0.2 * rng.normal(size=(400, 8))))).astype(np.float32)
    q = S.Quantiser(x, 40, 2, 16, 2)
    own = q.encode(x)[0]
    cosine = x.astype(float) @ x.astype(float).T
    for least in (0.98, 0.9, 0.6, -1.0):
        radius = np.full(len(x), np.sqrt(2 - 2 * least))
        row, lists = q.reached(x, own, radius, False)
        there = np.zeros((len(x), 40), bool)
        there[row, lists] = True
        a, b = np.nonzero(cosine >= least)
        assert there[a, own[b]].all()
        row, lists = q.reached(x, own, radius, True)
        half = np.zeros((len(x), 40), bool)
        half[row, lists] = True
        assert not (half & ~there).any() and (half[a, own[b]] | half[b, own[a]]).all()
        assert half.sum() < there.sum()
    assert there.all()  # any cosine: all lists


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 1, "x")], [(1, None, 1, "x")]])
def test_hardly_any_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert S.similar_pairs(df, "vid", "emb", dim=2, least=0.9).count() == 0
