"""Clustering against a plain loop, zone maps and curve against their definitions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from basketry.llm import centroids as c


def plain(rows, k, rounds, dims):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, tuple(int(np.floor(256 * float(x))) for x in e)))
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            d, at = min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(cents))
            out.append((i, v, at, d))
        return out
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [v for _, v, at, _ in got if at == j]
            if mine:
                cents[j] = tuple(sum(col) // len(mine) for col in zip(*mine))
    got = assign()
    inertia = {j: sum(d for *_, at, d in got if at == j) for j in range(len(cents))}
    return sorted(((i, at, d, inertia[at], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, cents[at])).encode()).hexdigest()) for i, _, at, d in got), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 7) for i, e in rows],
                                 "vec_id long, embedding array<float>, label int, cluster string, row long")


def blobs(seed, n, dims, centres, spread=0.05):
    r = random.Random(seed)
    mids = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(centres)]
    return [[float(np.float32(x + r.gauss(0, spread))) for x in r.choice(mids)] for _ in range(n)]


def awkward(dims):
    zero = [0.0] * dims
    return [(900, None), (901, []), (902, zero[1:]), (903, zero[1:] + [None]), (904, zero[1:] + [float("nan")]),
            (905, zero[1:] + [float("inf")]), (906, zero + [0.0]), (907, zero), (907, zero), (None, zero),
            (908, [-0.001] * dims), (909, [3.0] * dims), (909, [-3.0] * dims)]


@pytest.mark.parametrize("dims,k", [(8, 5), (64, 40)])
def test_equals_plain_loop(spark, dims, k):
    rows = [(i, v) for i, v in enumerate(blobs(dims, 150, dims, 9))] + awkward(dims)
    rows += [(2000 + i, rows[3][1]) for i in range(60)]                 # one very common vector
    got = sorted((tuple(r) for r in c.cluster(frame(spark, rows), k=k, dims=dims).collect()), key=str)
    assert got == plain(rows, k, 5, dims)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (3, None)]
    got = sorted((tuple(r) for r in c.cluster(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows, 40, 5, 64) and len(got) == 2
    assert c.cluster(frame(spark, [])).collect() == [] and c.cluster(frame(spark, [(1, None)])).collect() == []
    only_null_id = c.cluster(frame(spark, [(None, [0.5] * 64)]))
    assert only_null_id.collect() == []                                 # no id, so no centroid


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError, match="beyond"):
        c.cluster(frame(spark, [(1, [1e30] + [0.0] * 63)]))


def test_candidates_hold_the_nearest_and_prune():
    r = np.random.RandomState(5)
    cents = r.randint(-200, 200, (40, 6)).astype(np.int64)
    kept = 0
    for _ in range(200):
        m = r.randint(-200, 200, 6) + r.randint(-20, 20, (30, 6))
        some = c.candidates(m.min(0), m.max(0), cents)
        d = ((m[:, None] - cents) ** 2).sum(2)
        assert set(d.argmin(1)) <= set(some)
        at, dist, pairs = c.nearest(m, m.min(0), m.max(0), cents)
        assert (at == d.argmin(1)).all() and (dist == d.min(1)).all() and pairs == 30 * len(some)
        kept += len(some)
    assert kept < 200 * 40 / 2
    big = (r.randint(-3, 3, (20, 64)) * (1 << 25)).astype(np.int64)      # beyond exact doubles
    at, dist, _ = c.nearest(big, big.min(0), big.max(0), big[:5])
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(v, w)) for w in big[:5]] for v in big]
    assert [(w.index(min(w)), min(w)) for w in want] == list(zip(at.tolist(), dist.tolist()))


def test_curve_visits_every_cell_once_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1).T
        keys = c.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_zone_maps_prune_clustered_vectors(spark):
    report = []
    rows = list(enumerate(blobs(1, 4000, 64, 20, 0.01)))
    c.cluster(frame(spark, rows), report=report)
    assert len(report) == 5
    assert max(report) < 4000 * 40 / 2, report
