"""Components of very many features, connected states, and large sets of medoids, against plain numpy and loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.operators import joins as J
from strandlake.operators import markov as K


def vectors(spark, x, **columns):
    data = {c: pa.array(v) for c, v in columns.items()}
    return spark.createDataFrame(pa.table({**data, "v": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)


def test_components_of_24349_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6)) * [9, 7, 5, 3, 2, 1] @ rng.normal(size=(6, 24_349)) + 4 + rng.normal(size=(90, 24_349)) * 0.01
    df = vectors(spark, x, k=np.arange(90))
    mean, values, parts = K.principal_components(df, "v", 4)
    centred = x - x.mean(axis=0)
    _, s, w = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(values, s[:4] ** 2 / 90, rtol=1e-8)
    assert np.allclose(np.abs((parts * w[:4].T).sum(axis=0)), 1, atol=1e-6)
    _, many, _ = K.leading_components(df, "v", variance=0.999)
    held = np.cumsum(s**2) / (s**2).sum()
    assert len(many) == np.searchsorted(held, 0.999) + 1


@pytest.mark.parametrize("square", [2000, 3])
def test_lagged_components_whichever_way(spark, monkeypatch, square):
    """The slow direction of two blocks, with the covariance formed and without."""
    monkeypatch.setattr(K, "SQUARE", square)
    rng = np.random.default_rng(2)
    n, d = 300, 5
    slow = np.zeros((2, n))
    for t in range(1, n):
        slow[:, t] = 0.97 * slow[:, t - 1] + rng.normal(size=2)
    mix = rng.normal(size=d)
    x = np.concatenate([np.outer(b, mix) + rng.normal(size=(n, d)) for b in slow])
    block, frame = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    mean, eigen, parts = K.time_lagged_components(vectors(spark, x, b=block, f=frame), ["b"], ["f"], "v", 2, 1, variance=1.0 - 1e-12)
    c = x - x.mean(axis=0)
    values, w = np.linalg.eigh(c.T @ c / len(c))
    white = c @ w / np.sqrt(values)
    pairs = [(white[block == b][:-2], white[block == b][2:]) for b in (0, 1)]
    lagged = sum(p.T @ q for p, q in pairs) / sum(len(p) for p, _ in pairs)
    want = np.linalg.eigvalsh((lagged + lagged.T) / 2)[-1]
    assert eigen[0] == pytest.approx(want, rel=1e-6) and abs(np.corrcoef(c @ parts[:, 0], np.concatenate(slow))[0, 1]) > 0.9


def _reach(n, edges):
    reach = np.eye(n, dtype=bool)
    for i, j in edges:
        reach[i, j] = True
    for _ in range(n):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_states_like_reachability(spark, seed):
    rnd = random.Random(seed)
    n = 14
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(16)]
    df = spark.createDataFrame(edges + edges[:3] + [(0, 99), (None, 1)], "i int, j int")
    states = spark.createDataFrame([(k,) for k in range(n)] + [(0,), (None,)], "state int")
    reach = _reach(n, edges)
    strong = {k: min(q for q in range(n) if reach[k, q] and reach[q, k]) for k in range(n)}
    assert {r.state: r.component for r in K.components(df, states).collect()} == strong
    either = _reach(n, edges + [(j, i) for i, j in edges])
    assert {r.state: r.component for r in K.weak_components(df, states).collect()} == {k: int(np.flatnonzero(either[k])[0]) for k in range(n)}
    assert K.components(df, states.filter("false")).count() == 0


def test_nearest_of_more_medoids_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST_MEDOIDS", 7)
    rng = np.random.default_rng(1)
    x, centres = rng.integers(0, 6, (80, 2)).astype(float), rng.integers(0, 6, (40, 2)).astype(float)
    df = vectors(spark, x, k=np.arange(80)).unionByName(spark.createDataFrame([(-1, None)], "k long, v array<double>"))
    got = {r.k: (r.medoid, r.distance) for r in J.nearest(df, vectors(spark, centres, medoid=np.arange(40)), "v").collect()}
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
    assert got.pop(-1) == (None, None) and {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(axis=1).tolist()))
    assert all(abs(got[k][1] - d[k].min()) < 1e-12 for k in got)
