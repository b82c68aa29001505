"""Medoids of all rows against brute force."""

import numpy as np
import pytest

from strandlake.operators import markov as K


def test_no_member_is_better(spark, monkeypatch):
    monkeypatch.setattr(K, "CANDIDATES", 200, raising=False)
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(c, 1.0, size=(n, 2)) for c, n in ((0.0, 3000), (6.0, 1200), (-7.0, 800))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)
    ids, loss = K.k_medoids(df, "id", "v", 3)
    d = np.sqrt(((x[:, None, :] - x[ids][None, :, :]) ** 2).sum(axis=2))
    label = d.argmin(axis=1)
    assert len(ids) == 3 and loss == pytest.approx(d.min(axis=1).mean())
    for c, i in enumerate(ids):
        own = x[label == c]
        totals = np.sqrt(((own[:, None, :] - own[None, :, :]) ** 2).sum(axis=2)).sum(axis=1)
        assert np.sqrt(((own - x[i]) ** 2).sum(axis=1)).sum() == pytest.approx(totals.min(), rel=1e-8)


def test_edges(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [5.0]), ("d", None), (None, [9.0])], "id string, v array<float>")
    assert K.k_medoids(df, "id", "v", 5) == (["a", "c"], 0.0)
    assert K.k_medoids(df.limit(0), "id", "v", 2) == ([], 0.0)
    assert [i for i, _ in K.medoid_start(df, "id", "v", 1)] == ["a"]
