"""Silhouettes against brute force, in several blocks of queries, and at the edges."""

import numpy as np
import pytest

from strandlake.operators import joins as J


def brute(x, labels, k):
    d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
    others = np.arange(len(x)) != k
    means = {name: d[others & (labels == name)].mean() for name in set(labels) if (others & (labels == name)).any()}
    own, other = means.get(labels[k]), min(v for name, v in means.items() if name != labels[k])
    return 0.0 if own is None else (other - own) / max(own, other)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST_MEDOIDS", 20)
    g = np.random.default_rng(0)
    x, labels = g.normal(size=(120, 4)), np.array([f"c{k % 3}" for k in range(119)] + ["alone"])
    df = spark.createDataFrame([(k, v.tolist(), str(name), 1.0) for k, (v, name) in enumerate(zip(x, labels))], "id long, v array<double>, label string, total double")
    got = {r.id: r.silhouette for r in J.silhouettes(df, "id", "v", "label", df.filter("id % 2 = 1")).collect()}
    assert sorted(got) == list(range(1, 120, 2)) and got[119] == 0.0
    assert all(got[k] == pytest.approx(brute(x, labels, k), abs=1e-9) for k in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "a"), (3, None, "a"), (None, [1.0], "b"), (4, [1.0], None)], "id long, v array<double>, label string")
    rows = J.silhouettes(df, "id", "v", "label", df).orderBy("id").collect()
    assert [(r.id, r.own, r.other, r.silhouette) for r in rows] == [(1, 1.0, None, None), (2, 1.0, None, None)]
    assert J.silhouettes(df.limit(0), "id", "v", "label", df.limit(0)).count() == 0
