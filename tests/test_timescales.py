"""Eigenvalues of whole chains against numpy."""

import numpy as np
import pytest

from strandlake.operators import markov as K


def test_all_eigenvalues_of_all_lags(spark):
    g = np.random.default_rng(2)
    made = {("a", 1): g.integers(1, 50, size=(6, 6)), ("a", 5): g.integers(1, 50, size=(6, 6)), ("b", 1): np.array([[9, 1], [2, 8]])}
    rows = [(r, lag, i, j, int(m[i, j])) for (r, lag), m in made.items() for i in range(len(m)) for j in range(len(m))]
    # "c" has two parts that don't meet: two eigenvalues are 1
    rows += [("c", 1, 0, 0, 3), ("c", 1, 0, 1, 1), ("c", 1, 1, 0, 1), ("c", 1, 1, 1, 3), ("c", 1, 4, 4, 2), ("c", 1, None, 4, 2)]
    df = spark.createDataFrame(rows, "r string, lag int, i int, j int, c long")
    got = {}
    for q in K.local_timescales(df, ["r"]).orderBy("rank").collect():
        got.setdefault((q.r, q.lag), []).append((q.eigenvalue, q.timescale))
    for key, m in made.items():
        s = m + m.T
        want = np.sort(np.linalg.eigvals(s / s.sum(axis=1, keepdims=True)).real)[::-1]
        assert [v for v, _ in got[key]] == pytest.approx(list(want), abs=1e-9)
        assert got[key][0][1] is None
        for v, t in got[key][1:]:
            assert t == pytest.approx(-key[1] / np.log(v)) if v > 0 else t is None
    assert [t for _, t in got["c", 1]] == [None, float("inf"), pytest.approx(-1 / np.log(0.5))]
