"""Chains of single blocks on hand-made counts."""

import numpy as np
import pytest

from strandlake.operators import markov as K


def test_strong_labels():
    links = np.zeros((5, 5), dtype=bool)
    for i, j in [(0, 1), (1, 2), (2, 1), (3, 4), (2, 3)]:
        links[i, j] = True
    assert list(K.strong_labels(links)) == [0, 1, 1, 3, 4]


def test_local_chains(spark):
    rows = [("a", 0, 1, 3), ("a", 1, 2, 2), ("a", 2, 1, 1), ("a", 1, 1, 1), ("a", 2, 3, 5), ("b", 7, 8, 1), ("c", 4, 4, 2), ("c", None, 4, 9), ("d", 1, 0, 1), ("d", 0, 2, 2), ("d", 2, 1, 3), ("d", 1, 0, 2)]
    df = spark.createDataFrame(rows, "b string, i int, j int, c long")
    got = {(r.b, r.state): (r.pi, r.pi_forward) for r in K.local_chains(df, ["b"]).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 7), ("c", 4), ("d", 0), ("d", 1), ("d", 2)}
    assert got["a", 1] == pytest.approx((5 / 8, 0.6)) and got["a", 2] == pytest.approx((3 / 8, 0.4))
    assert got["b", 7] == (1.0, 1.0) and got["c", 4] == pytest.approx((1.0, 1.0))
    assert [got["d", k][1] for k in range(3)] == pytest.approx([1 / 3] * 3)
    assert K.local_chains(df.limit(0), ["b"]).count() == 0
