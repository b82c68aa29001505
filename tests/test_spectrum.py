"""The whole spectrum against numpy, for lengths that are prime, square, even and odd."""

import numpy as np
import pytest

from strandlake.operators import signal as G


def test_whole_spectrum(spark):
    g = np.random.default_rng(5)
    sets = {n: g.normal(size=n) + 3 * np.cos(2 * np.pi * (n // 2) * np.arange(n) / n) for n in (1, 2, 23, 25, 48, 50)}
    df = spark.createDataFrame([(n, t, float(v)) for n, y in sets.items() for t, v in enumerate(y)], "n long, t long, y double")
    terms = G.spectrum(df, ["n"], ["t"], "y")
    got = {(r.n, r.k): (complex(r.re, r.im), r.magnitude) for r in terms.collect()}
    assert set(got) == {(n, k) for n in sets for k in range(n // 2 + 1)}
    for (n, k), (term, magnitude) in got.items():
        want = np.fft.fft(sets[n])[k] / n
        assert abs(term - want) < 1e-9 and magnitude == pytest.approx((1 if 2 * k == n else 2) * abs(want), abs=1e-9)
    back = {(r.n, r.pos): r.y for r in G.inverse_spectrum(terms.withColumnRenamed("n", "s"), ["s"], df.groupBy(df["n"].alias("s")).agg({"n": "max"}).toDF("s", "n")).withColumnRenamed("s", "n").collect()}
    assert all(back[n, t] == pytest.approx(v, abs=1e-9) for n, y in sets.items() for t, v in enumerate(y))
    best = {r.n: r.k for r in G.dominant_frequency(df, ["n"], ["t"], "y").collect()}
    assert best == {n: n // 2 for n in sets if n > 1}
