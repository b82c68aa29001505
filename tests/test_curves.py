"""Splines and thinning by lines against dense algebra and their own promise."""

import numpy as np
import pytest

from strandlake.operators import signal as G


def dense_spline(x, y, at):
    """Piecewise cubics by one dense system: values, two smooth derivatives, third ones equal at the second and last but one point."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for k in range(n):
        h = x[k + 1] - x[k]
        a[row, 4 * k], b[row] = 1, y[k]
        a[row + 1, 4 * k : 4 * k + 4], b[row + 1] = [1, h, h * h, h**3], y[k + 1]
        row += 2
        if k + 1 < n:
            a[row, 4 * k + 1 : 4 * k + 4], a[row, 4 * k + 5] = [1, 2 * h, 3 * h * h], -1
            a[row + 1, 4 * k + 2 : 4 * k + 4], a[row + 1, 4 * k + 6] = [2, 6 * h], -2
            row += 2
    a[row, 3], a[row, 7] = 1, -1
    a[row + 1, 4 * n - 5], a[row + 1, 4 * n - 1] = 1, -1
    c = np.linalg.solve(a, b).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    u = at - x[k]
    return c[k, 0] + u * (c[k, 1] + u * (c[k, 2] + u * c[k, 3]))


def points(spark, sets):
    rows = [(key, k, float(a), float(b)) for key, (x, y) in sets.items() for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "s string, pos int, px double, py double")


@pytest.mark.parametrize("n", [4, 5, 60])
def test_spline_is_the_dense_one(spark, n):
    g = np.random.default_rng(n)
    x, y = np.cumsum(g.uniform(0.1, 2, n)), g.normal(size=n)
    out = G.cubic_spline(points(spark, {"a": (x, y)}), ["s"], "px", "py", 3).orderBy("x").toPandas()
    assert len(out) == 3 * (n - 1)
    assert np.allclose(out.y, dense_spline(x, y, out.x.to_numpy()), atol=1e-9)


def test_spline_in_blocks_is_the_whole_one(spark):
    g = np.random.default_rng(1)
    n = 2 * G.SPLINE_BLOCK + 100
    x, y = np.cumsum(g.uniform(0.01, 2, n)), g.normal(size=n)
    out = G.cubic_spline(points(spark, {"a": (x, y)}), ["s"], "px", "py", 2).orderBy("x").toPandas()
    m, h = G.spline_curvature(x, y), np.diff(x)
    middle = (y[:-1] + y[1:]) / 2 - h * h / 16 * (m[:-1] + m[1:])
    assert len(out) == 2 * (n - 1) and np.allclose(out.y[1::2], middle, atol=1e-12)


def test_spline_edges(spark):
    nan = float("nan")
    df = points(spark, {"one": ([1], [1]), "two": ([0, 2], [0, 4]), "three": ([0, 1, 2], [0, 1, 4]), "ties": ([0, 0, 2, nan], [1, 3, 2, 9])})
    out = {(r.s, r.x): r.y for r in G.cubic_spline(df, ["s"], "px", "py", 2).collect()}
    assert out == {("two", 0.0): 0.0, ("two", 1.0): 2.0, ("three", 0.0): 0.0, ("three", 0.5): 0.25, ("three", 1.0): 1.0, ("three", 1.5): 2.25, ("ties", 0.0): 2.0, ("ties", 1.0): 2.0}
    assert G.cubic_spline(df.limit(0), ["s"], "px", "py", 2).count() == 0


def test_lines_pass_all_points(spark):
    g = np.random.default_rng(2)
    x, y = np.arange(4000.0), np.cumsum(g.normal(size=4000))
    df = points(spark, {"a": (x, y), "b": ([0, 1, 2, 3], [0, 1, 2, 3]), "c": ([5], [5]), "back": ([0, 1, 0, 1], [0, 0, 9, 9])})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        kept = G.straightened(df, ["s"], ["pos"], "px", "py", 1.5).orderBy("s", "pos").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a = kept[kept.s == "a"]
    assert a.pos.iloc[0] == 0 and a.pos.iloc[-1] == 3999 and len(a) < 2000
    assert np.abs(np.interp(x, a.px, a.py) - y).max() <= 1.5 + 1e-9
    assert list(kept[kept.s == "b"].pos) == [0, 3] and list(kept[kept.s == "c"].pos) == [0] and list(kept[kept.s == "back"].pos) == [0, 1, 2, 3]
    assert G.straightened(df.limit(0), ["s"], ["pos"], "px", "py", 1.0).count() == 0
