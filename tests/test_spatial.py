"""Superposition and placement."""

import numpy as np
import pytest

from strandlake.operators import spatial as P


def test_rotated_and_shifted_frames_lie_on_each_other(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 5, (12, 3))
    q, _ = np.linalg.qr(rng.normal(0, 1, (3, 3)))
    q *= np.sign(np.linalg.det(q))
    noisy = base + rng.normal(0, 1, base.shape)
    frames = {"turned": base @ q.T + [3, -4, 5], "mirrored": base * [1, 1, -1], "noisy": noisy @ q.T}
    rows = [(f, k, *map(float, v)) for f, m in frames.items() for k, v in enumerate(m)]
    df = spark.createDataFrame(rows + [("turned", 99, 1.0, 1.0, 1.0)], "f string, atom int, x double, y double, z double")
    ref = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(base)], "atom int, x double, y double, z double")
    got = {r.f: (r.n, r.rmsd) for r in P.superposed_rmsd(df, ref, ["f"], "atom").collect()}
    assert got["turned"] == (12, pytest.approx(0, abs=1e-6)) and got["mirrored"][1] > 0.5
    a, b = noisy - noisy.mean(axis=0), base - base.mean(axis=0)
    u, d, w = np.linalg.svd(a.T @ b)
    d[2] *= np.sign(np.linalg.det(u @ w))
    assert got["noisy"][1] == pytest.approx(np.sqrt(((a**2).sum() + (b**2).sum() - 2 * d.sum()) / 12), abs=1e-9)


def test_cells_are_filled_once_each(spark):
    cells = P.lattice(spark, (4, 5, 2))
    assert cells.count() == cells.distinct().count() == 40
    names = spark.createDataFrame([("b", 7), ("a", 12), ("none", 0)], "name string, count long")
    got = P.placed(cells, names, ["c0", "c1", "c2"], seed=1)
    assert {r["name"]: r["count"] for r in got.groupBy("name").count().collect()} == {"a": 12, "b": 7}
    assert got.select("c0", "c1", "c2").distinct().count() == 19


def test_apportionment_and_salt(spark):
    df = spark.createDataFrame([("a", 2.0, None), ("b", 1.0, None), ("c", 5.0, 4)], "n string, w double, fixed int")
    assert {r.n: r["count"] for r in P.apportioned(df, 11.0, "w", "fixed").collect()} == {"a": 4, "b": 2, "c": 4}
    from pyspark.sql import functions as F

    r = spark.range(1).select(P.salt_counts(F.lit(1000.0), 0.15, F.lit(-3)).alias("s")).first().s
    assert tuple(r) == (93, 90)


def test_frames_are_laid_on_the_reference(spark):
    """Turned and moved copies of a structure come back onto it, atoms that it lacks with them."""
    import numpy as np

    from strandlake.operators.spatial import superposed

    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 3))
    rows = []
    for f in range(3):
        q, r = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        rows += [(f, k, *map(float, q @ base[k] + rng.normal())) for k in range(12)] if f == 0 else [(f, k, *map(float, p)) for k, p in enumerate((q @ base.T).T + rng.normal(size=3))]
    frames = spark.createDataFrame([r for r in rows if r[0]], "f int, atom int, x double, y double, z double")
    reference = spark.createDataFrame([(k, *map(float, base[k])) for k in range(10)], "atom int, x double, y double, z double")
    got = superposed(frames, reference, ["f"], "atom").collect()
    assert len(got) == 24 and all(np.allclose([r.x, r.y, r.z], base[r.atom], atol=1e-9) for r in got)
