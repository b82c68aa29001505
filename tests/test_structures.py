"""Structure measures, generated series and array files on small inputs of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import structures as S
from strandlake.sources import arrays, generated, runs

XYZ = ["x", "y", "z"]


def test_charge(spark):
    rows = [("a", 0, "ARG", 1, False), ("a", 1, "ARG", 1, False), ("a", 2, "ARG", 2, False), ("a", 3, "ASP", 3, True), ("a", 4, "ASP", 3, False), ("a", 5, None, None, False), ("b", 0, "GLY", 1, None)]
    df = spark.createDataFrame(rows, "s string, n int, residue string, number int, v boolean")
    got = S.net_charge(df, ["s"], ["n"], ["residue", "number"], "residue", {"ARG": 1, "ASP": -1}, F.col("v"))
    assert {r.s: r.charge for r in got.collect()} == {"a": 2, "b": 0}
    assert S.net_charge(df.limit(0), ["s"], ["n"], ["residue"], "residue", {}).count() == 0


def test_axes_and_extents(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(50, 3)) * [1, 5, 2] @ np.linalg.qr(g.normal(size=(3, 3)))[0] + 7
    df = spark.createDataFrame([("a", k, *map(float, r)) for k, r in enumerate(x)] + [("one", 0, 1.0, 2.0, 3.0), ("null", 0, None, 1.0, 1.0)], "s string, k int, x double, y double, z double")
    out = S.along_axes(df, ["s"], XYZ).orderBy("s", "k").toPandas()
    a = out[out.s == "a"][XYZ].to_numpy()
    c = x - x.mean(axis=0)
    assert np.allclose(np.cov(a.T, bias=True), np.diag(np.linalg.eigvalsh(np.cov(c.T, bias=True))[::-1]), atol=1e-8)
    assert np.allclose(np.linalg.norm(a[3] - a[9]), np.linalg.norm(x[3] - x[9])) and np.allclose(out[out.s == "one"][XYZ], 0) and not (out.s == "null").any()
    d = {r.s: (r.diam, r.diam_xy) for r in S.diameters(df, ["s"], XYZ).collect()}
    assert d["a"] == pytest.approx((2 * np.linalg.norm(c, axis=1).max(), 2 * np.linalg.norm(c[:, :2], axis=1).max())) and d["one"] == (0.0, 0.0)
    row = S.turned(spark.createDataFrame([(1.0, 0.0)], "x double, y double"), "x", "y", 90.0).first()
    assert (row.x, row.y) == pytest.approx((0.0, -1.0))


def test_cross_section(spark):
    df = spark.createDataFrame([("a", 0.05, 0.05, 0.0), ("a", 0.05, 0.05, 0.0), ("a", 9.0, 9.0, 5.0)], "s string, x double, y double, z double")
    row = S.cross_section(df, ["s"], XYZ, 0.1, -1.0, 1.0).first()
    assert row.cells == 1 and row.area == pytest.approx(0.01)
    assert S.cross_section(df, ["s"], XYZ, 0.1, 6.0).count() == 0


def test_best_of_rounds(spark):
    df = spark.createDataFrame([("p", "wt", -5.0), ("p", "wt", -7.0), ("p", "m", -6.0), ("p", "m", float("nan")), ("q", "m", None), ("q", "n", -1.0)], "g string, v string, e double")
    got = {(r.g, r.v): (r.best, r.rounds, r.ddg) for r in S.best_of_rounds(df, ["g"], "v", F.col("v") == "wt", "e").collect()}
    assert got == {("p", "wt"): (-7.0, 2, 0.0), ("p", "m"): (-6.0, 1, 1.0), ("q", "n"): (-1.0, 1, None)}


def test_generated(spark):
    assert [r.x for r in generated.index_mesh(spark, 3).orderBy("pos").collect()] == [0.0, 1.0, 2.0]
    assert [r.x for r in generated.linear_mesh(spark, -1.0, 3.0, 5).orderBy("pos").collect()] == [-1.0, 0.0, 1.0, 2.0, 3.0]
    assert [r.lam for r in generated.ladder(spark, 3, 0.25, 1.0).orderBy("replica").collect()] == pytest.approx([1.0, 0.5, 0.25])
    assert [r.lam for r in generated.ladder(spark, 3, 0.5, 1.0, "linear").orderBy("replica").collect()] == pytest.approx([1.0, 0.75, 0.5])
    p = generated.sphere_points(spark, 40).toPandas()
    assert np.allclose((p[XYZ] ** 2).sum(axis=1), 1) and abs(p.y.mean()) < 1e-12
    assert 0 <= generated.random_vector(spark, 10, 1).agg(F.min("x")).first()[0] < 1
    with pytest.raises(ValueError):
        generated.linear_mesh(spark, 0, 1, 1)


def test_npy(spark, tmp_path):
    g = np.random.default_rng(0)
    m, v = g.normal(size=(1000, 5)).astype(np.float32), np.arange(4)
    np.save(tmp_path / "a.npy", m), np.save(tmp_path / "b.npy", v)
    out = arrays.read_npy(spark, f"{tmp_path}/*.npy", columns=3, rows=300).orderBy("block", "pos").collect()
    assert len(out) == 1004 and np.allclose([r.v for r in out[:1000]], m[:, :3]) and [r.v for r in out[1000:]] == [[0.0], [1.0], [2.0], [3.0]]
    assert arrays.read_npy(spark, f"{tmp_path}/none*.npy").count() == 0
    back = arrays.read_npy(spark, f"{tmp_path}/a.npy")
    parts = sorted(arrays.write_npy(back, "v", ["block", "pos"], str(tmp_path / "out")).collect())
    assert sum(r.rows for r in parts) == 1000 and np.allclose(np.concatenate([np.load(tmp_path / "out" / f"part-{r.part:06d}.npy") for r in parts]), m)


def test_run_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("Energy  Average\nPotential   -1.5e+06  3\nPotential none\nVolume 7 1\n")
    assert [(r.name, r.value) for r in runs.read_energies(spark, str(tmp_path / "e.txt"), ["Potential"]).collect()] == [("Potential", -1.5e6)]
    rows = spark.createDataFrame([("; note",), ("[ params ]",), (" A B 1 0.5 9.414 ; go 7.9",), ("A B",), (None,)], "text string")
    got = [r.text for r in runs.scaled_contacts(rows, 0.5, 9.414).collect()]
    assert got[:2] == ["; note", "[ params ]"] and got[2].split() == ["A", "B", "1", "0.5", "4.70700000", ";", "go", "7.9"] and got[3:] == ["A B", None]
    assert math.isclose(float(got[2].split()[4]), 4.707)
