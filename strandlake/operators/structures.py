"""Measures of structures: charge, extents, native contacts, orientation; and sets stacked on each other."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.joins import neighbours

Names = Sequence[str]


def net_charge(atoms: DataFrame, by: Names, order: Names, residue: Names, kind: str, charges: Mapping[str, int], virtual: Column | None = None) -> DataFrame:
    """Charge of each structure: one per stretch of atoms equal in ``residue``, by the residue's ``kind``: by, charge.

    A stretch begins where an atom differs in ``residue`` from the one before it, and counts if that first atom
    isn't ``virtual``. Nulls are equal to each other; kinds without a charge, or null, count 0.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.lag(F.lit(1)).over(w).isNull()
    changed = first
    for c in residue:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    of = F.create_map(*(F.lit(v) for pair in charges.items() for v in pair)) if charges else None
    value = F.coalesce(F.try_element_at(of, F.trim(F.col(kind))), F.lit(0)) if charges else F.lit(0)
    real = F.lit(True) if virtual is None else ~F.coalesce(virtual, F.lit(False))
    return atoms.withColumn("_q", F.when(changed & real, value).otherwise(0)).groupBy(*by).agg(F.sum("_q").cast("long").alias("charge"))


def diameters(points: DataFrame, by: Names, xyz: Names) -> DataFrame:
    """Twice the largest distance from the centre, in space and across z: by, diam, diam_xy. Points with a null are left out."""
    points = points.dropna(subset=list(xyz)).select(*by, *(F.col(c).alias(f"_{n}") for c, n in zip(xyz, "xyz")))
    centre = points.groupBy(*by).agg(*(F.avg(f"_{n}").alias(f"_c{n}") for n in "xyz"))
    x, y, z = (F.col(f"_{n}") - F.col(f"_c{n}") for n in "xyz")
    both = points.join(centre, list(by)) if by else points.crossJoin(F.broadcast(centre))  # one row of means
    return both.groupBy(*by).agg((2 * F.max(F.sqrt(x * x + y * y + z * z))).alias("diam"), (2 * F.max(F.hypot(x, y))).alias("diam_xy"))


def cross_section(points: DataFrame, by: Names, xyz: Names, spacing: float, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """Area across z of the points between ``low`` and ``high``: by, cells, area.

    It is that of the square cells, ``spacing`` wide, whose middle lies within ``spacing`` of a point. Structures without
    a point in between give no row.
    """
    x, y, z = (F.col(c) for c in xyz)
    inside = points.dropna(subset=list(xyz)).filter((z > low) & (z < high)).select(*by, x.alias("_x"), y.alias("_y"))
    inside = inside.withColumns({"_i": F.floor(F.col("_x") / spacing), "_j": F.floor(F.col("_y") / spacing)})
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-1, 2) for b in range(-1, 2)))
    cells = inside.withColumn("_s", F.explode(shifts)).withColumns({"_i": F.col("_i") + F.col("_s.a"), "_j": F.col("_j") + F.col("_s.b")})
    near = cells.filter(F.hypot((F.col("_i") + 0.5) * spacing - F.col("_x"), (F.col("_j") + 0.5) * spacing - F.col("_y")) < spacing)
    taken = near.select(*by, "_i", "_j").distinct()
    return taken.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * (spacing * spacing)).alias("area"))


def native_contacts(points: DataFrame, by: Names, index: str, xyz: Names, cutoff: float, apart: int = 4) -> DataFrame:
    """Pairs of points closer than ``cutoff`` and at least ``apart`` apart in ``index``: by, i, j, distance (i < j)."""
    pairs = neighbours(points, xyz, cutoff, [index], by)
    return pairs.filter(F.col(f"b_{index}") - F.col(f"a_{index}") >= apart).select(*by, F.col(f"a_{index}").alias("i"), F.col(f"b_{index}").alias("j"), "distance")


def turned(df: DataFrame, x: str, y: str, degrees: float) -> DataFrame:
    """Points turned about z so that the x axis comes to lie ``degrees`` further."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return df.withColumns({x: F.col(x) * c + F.col(y) * s, y: F.col(y) * c - F.col(x) * s})


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Eigenvectors of symmetric 3 x 3 matrices as rows, largest eigenvalue first, largest component positive; right-handed."""
    m = np.stack([np.stack(r, axis=-1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=-2).astype(float)
    v = np.linalg.eigh(np.nan_to_num(m))[1][:, :, ::-1].transpose(0, 2, 1)
    top = np.take_along_axis(v, np.abs(v).argmax(axis=2)[:, :, None], axis=2)
    v = v * np.where(top < 0, -1.0, 1.0)
    v[:, 2] *= np.where(np.linalg.det(v) < 0, -1.0, 1.0)[:, None]
    return pd.Series(list(v.reshape(-1, 9)))


def along_axes(points: DataFrame, by: Names, xyz: Names) -> DataFrame:
    """Each structure centred and turned so that its largest extent lies along the first axis, its least along the third.

    Only sums of products, one row per structure, leave the map side; the axes come back to the points by a
    join on ``by``. Points with a null are left out.
    """
    points = points.dropna(subset=list(xyz))
    a = [F.col(c) for c in xyz]
    n = F.count(F.lit(1))
    spread = {f"_m{i}{j}": F.covar_pop(a[i], a[j]) for i in range(3) for j in range(i, 3)}
    sums = points.groupBy(*by).agg(n.alias("_n"), *(F.avg(c).alias(f"_c{k}") for k, c in enumerate(a)), *(v.alias(k) for k, v in spread.items()))
    axes = sums.select(*by, "_c0", "_c1", "_c2", _axes(*spread).alias("_axes"))
    both = points.join(axes, list(by)) if by else points.crossJoin(F.broadcast(axes))  # one row of axes
    moved = [F.col(c) - F.col(f"_c{k}") for k, c in enumerate(xyz)]
    new = {c: sum((moved[j] * F.col("_axes")[3 * k + j] for j in range(3)), F.lit(0.0)) for k, c in enumerate(xyz)}
    return both.withColumns(new).drop("_c0", "_c1", "_c2", "_axes")


def best_of_rounds(df: DataFrame, by: Names, variant: str, wild: Column, energy: str) -> DataFrame:
    """The least ``energy`` over repeats of each variant, and how far it lies above that of the ``wild`` one: by, variant, best, rounds, ddg.

    Nulls, NaN and infinite energies are left out; ``ddg`` is null where ``by`` has no wild variant.
    """
    e = F.col(energy)
    usable = df.filter(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    best = usable.groupBy(*by, variant).agg(F.min(e).alias("best"), F.count(e).alias("rounds"))
    base = F.min(F.when(wild, F.col("best"))).over(Window.partitionBy(*by))
    return best.withColumn("ddg", F.col("best") - base)


def stacked(df: DataFrame, by: Names, set_col: str, pos: str, y: str, out: str = "top") -> DataFrame:
    """Sets drawn on top of each other: the sum of ``y`` over this and all smaller sets at the same position; nulls add nothing."""
    w = Window.partitionBy(*by, pos).orderBy(set_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.coalesce(F.col(y), F.lit(0.0))).over(w))


def outside_slab(points: DataFrame, z: str, middle: float, half: float) -> DataFrame:
    """Points at least ``half`` away from the plane z = ``middle``; those of unknown z are left out."""
    return points.filter(F.abs(F.col(z) - middle) >= half)


def without_first(df: DataFrame, keys: Names, order: Names, n: int) -> DataFrame:
    """Sets without their first ``n`` rows, as one leaflet that is to hold fewer than the other."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") > n).drop("_r")


def pore(profile: DataFrame, by: Names, along: str, radius: str) -> DataFrame:
    """Least radius of each pore, where it is, and its geometric factor, the sum of ds / area: by, least_radius, at, factor.

    ds is the step in ``along`` to the next point; the radius that of the point the step leaves. Points with a null or no positive radius are left out.
    """
    rows = profile.filter((F.col(radius) > 0) & F.col(along).isNotNull()).select(*by, F.col(along).alias("_s"), F.col(radius).alias("_r"))
    step = F.lead("_s").over(Window.partitionBy(*by).orderBy("_s")) - F.col("_s")
    rows = rows.withColumn("_f", step / (F.pi() * F.col("_r") * F.col("_r")))
    best = F.min(F.struct("_r", "_s"))
    return rows.groupBy(*by).agg(best.alias("b"), F.coalesce(F.sum("_f"), F.lit(0.0)).alias("factor")).select(*by, F.col("b._r").alias("least_radius"), F.col("b._s").alias("at"), "factor")
