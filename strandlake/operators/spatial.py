"""Points in space and on lattices: images, occupancy, placement, apportionment, affine maps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def minimum_image(d: Column, length: Column | float) -> Column:
    """Shortest image of a difference in a periodic box; halves round to even."""
    return d - length * F.rint(d / length)


def apportioned(df: DataFrame, total: float, weight: str, absolute: str | None = None, by: Names = ()) -> DataFrame:
    """Share of ``total`` for each row: its absolute number if it has one, else its weight's part of the rest, cut to whole ones: adds count.

    What cutting leaves over isn't given out.
    """
    w = Window.partitionBy(*by)
    fixed = F.coalesce(F.col(absolute), F.lit(0)) if absolute else F.lit(0)
    rest = F.lit(total) - F.sum(fixed).over(w)
    free = F.when(fixed == 0, F.col(weight)).otherwise(0.0)
    return df.withColumn("count", F.when(fixed > 0, fixed).otherwise(F.floor(F.greatest(F.lit(0.0), rest) * F.try_divide(free, F.sum(free).over(w)))).cast("long"))


def salt_counts(volume: Column, concentration: float, charge: Column) -> Column:
    """struct(cations, anions): pairs by concentration (mol/l, volume in nm3) plus what balances the net charge."""
    pairs = F.floor(volume * concentration * 0.6022140857 + 0.5)
    return F.struct((pairs + F.when(charge < 0, -charge).otherwise(0)).cast("long").alias("cations"), (pairs + F.when(charge > 0, charge).otherwise(0)).cast("long").alias("anions"))


def lattice(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All cells c0, c1, ... of a lattice, made from one range of numbers."""
    size = math.prod(shape)
    cells, below = [], size
    for k, n in enumerate(shape):
        below //= n
        cells.append(F.floor(F.col("id") / below).cast("int") % n if k else F.floor(F.col("id") / below).cast("int"))
    return spark.range(size).select(*(c.cast("int").alias(f"c{k}") for k, c in enumerate(cells)))


def cell_of(value: Column, length: float, n: int) -> Column:
    """Periodic cell of a coordinate."""
    return F.pmod(F.floor(value / length * n), F.lit(n)).cast("int")


def occupied(points: DataFrame, xyz: Names, lengths: Sequence[float], shape: Sequence[int], reach: float = 0.0) -> DataFrame:
    """Cells that hold a point or lie within ``reach`` of one, periodic: c0, c1, ..., n (points counted)."""
    steps = [math.ceil(reach / (length / n)) for length, n in zip(lengths, shape)]
    shifts = [s for s in product(*(range(-k, k + 1) for k in steps)) if sum((d * length / n) ** 2 for d, length, n in zip(s, lengths, shape)) <= reach * reach or not any(s)]
    cells = [cell_of(F.col(c), length, n) for c, length, n in zip(xyz, lengths, shape)]
    spread = F.explode(F.array(*(F.struct(*(F.pmod(c + d, F.lit(n)).cast("int").alias(f"c{k}") for k, (c, d, n) in enumerate(zip(cells, s, shape)))) for s in shifts))).alias("c")
    return points.select(spread).groupBy(*(F.col(f"c.c{k}").alias(f"c{k}") for k in range(len(shape)))).agg(F.count(F.lit(1)).alias("n"))


def free_cells(spark: SparkSession, taken: DataFrame, shape: Sequence[int]) -> DataFrame:
    return lattice(spark, shape).join(taken, [f"c{k}" for k in range(len(shape))], "left_anti")


def placed(cells: DataFrame, names: DataFrame, order: Names, seed: int = 0) -> DataFrame:
    """Fill cells with species: names (name, count) take the cells in an order shuffled by hash: order columns, name.

    Cells are numbered by ranges of the hash, each range in its own task; species get stretches of numbers.
    """
    ranged = cells.withColumn("_h", F.xxhash64(F.lit(seed), *order)).repartitionByRange("_h", *order).withColumn("_r", F.spark_partition_id())
    inner = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy("_h", *order)) - 1)
    sizes = ranged.groupBy("_r").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbers = inner.join(F.broadcast(sizes), "_r").withColumn("_at", F.col("_n") + F.col("_before"))  # one row per partition
    upto = F.sum("count").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    spans = names.filter("count > 0").select("name", (upto - F.col("count")).alias("_lo"), upto.alias("_hi")).collect()  # one row per species
    chosen = F.coalesce(*(F.when((F.col("_at") >= s["_lo"]) & (F.col("_at") < s["_hi"]), F.lit(s["name"])) for s in spans)) if spans else F.lit(None).cast("string")
    return numbers.select(*order, chosen.alias("name")).filter("name IS NOT NULL")


def moved(df: DataFrame, x: str, y: str, steps: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Apply steps in turn: ("rotate", degrees, 0) about the origin, ("translate", dx, dy), ("scale", sx, sy)."""
    for kind, a, b in steps:
        u, v = F.col(x), F.col(y)
        if kind == "rotate":
            c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
            u, v = u * c - v * s, u * s + v * c
        elif kind == "translate":
            u, v = u + a, v + b
        elif kind == "scale":
            u, v = u * a, v * b
        else:
            raise ValueError(f"unknown step {kind}")
        df = df.withColumns({x: u, y: v})
    return df


def pair_energy(sigma: Column | float, epsilon: Column | float, r: Column) -> Column:
    """4e((s/r)^12 - (s/r)^6); null where r*r is under 1e-12."""
    q = F.pow(F.try_divide(F.lit(sigma) if not isinstance(sigma, Column) else sigma, r), 6)
    return F.when(r * r >= 1e-12, 4 * epsilon * (q * q - q))


def native_fraction(distance: Column, cutoff: Column, factor: float = 1.2) -> Column:
    """Share of contacts closer than factor * cutoff; 0 without contacts."""
    return F.coalesce(F.avg(F.when(distance < factor * cutoff, 1.0).otherwise(0.0)), F.lit(0.0))


def superposed_rmsd(frames: DataFrame, reference: DataFrame, by: Names, atom: str, xyz: Names = ("x", "y", "z")) -> DataFrame:
    """Distance of each frame to the reference after the best rotation and shift: by, n, rmsd.

    Atoms meet by name; those that either lacks are left out. Only the sums that the rotation
    hangs on are gathered per frame (a 3 x 3 matrix), and it is found where they lie.
    """
    left = frames.select(*by, atom, *(F.col(c).cast("double").alias(f"_a{k}") for k, c in enumerate(xyz)))
    right = reference.select(atom, *(F.col(c).cast("double").alias(f"_b{k}") for k, c in enumerate(xyz)))
    both = left.join(right, atom)
    a, b = ([F.col(f"_{side}{k}") for k in range(3)] for side in "ab")
    sums = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.covar_pop(p, q) for p in a for q in b)).alias("_c"),
        (sum((F.var_pop(c) for c in (*a, *b)), F.lit(0.0))).alias("_v"),
    )
    names = [*by, "n", "rmsd"]

    def solve(batches):
        for batch in batches:
            out = []
            for c, v in zip(batch.column("_c").to_pylist(), batch.column("_v").to_pylist()):
                m = np.array(c).reshape(3, 3)
                u, d, w = np.linalg.svd(m)
                d[2] *= np.sign(np.linalg.det(u) * np.linalg.det(w)) or 1.0  # no mirror image
                out.append(math.sqrt(max(0.0, v - 2 * d.sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:-1]), pa.array(out, pa.float64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by, "n").schema)
    return sums.mapInArrow(solve, f"{kinds}, rmsd double")


def superposed(frames: DataFrame, reference: DataFrame, by: Names, atom: str, xyz: Names = ("x", "y", "z")) -> DataFrame:
    """All atoms of each frame after the rotation and shift that bring it nearest to the reference: by, atom, coordinates.

    The rotation is found from the atoms that both have, by name (see :func:`superposed_rmsd`); only it, one row for each frame, comes
    back to the atoms. Frames without an atom in common are left out.
    """
    left = frames.select(*by, atom, *(F.col(c).cast("double").alias(f"_a{k}") for k, c in enumerate(xyz)))
    right = reference.select(atom, *(F.col(c).cast("double").alias(f"_b{k}") for k, c in enumerate(xyz)))
    a, b = ([F.col(f"_{side}{k}") for k in range(3)] for side in "ab")
    sums = left.join(right, atom).groupBy(*by).agg(F.array(*(F.covar_pop(p, q) for p in a for q in b)).alias("_c"), F.array(*(F.avg(c) for c in (*a, *b))).alias("_m"))

    def solve(batches):
        for batch in batches:
            turns = []
            for c in batch.column("_c").to_pylist():
                u, _, w = np.linalg.svd(np.array(c).reshape(3, 3))
                u[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(w)) or 1.0  # no mirror image
                turns.append((u @ w).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in by), batch.column("_m"), pa.array(turns, pa.list_(pa.float64()))], [*by, "_m", "_t"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema)
    turned = left.join(sums.mapInArrow(solve, f"{kinds}, _m array<double>, _t array<double>"), list(by))
    off = [a[k] - F.col("_m")[k] for k in range(3)]
    new = [sum((off[i] * F.col("_t")[3 * i + k] for i in range(3)), F.col("_m")[3 + k]) for k in range(3)]
    return turned.select(*by, atom, *(v.alias(c) for v, c in zip(new, xyz)))
