"""Operators on ordered sets of points: one set per combination of ``keys``, rows ordered by ``order``.

All are windows or self-contained projections, so Spark keeps one shuffle by ``keys``
for any chain of them. ``order`` must determine the order within a set completely;
rows with null keys form a set of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def in_set(keys: Names, order: Names):
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: Names, order: Names, pos: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in its set."""
    return df.withColumn(pos, (F.row_number().over(in_set(keys, order)) - 1).cast("long"))


def running(df: DataFrame, keys: Names, order: Names, x: str, y: str, width: int, how: str) -> DataFrame:
    """Running ``avg``, ``std``, ``median``, ``min`` or ``max`` of y over ``width`` successive points.

    Out: keys, pos (of the window's first point), x, y. x is the windows's mean x; for the
    median the centre x (mean of the two centres of an even width). Only complete windows come
    out. As in the operators' model a width below 2 is an error and a set of no more than
    ``width`` points has no window.
    """
    if width < 2:
        raise ValueError("a running window needs at least 2 points")
    w = in_set(keys, order)
    frame = w.rowsBetween(0, width - 1)
    stat = {
        "avg": lambda: F.avg(y).over(frame),
        "std": lambda: F.stddev_samp(y).over(frame),
        "median": lambda: F.percentile(y, 0.5).over(frame),
        "min": lambda: F.min(y).over(frame),
        "max": lambda: F.max(y).over(frame),
    }[how]()
    half = width // 2
    centre = F.lead(x, half).over(w) if width % 2 else (F.lead(x, half - 1).over(w) + F.lead(x, half).over(w)) / 2
    out = df.select(
        *keys,
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
        F.count(F.lit(1)).over(frame).alias("_k"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
        (centre if how == "median" else F.avg(x).over(frame)).alias("x"),
        stat.alias("y"),
    )
    return out.filter((F.col("_k") == width) & (F.col("_n") > width)).drop("_k", "_n")


def cumulative_sum(df: DataFrame, keys: Names, order: Names, y: str, out: str = "running_sum") -> DataFrame:
    return df.withColumn(out, F.sum(y).over(in_set(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def trapezoid(x: str, y: str, w) -> Column:
    """Area between a point and the one before it; null at the first point."""
    return (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2


def cumulative_integral(df: DataFrame, keys: Names, order: Names, x: str, y: str, out: str = "integral") -> DataFrame:
    """Trapezoid integral from the first point on, 0 there. Sets of under 3 points are left out."""
    w = in_set(keys, order)
    rows = df.withColumn("_area", trapezoid(x, y, w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return rows.filter("_n >= 3").withColumn(out, F.coalesce(F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).drop("_area", "_n")


def difference(df: DataFrame, keys: Names, order: Names, x: str, y: str, kind: str = "forward") -> DataFrame:
    """Slope between neighbours: keys, pos, x, dy.

    ``forward`` stands at the first of two points, ``backward`` at the second, ``centred`` at
    the middle of three. Points of equal x give null.
    """
    w = in_set(keys, order)
    pos = (F.row_number().over(w) - 1).cast("long").alias("pos")
    x0, y0, x1, y1 = {
        "forward": (F.col(x), F.col(y), F.lead(x).over(w), F.lead(y).over(w)),
        "backward": (F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y)),
        "centred": (F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)),
    }[kind]
    out = df.select(*keys, pos, F.col(x).alias("x"), x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"))
    out = out.filter("_x0 IS NOT NULL AND _x1 IS NOT NULL")
    return out.select(*keys, "pos", "x", F.try_divide(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0")).alias("dy"))


def seasonal_difference(df: DataFrame, keys: Names, order: Names, y: str, period: int) -> DataFrame:
    """y_i - y_(i+period); the last ``period`` points of a set have none."""
    w = in_set(keys, order)
    rows = df.withColumn("_later", F.lead(y, period).over(w)).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return rows.filter("_later IS NOT NULL").withColumn("dy", F.col(y) - F.col("_later")).drop("_later")


def lagged_pairs(df: DataFrame, keys: Names, order: Names, state: str, lag: int) -> DataFrame:
    """keys, i, j: the state of a row and of the row ``lag`` later in the same set."""
    rows = df.select(*keys, F.col(state).alias("i"), F.lead(state, lag).over(in_set(keys, order)).alias("j"))
    return rows.filter("i IS NOT NULL AND j IS NOT NULL")


def reversed_set(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The set back to front: ``pos`` counts from the last row."""
    w = Window.partitionBy(*keys)
    return numbered(df, keys, order).withColumn("pos", F.count(F.lit(1)).over(w) - 1 - F.col("pos"))


def sorted_set(df: DataFrame, keys: Names, by: str, order: Names, descending: bool = False) -> DataFrame:
    """``pos`` by the column ``by``, ties in the former order."""
    first = F.col(by).desc() if descending else F.col(by).asc()
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy(first, *order)) - 1).cast("long"))


def sliced(df: DataFrame, keys: Names, order: Names, first: int, last: int) -> DataFrame:
    """Rows at positions first..last, both included, renumbered from 0."""
    return numbered(df, keys, order).filter(F.col("pos").between(first, last)).withColumn("pos", F.col("pos") - first)


def without_range(df: DataFrame, keys: Names, order: Names, first: int, last: int) -> DataFrame:
    """All rows but those at positions first..last; ``pos`` closes the gap."""
    rows = numbered(df, keys, order).filter(~F.col("pos").between(first, last))
    return rows.withColumn("pos", F.when(F.col("pos") > last, F.col("pos") - (last - first + 1)).otherwise(F.col("pos")))


def every(df: DataFrame, keys: Names, order: Names, start: int, step: int) -> DataFrame:
    """Systematic sample: rows start, start+step, ... (1-based) of sets of more than 2 points."""
    rows = numbered(df, keys, order).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    picked = (F.col("pos") >= start - 1) & ((F.col("pos") - (start - 1)) % step == 0)
    return rows.filter(picked & (F.col("_n") > 2)).drop("_n")


def resized(df: DataFrame, keys: Names, order: Names, length: int, values: Names) -> DataFrame:
    """Each set cut to ``length`` rows, or padded with rows of 0: keys, pos, values."""
    rows = numbered(df, keys, order)
    kept = rows.filter(F.col("pos") < length).select(*keys, "pos", *values)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < length)
    pad = sizes.select(*keys, F.explode(F.sequence(F.col("_n"), F.lit(length - 1).cast("long"))).alias("pos"), *(F.lit(0.0).alias(v) for v in values))
    return kept.unionByName(pad)


def correlated(df: DataFrame, keys: Names, order: Names, a: str, b: str, lags: int, covariance: bool = False) -> DataFrame:
    """Cross-correlation at lags 0..lags-1: keys, lag, value = sum a_j*b_(j+lag) over |value at lag 0|.

    Means are taken off only with ``covariance``. Pairs are made by a window, one per lag and
    row, never across sets.
    """
    w = in_set(keys, order)
    whole = Window.partitionBy(*keys)
    mean = (lambda c: F.col(c) - F.avg(c).over(whole)) if covariance else F.col
    rows = df.select(*keys, *(F.col(c) for c in order if c not in keys), mean(a).alias("_a"), mean(b).alias("_b"))
    rows = rows.select(*keys, "_a", F.array(*(F.lead("_b", k).over(w) for k in range(lags))).alias("_all"))
    rows = rows.select(*keys, "_a", F.posexplode("_all").alias("lag", "_later"))
    sums = rows.groupBy(*keys, "lag").agg(F.sum(F.col("_a") * F.col("_later")).alias("_s"))
    at0 = F.abs(F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(whole))
    return sums.withColumn("value", F.try_divide(F.col("_s"), at0)).drop("_s")


def filtered(df: DataFrame, keys: Names, order: Names, x: str, y: str, weights: Sequence[float]) -> DataFrame:
    """Digital filter: each complete window of y times ``weights``; x is the window's centre."""
    w = in_set(keys, order)
    m = len(weights)
    total = sum((F.lead(y, k).over(w) * float(c) for k, c in enumerate(weights)), F.lit(0.0))
    out = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("pos"), ((F.col(x) + F.lead(x, m - 1).over(w)) / 2).alias("x"), total.alias("y"))
    return out.filter("x IS NOT NULL")


def taper(kind: str, pos: Column, n: Column) -> Column:
    """Data window at position ``pos`` of ``n``: triangular, hanning, welch, hamming, blackman or parzen."""
    t = 2 * F.pi() * pos / (n - 1)
    half = 0.5 * (n - 1)
    return {
        "triangular": lambda: 1 - F.abs((pos - half) / half),
        "hanning": lambda: 0.5 - 0.5 * F.cos(t),
        "welch": lambda: 1 - F.pow((pos - half) / (0.5 * (n + 1)), 2),
        "hamming": lambda: 0.54 - 0.46 * F.cos(t),
        "blackman": lambda: 0.42 - 0.5 * F.cos(t) + 0.08 * F.cos(2 * t),
        "parzen": lambda: 1 - F.abs((pos - half) / (0.5 * (n + 1))),
    }[kind]()


def convolved(df: DataFrame, keys: Names, order: Names, y: str, kernel: Sequence[float]) -> DataFrame:
    """Full linear convolution with a short kernel: keys, pos (0..n+m-2), y."""
    rows = numbered(df, keys, order)
    spread = rows.select(*keys, "pos", F.col(y).alias("_y"), F.posexplode(F.array(*(F.lit(float(c)) for c in kernel))).alias("_k", "_c"))
    return spread.groupBy(*keys, (F.col("pos") + F.col("_k")).alias("pos")).agg(F.sum(F.col("_y") * F.col("_c")).alias("y"))


def dihedrals(df: DataFrame, keys: Names, order: Names, xyz: Names = ("x", "y", "z")) -> DataFrame:
    """Torsion of each four successive points: keys, pos, sin, cos, degrees. Four points on a line give null."""
    w = in_set(keys, order)
    p = [[F.lead(c, k).over(w) for c in xyz] for k in range(4)]
    rows = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("pos"), *(p[k][c].alias(f"_{k}{c}") for k in range(4) for c in range(3)))
    rows = rows.filter("_30 IS NOT NULL")

    def bond(a: int, b: int) -> list[Column]:
        return [F.col(f"_{b}{c}") - F.col(f"_{a}{c}") for c in range(3)]

    def cross(u, v):
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    def dot(u, v):
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    b1, b2, b3 = bond(0, 1), bond(1, 2), bond(2, 3)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    sine, cosine = dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2)), dot(n1, n2)
    rows = rows.select(*keys, "pos", sine.alias("_s"), cosine.alias("_c")).withColumn("_r", F.hypot("_s", "_c"))
    return rows.select(
        *keys, "pos", F.try_divide("_s", "_r").alias("sin"), F.try_divide("_c", "_r").alias("cos"), F.when(F.col("_r") > 0, F.degrees(F.atan2("_s", "_c"))).alias("degrees")
    )


def changes(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Rows whose ``value`` differs from the row before (the first always does)."""
    w = in_set(keys, order)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")
