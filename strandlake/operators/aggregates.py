"""Aggregations over sets of points: statistics, features, histograms and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.sequence import in_set, numbered, trapezoid

Names = Sequence[str]


def statistics(df: DataFrame, keys: Names, order: Names, y: str) -> DataFrame:
    """Per set: n, min, max, avg, sd (n-1; 0 for one point), sum, and the first positions of min and max.

    Nulls in y don't count; a set of nulls only has null statistics.
    """
    rows = numbered(df, keys, order)
    return rows.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.avg(y).alias("avg"),
        F.coalesce(F.stddev_samp(y), F.when(F.count(y) > 0, 0.0)).alias("sd"),
        F.sum(y).alias("sum"),
        F.min(F.when(F.col(y).isNotNull(), F.struct(F.col(y).alias("v"), "pos")))["pos"].alias("imin"),
        F.min(F.when(F.col(y).isNotNull(), F.struct((-F.col(y)).alias("v"), "pos")))["pos"].alias("imax"),
    )


def features(df: DataFrame, keys: Names, order: Names, x: str, y: str) -> DataFrame:
    """Per set: median, slope and intercept (null for up to 3 points), barycentres, x at max y, y at max x, integral."""
    w = in_set(keys, order)
    rows = numbered(df, keys, order).withColumn("_area", trapezoid(x, y, w))
    fit = F.count(F.lit(1)) > 3
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(y, 0.5).alias("median"),
        F.when(fit, F.regr_slope(y, x)).alias("slope"),
        F.when(fit, F.regr_intercept(y, x)).alias("intercept"),
        F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(y)).alias("barycentre_x"),
        F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(x)).alias("barycentre_y"),
        F.min(F.struct((-F.col(y)).alias("v"), "pos", F.col(x).alias("x")))["x"].alias("x_at_ymax"),
        F.min(F.struct((-F.col(x)).alias("v"), "pos", F.col(y).alias("y")))["y"].alias("y_at_xmax"),
        F.coalesce(F.sum("_area"), F.lit(0.0)).alias("integral"),
    )


def _crossing(level: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return x0 + (x1 - x0) * (level - y0) / (y1 - y0)


def first_zero(df: DataFrame, keys: Names, order: Names, x: str, y: str) -> DataFrame:
    """Per set: x of the first change of sign of y, interpolated. Sets without one are left out."""
    w = in_set(keys, order)
    rows = df.select(*keys, F.row_number().over(w).alias("_p"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    crossing = rows.filter("y1 IS NOT NULL AND (y0 = 0 OR y0 * y1 < 0)")
    at = F.when(F.col("y0") == 0, F.col("x0")).otherwise(_crossing(F.lit(0.0), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return crossing.groupBy(*keys).agg(F.min(F.struct("_p", at.alias("x")))["x"].alias("zero_x"))


def rise_time(df: DataFrame, keys: Names, order: Names, x: str, y: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Per set: time from the first rise through ``low`` to the first rise through ``high`` of the range of y."""
    w = in_set(keys, order)
    whole = Window.partitionBy(*keys)
    rows = df.select(
        *keys, F.row_number().over(w).alias("_p"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"),
        F.min(y).over(whole).alias("lo"), F.max(y).over(whole).alias("hi"),
    )
    span = F.col("hi") - F.col("lo")

    def first(part: float) -> Column:
        level = F.col("lo") + part * span
        hit = (F.col("y0") < level) & (F.col("y1") >= level)
        return F.min(F.when(hit, F.struct("_p", _crossing(level, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("x"))))["x"]

    out = rows.groupBy(*keys).agg(first(low).alias("_a"), first(high).alias("_b"))
    return out.filter("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, (F.col("_b") - F.col("_a")).alias("rise_time"))


def half_width(df: DataFrame, keys: Names, order: Names, x: str, y: str) -> DataFrame:
    """Per set: width of the peak at the first maximum, halfway between min and max, interpolated.

    Sets whose peak doesn't fall to that level on both sides are left out.
    """
    rows = numbered(df, keys, order)
    top = rows.groupBy(*keys).agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.min(F.struct((-F.col(y)).alias("v"), "pos"))["pos"].alias("peak"))
    w = in_set(keys, order)
    rows = rows.withColumn("xn", F.lead(x).over(w)).withColumn("yn", F.lead(y).over(w)).withColumn("xb", F.lag(x).over(w)).withColumn("yb", F.lag(y).over(w))
    rows = rows.join(top, list(keys)).withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    left = (F.col("pos") < F.col("peak")) & (F.col(y) <= F.col("mid")) & (F.col("yn") > F.col("mid"))
    right = (F.col("pos") > F.col("peak")) & (F.col(y) <= F.col("mid")) & (F.col("yb") > F.col("mid"))
    out = rows.groupBy(*keys).agg(
        F.max(F.when(left, F.struct("pos", _crossing(F.col("mid"), F.col(x), F.col(y), F.col("xn"), F.col("yn")).alias("x"))))["x"].alias("_a"),
        F.min(F.when(right, F.struct("pos", _crossing(F.col("mid"), F.col("xb"), F.col("yb"), F.col(x), F.col(y)).alias("x"))))["x"].alias("_b"),
    )
    return out.filter("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, (F.col("_b") - F.col("_a")).alias("half_width"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], cumulative: bool = False, normalised: bool = False) -> DataFrame:
    """Counts between successive edges, ascending or descending: bin, edge (its far end), y.

    A bin is closed at both ends and the first that holds a value takes it. Values outside
    all bins don't count but stay in the divisor of a normalised histogram, as do nulls not.
    A first row of 0 stands at the first edge.
    """
    lo = [min(a, b) for a, b in zip(edges, edges[1:])]
    hi = [max(a, b) for a, b in zip(edges, edges[1:])]
    v = F.col(value)
    which = F.coalesce(*(F.when(v.between(a, b), F.lit(k + 1)) for k, (a, b) in enumerate(zip(lo, hi))))
    counts = df.filter(v.isNotNull()).select(which.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())  # one row per bin by now
    counts = counts.withColumn("_all", total)
    spark = df.sparkSession
    bins = spark.range(len(edges)).select(F.col("id").cast("int").alias("bin"), F.element_at(F.array(*(F.lit(float(e)) for e in edges)), (F.col("id") + 1).cast("int")).alias("edge"))
    out = bins.join(F.broadcast(counts), "bin", "left")
    out = out.withColumn("y", F.coalesce(F.col("_n"), F.lit(0)).cast("double"))
    if normalised:
        out = out.withColumn("y", F.col("y") / F.max("_all").over(Window.partitionBy()))
    if cumulative:
        out = out.withColumn("y", F.sum("y").over(Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("bin", "edge", "y")


def cell(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0-based bin of equal width; values at or beyond the ends go to the end bins."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / (high - low) * bins))).cast("int")


def histogram_2d(df: DataFrame, by: Names, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """Density over a square of equal cells: by, ix, iy, n, density. Points outside are left out."""
    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    counts = df.filter(inside).groupBy(*by, cell(F.col(x), low, high, bins).alias("ix"), cell(F.col(y), low, high, bins).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    area = ((high - low) / bins) ** 2
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * area))


def density_difference(a: DataFrame, b: DataFrame, cells: Names, value: str) -> DataFrame:
    """value of ``a`` minus that of ``b`` over all cells of either; a missing cell counts as 0."""
    left, right = a.select(*cells, F.col(value).alias("_a")), b.select(*cells, F.col(value).alias("_b"))
    return left.join(right, list(cells), "full_outer").select(*cells, (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("difference"))


def binned_mean(df: DataFrame, by: Names, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """Mean of y in equal bins of x: by, bin, n, mean. Empty bins have no row."""
    return df.filter(F.col(x).between(low, high)).groupBy(*by, cell(F.col(x), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))


def free_energy_grid(df: DataFrame, x: str, y: str, weight: str, bins: int, kt: float, pad: float = 0.02) -> DataFrame:
    """-kT ln of the weight in each cell of a padded grid, 0 at the lowest: ix, iy, weight, free_energy.

    The range of each axis is widened by ``pad`` of it on either side; empty cells have no row.
    """
    ends = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()  # four numbers
    if ends[0] is None or ends[2] is None:
        ends = (0.0, 1.0, 0.0, 1.0)
    (x0, x1), (y0, y1) = ((lo - pad * (hi - lo), hi + pad * (hi - lo)) for lo, hi in (ends[:2], ends[2:]))
    cells = df.groupBy(cell(F.col(x), x0, x1, bins).alias("ix"), cell(F.col(y), y0, y1, bins).alias("iy")).agg(F.sum(weight).alias("_w"))
    whole = Window.partitionBy()  # at most bins * bins rows
    cells = cells.filter("_w > 0").withColumn("weight", F.col("_w") / F.sum("_w").over(whole)).withColumn("_f", -kt * F.log("weight"))
    return cells.select("ix", "iy", "weight", (F.col("_f") - F.min("_f").over(whole)).alias("free_energy"))


def extents(df: DataFrame, keys: Names, x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def polygon(df: DataFrame, keys: Names, order: Names, x: str, y: str, closed: bool = False) -> DataFrame:
    """Area (shoelace, always closed) and perimeter (with the closing edge only if ``closed``) of each set."""
    w = in_set(keys, order)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(
        *keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("xn"), F.lead(y).over(w).alias("yn"), F.first(x).over(whole).alias("xf"), F.first(y).over(whole).alias("yf")
    )
    x1, y1 = F.coalesce("xn", "xf"), F.coalesce("yn", "yf")
    edge = F.hypot(x1 - F.col("x0"), y1 - F.col("y0"))
    return rows.groupBy(*keys).agg(
        (F.abs(F.sum(F.col("x0") * y1 - x1 * F.col("y0"))) / 2).alias("area"),
        F.coalesce(F.sum(edge if closed else F.when(F.col("xn").isNotNull(), edge)), F.lit(0.0)).alias("perimeter"),
    )


def fit_quality(df: DataFrame, keys: Names, measured: str, fitted: str) -> DataFrame:
    """chi2, RMS relative error (null where a measured value is 0) and Theil's U of each set."""
    d = F.col(fitted) - F.col(measured)
    return df.groupBy(*keys).agg(
        F.sum(d * d).alias("chi2"),
        F.when(F.min(F.abs(measured)) > 0, F.sqrt(F.avg(F.pow(F.try_divide(d, F.col(measured)), 2)))).alias("rms_relative"),
        F.try_divide(F.sqrt(F.avg(d * d)), F.sqrt(F.avg(F.col(measured) * F.col(measured)))).alias("theil_u"),
    )


def rate(accepted: Column, attempted: Column) -> Column:
    """accepted / attempted, 0 where nothing was attempted."""
    return F.when(attempted > 0, accepted / attempted).otherwise(0.0)


def entropy(df: DataFrame, by: Names, p: str) -> DataFrame:
    """H = -sum p ln p (zeros skipped) and H / ln(number of states) per group."""
    positive = F.when(F.col(p) > 0, F.col(p))
    out = df.groupBy(*by).agg((-F.sum(positive * F.log(positive))).alias("entropy"), F.count(F.lit(1)).alias("_m"))
    return out.withColumn("efficiency", F.try_divide(F.col("entropy"), F.log("_m"))).drop("_m")


def gyration(df: DataFrame, by: Names, xyz: Names = ("x", "y", "z")) -> DataFrame:
    """Radius of gyration of points of equal mass per group."""
    return df.groupBy(*by).agg(F.sqrt(sum((F.var_pop(c) for c in xyz), F.lit(0.0))).alias("rg"))


def centroid_distances(df: DataFrame, by: Names, part: str, xyz: Names = ("x", "y", "z")) -> DataFrame:
    """Distance between the centroids of each two parts: by, part_a < part_b, distance."""
    centres = df.groupBy(*by, part).agg(*(F.avg(c).alias(c) for c in xyz))
    a = centres.select(*by, F.col(part).alias("part_a"), *(F.col(c).alias(f"a_{c}") for c in xyz))
    b = centres.select(*(F.col(k).alias(f"b_{k}") for k in by), F.col(part).alias("part_b"), *(F.col(c).alias(f"b_{c}") for c in xyz))
    on = F.col("part_a") < F.col("part_b")
    for k in by:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    d = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in xyz), F.lit(0.0)))
    return a.join(b, on).select(*by, "part_a", "part_b", d.alias("distance"))
