"""Spectra, smooth curves and thinning of ordered points."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.operators.sequence import in_set, numbered
from strandlake.operators.spikes import blocked

Names = Sequence[str]


def spectrum(df: DataFrame, keys: Names, order: Names, y: str, frequencies: int | None = None) -> DataFrame:
    """Terms of the discrete Fourier transform over n: keys, k, re, im, magnitude, phase.

    Without ``frequencies`` all terms k = 0..n/2 of each set, else only so many of the lowest. Every point adds
    its share to each term, on the map side first; no set is ever gathered. ``magnitude`` counts both
    signs of a frequency; in the whole spectrum the one at n/2, which has one sign only, counts once.
    """
    rows = numbered(df, keys, order).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if frequencies is None:
        return _whole_spectrum(rows.select(*keys, "pos", "_n", F.col(y).alias("_y")), keys).drop("_n")
    terms = rows.select(*keys, "pos", "_n", F.col(y).alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(frequencies - 1))).alias("k")).filter(F.col("k") * 2 <= F.col("_n"))
    angle = 2 * F.pi() * ((F.col("pos") * F.col("k")) % F.col("_n")) / F.col("_n")
    sums = terms.groupBy(*keys, "k").agg((F.sum(F.col("_y") * F.cos(angle)) / F.max("_n")).alias("re"), (-F.sum(F.col("_y") * F.sin(angle)) / F.max("_n")).alias("im"))
    return sums.withColumn("magnitude", 2 * F.hypot("re", "im")).withColumn("phase", -F.atan2("im", "re"))


def _whole_spectrum(rows: DataFrame, keys: Names) -> DataFrame:
    """All terms from keys, pos, _n, _y (and _size, which is handed on with _n) in two grouped sums over pos = a * m + b, where m is the largest divisor of n up to its root.

    The sum over a hangs on k modulo n / m only, so a set costs n * (n / m + m / 2) products, n * n / 2 where n is prime.
    """
    root = F.floor(F.sqrt(F.col("_n").cast("double")))
    m = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), root), lambda q: F.col("_n") % q == 0))
    carried = [c for c in ("_n", "_size") if c in rows.columns]
    rows = rows.withColumn("_m", m).withColumn("_l", (F.col("_n") / F.col("_m")).cast("long"))
    inner = rows.select(*keys, *carried, "_l", "_m", "_y", (F.col("pos") % F.col("_m")).alias("_b"), F.floor(F.col("pos") / F.col("_m")).alias("_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l") - 1)).alias("_k"))
    angle = 2 * F.pi() * ((F.col("_a") * F.col("_k")) % F.col("_l")) / F.col("_l")
    inner = inner.groupBy(*keys, "_b", "_k").agg(F.sum(F.col("_y") * F.cos(angle)).alias("_u"), (-F.sum(F.col("_y") * F.sin(angle))).alias("_v"), *(F.max(c).alias(c) for c in (*carried, "_l", "_m")))
    each = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1), lambda q: q * F.col("_l") + F.col("_k"))).alias("k")
    outer = inner.select(*keys, "_b", "_u", "_v", *carried, each).filter(F.col("k") * 2 <= F.col("_n"))
    turn = 2 * F.pi() * ((F.col("_b") * F.col("k")) % F.col("_n")) / F.col("_n")
    re, im = F.cos(turn) * F.col("_u") + F.sin(turn) * F.col("_v"), F.cos(turn) * F.col("_v") - F.sin(turn) * F.col("_u")
    sums = outer.groupBy(*keys, F.col("k").cast("int").alias("k")).agg((F.sum(re) / F.max("_n")).alias("re"), (F.sum(im) / F.max("_n")).alias("im"), *(F.max(c).alias(c) for c in carried))
    signs = F.when(F.col("k") * 2 == F.col("_n"), 1).otherwise(2)
    return sums.withColumn("magnitude", signs * F.hypot("re", "im")).withColumn("phase", -F.atan2("im", "re"))


def _half_away(v: Column, digits: int) -> Column:
    """Round the product with 10^digits, halves away from zero; values beyond it stay."""
    s = v * 10.0**digits
    r = F.rint(s)
    r = F.when((F.abs(s - r) == 0.5) & (F.abs(r) < F.abs(s)), s + 0.5 * F.signum(s)).otherwise(r)
    return F.when(F.abs(s) == float("inf"), v).otherwise(r / 10.0**digits) + F.lit(0.0)


def _add_up(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Terms from points sorted by keys, k, pos, added one by one; the sums of the last term go on in the next batch."""
    current, a, b, n = None, None, None, 0

    def term():
        if a is None:
            return (*current, None, None, None)
        re, im = a / n, -b / n
        length = math.sqrt(re * re + im * im)
        return (*current, re, im, (1 if 2 * current[-1] == n else 2) * (math.hypot(re, im) if length == math.inf else length))

    for batch in batches:
        done = []
        names = zip(*(batch.column(c).to_pylist() for c in (*keys, "k")))
        for name, pos, size, y in zip(names, *(batch.column(c).to_pylist() for c in ("pos", "_n", "_y"))):
            if name != current:
                if current is not None:
                    done.append(term())
                current, a, b, n = name, None, None, size
            if y is not None:
                angle = 2 * math.pi * ((pos * name[-1]) % n) / n
                a, b = (a or 0.0) + y * math.cos(angle), (b or 0.0) + y * math.sin(angle)
        yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in done], f.type) for c, f in enumerate(schema)], schema=schema)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(term(), schema)], schema=schema)


def rounded_spectrum(df: DataFrame, keys: Names, order: Names, y: str, digits: int) -> DataFrame:
    """The whole :func:`spectrum` as a sum in the order of the points gives it, rounded to ``digits``, halves away from zero: keys, k, re, im, magnitude.

    Means of decimals often lie half-way between two rounded numbers, and the last bits of the sum, which hang on its order,
    then tell which it is. Terms that lie nearer to a half than sums in any order can err are added up again point by point in one task,
    which holds one sum; the others come out the same in any order.
    """
    of_set = Window.partitionBy(*keys)
    rows = numbered(df, keys, order).select(*keys, "pos", F.count(F.lit(1)).over(of_set).alias("_n"), F.col(y).cast("double").alias("_y"), F.avg(F.abs(F.col(y).cast("double"))).over(of_set).alias("_size"))
    terms = _whole_spectrum(rows, keys)
    off = 8 * (F.col("_n") + 32) * 2.0**-53 * F.col("_size") * 10.0**digits  # twice what sums of n products and their angles err at most, in either order
    from_half = [F.abs(F.abs(s - F.rint(s)) - 0.5) for s in (F.col(c) * 10.0**digits for c in ("re", "im", "magnitude"))]
    near = F.coalesce(reduce(or_, ((h <= off) | F.isnan(h) for h in from_half)), F.lit(False))
    terms = terms.select(*keys, "k", "re", "im", "magnitude", near.alias("_near"))
    asked = terms.filter("_near").select(*(F.col(c).alias(f"_{n}") for n, c in enumerate(keys)), "k")
    # Spark takes the terms for as few as their points' file is small, and would send them to the driver.
    points = rows.join(asked.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{n}")) for n, c in enumerate(keys)] or F.lit(True)).select(*keys, "k", "pos", "_n", "_y")
    points = points.repartition(*keys, "k").sortWithinPartitions(*keys, "k", "pos")
    schema = terms.drop("_near").schema
    added = points.mapInArrow(partial(_add_up, keys=list(keys), schema=to_arrow_schema(schema)), schema)
    both = terms.filter("NOT _near").drop("_near").unionByName(added)
    return both.select(*keys, "k", *(_half_away(F.col(c), digits).alias(c) for c in ("re", "im", "magnitude")))


def inverse_spectrum(terms: DataFrame, keys: Names, lengths: DataFrame) -> DataFrame:
    """Points of real series from terms k = 0..n/2 (see :func:`spectrum`): keys, pos, y. lengths: keys, n."""
    rows = terms.join(lengths, list(keys)).select(*keys, "k", "re", "im", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    angle = 2 * F.pi() * ((F.col("pos") * F.col("k")) % F.col("n")) / F.col("n")
    twice = F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("n")), 1.0).otherwise(2.0)
    return rows.groupBy(*keys, "pos").agg(F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))).alias("y"))


def dominant_frequency(df: DataFrame, keys: Names, order: Names, y: str, frequencies: int | None = None) -> DataFrame:
    """The frequency index above 0 of largest magnitude, the smallest among equals: keys, k, magnitude. ``frequencies`` as in :func:`spectrum`."""
    terms = spectrum(df, keys, order, y, frequencies).filter("k > 0").withColumn("magnitude", F.round("magnitude", 9))
    best = terms.groupBy(*keys).agg(F.min(F.struct((-F.col("magnitude")).alias("m"), "k")).alias("b"))
    return best.select(*keys, F.col("b.k").alias("k"), (-F.col("b.m")).alias("magnitude"))


def akima(df: DataFrame, keys: Names, order: Names, x: str, y: str, per_span: int) -> DataFrame:
    """Akima's curve at ``per_span`` equal steps in each span between points: keys, x, y.

    The slope at a point hangs on two points on either side only, so windows do it. x must
    increase strictly; spans of no width are left out; sets need 3 points.
    """
    w = in_set(keys, order)
    rows = df.select(*keys, *order, F.col(x).alias("_x"), F.col(y).alias("_y"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    rows = rows.withColumn("_m", F.try_divide(F.lead("_y").over(w) - F.col("_y"), F.lead("_x").over(w) - F.col("_x")))
    rows = rows.withColumns({"_m1": F.lead("_m", 1).over(w), "_p1": F.lag("_m", 1).over(w), "_p2": F.lag("_m", 2).over(w)})
    rows = rows.withColumns({"_q1": F.lag("_m", 1).over(w), "_r": F.row_number().over(w)}).filter("_n >= 3")
    # Slopes beyond the ends go on in a straight line.
    first, last = F.col("_r") == 1, F.col("_r") == F.col("_n")
    right1 = F.when(last, 2 * F.col("_p1") - F.col("_p2")).otherwise(F.col("_m"))
    right2 = F.when(last, 3 * F.col("_p1") - 2 * F.col("_p2")).when(F.col("_r") == F.col("_n") - 1, 2 * F.col("_m") - F.col("_p1")).otherwise(F.col("_m1"))
    left1 = F.when(first, 2 * F.col("_m") - F.col("_m1")).otherwise(F.col("_p1"))
    left2 = F.when(first, 3 * F.col("_m") - 2 * F.col("_m1")).when(F.col("_r") == 2, 2 * F.col("_p1") - F.col("_m")).otherwise(F.col("_p2"))
    a, b = F.abs(right2 - right1), F.abs(left1 - left2)
    slope = F.when(a + b > 0, (a * left1 + b * right1) / (a + b)).otherwise((left1 + right1) / 2)
    rows = rows.withColumn("_t", slope)
    rows = rows.withColumns({"_xn": F.lead("_x").over(w), "_yn": F.lead("_y").over(w), "_tn": F.lead("_t").over(w)}).filter("_xn > _x")
    rows = rows.withColumn("_u", F.explode(F.array(*(F.lit(k / per_span) for k in range(per_span))))).withColumn("_h", F.col("_xn") - F.col("_x"))
    u, h = F.col("_u"), F.col("_h")
    value = (
        (2 * u * u * u - 3 * u * u + 1) * F.col("_y") + (u * u * u - 2 * u * u + u) * h * F.col("_t") + (3 * u * u - 2 * u * u * u) * F.col("_yn") + (u * u * u - u * u) * h * F.col("_tn")
    )
    return rows.select(*keys, (F.col("_x") + u * h).alias("x"), value.alias("y"))


def _thin(batches: Iterator[pa.RecordBatch], keys: list[str], dx: float, dy: float, shape: str) -> Iterator[pa.RecordBatch]:
    """Walk the points in order; kept ones of the current set lie in cells of a grid."""
    current, cells = None, {}
    for batch in batches:
        keep = []
        key_rows = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
        for n, (key, x, y) in enumerate(zip(key_rows, batch.column("_x").to_pylist(), batch.column("_y").to_pylist())):
            if key != current:
                current, cells = key, {}
            if x is None or y is None or x != x or y != y:
                continue
            cx, cy = int(x // dx), int(y // dy)
            near = ((px, py) for a in (-1, 0, 1) for b in (-1, 0, 1) for px, py in cells.get((cx + a, cy + b), ()))
            if shape == "ellipse":
                close = any(((x - px) / dx) ** 2 + ((y - py) / dy) ** 2 <= 1 for px, py in near)
            else:
                close = any(abs(x - px) <= dx and abs(y - py) <= dy for px, py in near)
            if not close:
                cells.setdefault((cx, cy), []).append((x, y))
                keep.append(n)
        yield batch.take(pa.array(keep, pa.int64()))


def pruned(df: DataFrame, keys: Names, order: Names, x: str, y: str, dx: float, dy: float, shape: str = "ellipse") -> DataFrame:
    """Thin points greedily: one is kept unless it lies within dx, dy of one kept before (``ellipse`` or ``rectangle``).

    The result hangs on the order, so a set's points pass through one task in order; only kept points, which
    can't lie closer than that, are held. Points with a null or NaN are left out.
    """
    rows = df.withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType(rows.schema.fields)
    return rows.mapInArrow(partial(_thin, keys=list(keys), dx=dx, dy=dy, shape=shape), schema).drop("_x", "_y")


SPLINE_BLOCK = 4096  #: points whose spline a task solves at a time
SPLINE_REACH = 64  #: points beyond a block that are solved with it; each halves the influence of what lies behind


def spline_curvature(x: np.ndarray, y: np.ndarray, open_left: bool = False, open_right: bool = False) -> np.ndarray:
    """Second derivatives of the cubic spline through the points, by one sweep forth and one back.

    The third derivative goes on across the second and the last but one point; at
    an open end, where more points follow, the second derivative is taken as 0.
    """
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h, slope = np.diff(x), np.diff(np.diff(y) / np.diff(x))
    low, diagonal, high = h[1:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:-1].copy()
    if n == 3 and not (open_left or open_right):
        return np.full(3, 2 * slope[0] / (h[0] + h[1]))
    if not open_left:  # m0 = m1 - h0/h1 (m2 - m1)
        diagonal[0] += h[0] + h[0] ** 2 / h[1]
        if len(high):
            high[0] -= h[0] ** 2 / h[1]
    if not open_right:
        diagonal[-1] += h[-1] + h[-1] ** 2 / h[-2]
        if len(low):
            low[-1] -= h[-1] ** 2 / h[-2]
    right = 6 * slope
    for k in range(1, n - 2):
        f = low[k - 1] / diagonal[k - 1]
        diagonal[k] -= f * high[k - 1]
        right[k] -= f * right[k - 1]
    m = np.zeros(n)
    for k in range(n - 3, -1, -1):
        m[k + 1] = (right[k] - (high[k] * m[k + 2] if k < n - 3 else 0.0)) / diagonal[k]
    if not open_left:
        m[0] = m[1] - h[0] / h[1] * (m[2] - m[1])
    if not open_right:
        m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    return m


def _spline_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], per_span: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    steps = np.arange(per_span) / per_span
    for batch in batches:
        parts = [[np.array([(p["_x"], p["_y"]) for p in rows], dtype=float).reshape(-1, 2) for rows in batch.column(c).to_pylist()] for c in ("before", "body", "after")]
        found = []
        for before, body, after in zip(*parts):
            points = np.concatenate([before, body, after])
            x, y = points[:, 0], points[:, 1]
            m = spline_curvature(x, y, len(before) == SPLINE_REACH, len(after) == SPLINE_REACH)
            at = np.arange(len(before), min(len(before) + len(body), len(x) - 1))
            h, u = (x[at + 1] - x[at])[:, None], steps[None, :]
            value = (1 - u) * y[at][:, None] + u * y[at + 1][:, None] + h * h / 6 * (((1 - u) ** 3 - (1 - u)) * m[at][:, None] + (u**3 - u) * m[at + 1][:, None])
            found.append(((x[at][:, None] + h * u).ravel(), value.ravel()))
        which = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        made = [np.concatenate([f[k] for f in found]) if found else np.array([]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(which) for k in keys), *(pa.array(v, pa.float64()) for v in made)], schema=schema)


def cubic_spline(df: DataFrame, keys: Names, x: str, y: str, per_span: int) -> DataFrame:
    """The cubic spline at ``per_span`` equal steps in each span between points: keys, x, y.

    What a point does to the curve at least halves with each further point, so sets are cut into blocks
    that are solved with ``SPLINE_REACH`` points on either side, to double precision. Points with a null, NaN
    or infinite value are left out; those equal in x count once, with the mean y; a set of one point gives no
    rows, one of two a line.
    """
    usable = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in (x, y)]
    points = df.filter(usable[0] & usable[1]).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.avg(F.col(y).cast("double")).alias("_y"))
    points = points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_x")).cast("long"))
    blocks = blocked(points, list(keys), "_n", ["_x", "_y"], SPLINE_BLOCK, SPLINE_REACH).select(*keys, "before", "body", "after")
    schema = T.StructType([*(points.schema[k] for k in keys), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return blocks.mapInArrow(partial(_spline_blocks, keys=list(keys), per_span=per_span, schema=to_arrow_schema(schema)), schema)


def _straighten(batches: Iterator[pa.RecordBatch], keys: list[str], dy: float) -> Iterator[pa.RecordBatch]:
    """Hold the last kept point, the slopes by which lines from it pass all points since within ``dy``, and the last point."""
    current = held = carried = None  # held: the last point's row in this batch (-1: carried from an earlier one), x and y
    x0 = y0 = low = high = 0.0
    for batch in batches:
        keep, first = [], None
        key_rows = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
        for n, (key, x, y) in enumerate(zip(key_rows, batch.column("_x").to_pylist(), batch.column("_y").to_pylist())):
            if held is not None and not (key == current and x > held[1] and low <= (y - y0) / (x - x0) <= high):
                if held[0] < 0:
                    first = carried
                else:
                    keep.append(held[0])
                (_, x0, y0), held, low, high = held, None, -np.inf, np.inf
            if key != current or x <= x0:
                keep.append(n)
                current, x0, y0, low, high = key, x, y, -np.inf, np.inf
            else:
                low, high, held = max(low, (y - dy - y0) / (x - x0)), min(high, (y + dy - y0) / (x - x0)), (n, x, y)
        if first is not None:
            yield first
        yield batch.take(pa.array(keep, pa.int64()))
        if held is not None and held[0] >= 0:
            carried, held = batch.slice(held[0], 1), (-1, *held[1:])
    if held is not None:
        yield carried


def straightened(df: DataFrame, keys: Names, order: Names, x: str, y: str, dy: float) -> DataFrame:
    """Thin points that straight lines between the kept ones pass within ``dy``.

    A line is drawn on from a kept point until a point since would lie farther than ``dy`` from it; the
    point before is then kept. The first and the last of a set always are; where x doesn't increase a new
    stretch begins. A set's points pass through one task in order, which holds one point. Points
    with a null or NaN are left out.
    """
    rows = df.withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    rows = rows.filter("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(partial(_straighten, keys=list(keys), dy=dy), T.StructType(rows.schema.fields)).drop("_x", "_y")
