"""Row filters: truth of numbers, regions of the plane, ranges, greedy thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = Sequence[str]


def true_half(v: Column) -> Column:
    """Truth of a value in a column: at least one half in magnitude."""
    return F.abs(v) >= 0.5


def true_nonzero(v: Column) -> Column:
    """Truth of a single number: not zero."""
    return v != 0


def true_rounded(v: Column) -> Column:
    """Truth in sampling: doesn't round (half to even) to zero."""
    return F.rint(v) != 0


def restrict(df: DataFrame, v: Column) -> DataFrame:
    return df.filter(true_half(v))


# Regions are Columns of truth values over x and y.


def above_line(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Above the infinite line through two points; of a vertical line nothing is above or below."""
    return F.lit(False) if x1 == x2 else y > y1 + (x - x1) * ((y2 - y1) / (x2 - x1))


def below_line(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    return F.lit(False) if x1 == x2 else y < y1 + (x - x1) * ((y2 - y1) / (x2 - x1))


def left_of_line(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Left of the infinite line; of a horizontal line nothing is left or right."""
    return F.lit(False) if y1 == y2 else x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))


def right_of_line(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    return F.lit(False) if y1 == y2 else x > x1 + (y - y1) * ((x2 - x1) / (y2 - y1))


def in_band(v: Column, low: float, high: float) -> Column:
    """Inside a band of one axis, ends included; the outside is its negation."""
    return v.between(low, high)


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Inside a polygon by counting the edges that a ray to the right crosses.

    An edge counts from its lower end (excluded) to its upper end (included), so a corner counts once.
    """
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        if ay == by:
            continue
        crosses = (y > min(ay, by)) & (y <= max(ay, by)) & (x < ax + (y - ay) * ((bx - ax) / (by - ay)))
        crossings = crossings + F.when(crosses, 1).otherwise(0)
    return crossings % 2 == 1


def in_world(x: Column, y: Column, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    return x.between(xmin, xmax) & y.between(ymin, ymax)


def in_disc(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return F.pow(x - cx, 2) + F.pow(y - cy, 2) < radius * radius


def region_report(df: DataFrame, keys: Names, region: Column) -> DataFrame:
    """How many points of each set lie in the region; sets with none are left out."""
    return df.filter(region).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))


def range_of_where(df: DataFrame, by: Names, value: str, on: str, low: float, high: float) -> DataFrame:
    """min and max of ``value`` where ``on`` lies in [low, high]."""
    return df.filter(F.col(on).between(low, high)).groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"))
