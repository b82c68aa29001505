"""Series made from numbers: meshes, ladders, points on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_mesh(spark: SparkSession, n: int) -> DataFrame:
    """pos and x = 0, 1, ... n - 1."""
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("x"))


def linear_mesh(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """pos and x: ``n`` equal steps from ``low`` to ``high``, both included."""
    if n < 2:
        raise ValueError("a mesh needs two points")
    middle, half = (low + high) / 2, (high - low) / 2
    return spark.range(n).select(F.col("id").alias("pos"), (middle + half * (2 * F.col("id") + 1 - n) / (n - 1)).alias("x"))


def random_vector(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """pos and x, uniform from 0 to below 1."""
    return spark.range(n).select(F.col("id").alias("pos"), F.rand(seed).alias("x"))


def ladder(spark: SparkSession, n: int, least: float, most: float, spacing: str = "geometric") -> DataFrame:
    """replica and lam, from ``most`` down to ``least``, by equal ratios or (``linear``) equal steps."""
    if n < 2 or spacing not in ("geometric", "linear"):
        raise ValueError("a ladder needs two steps, geometric or linear")
    part = F.col("id") / (n - 1)
    lam = most * F.pow(F.lit(least / most), part) if spacing == "geometric" else most - (most - least) * part
    return spark.range(n).select(F.col("id").cast("int").alias("replica"), lam.alias("lam"))


def sphere_points(spark: SparkSession, n: int) -> DataFrame:
    """pos, x, y, z: ``n`` points spread over the unit sphere on a spiral of golden angles."""
    y, angle = (2 * F.col("id") + 1) / n - 1, F.col("id") * (math.pi * (3 - math.sqrt(5)))
    r = F.sqrt(1 - y * y)
    return spark.range(n).select(F.col("id").alias("pos"), (F.cos(angle) * r).alias("x"), y.alias("y"), (F.sin(angle) * r).alias("z"))
