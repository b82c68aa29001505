"""Percentiles of very large columns from mergeable counts in signed logarithmic buckets.

Bucket k holds the values x with gamma**(k-1) < |x| <= gamma**k, gamma = (1+a)/(1-a); zeros have sign 0.
Sketches are rows (group, sign, bucket, n): they merge by adding counts, so results of
days, batches or files can be put together in any order. The estimate
2*gamma**k/(gamma+1) of any value in the bucket is off by at most the part ``a`` of it, down to the smallest double of full precision (2.2e-308).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def gamma_of(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def estimate(sign: Column, bucket: Column, error: float) -> Column:
    g = gamma_of(error)
    return sign * F.pow(F.lit(g), bucket) * (2 / (g + 1))


def sketch(df: DataFrame, by: list[str], value: str, error: float = 0.01) -> DataFrame:
    """Rows by, sign, bucket, n. Nulls, NaN and infinite values are left out.

    A null in ``by`` is a group of its own; an empty table gives an empty sketch.
    Counts are added up on the map side, so a hot group costs one row per bucket and task.
    """
    x = F.col(value).cast("double")
    size = F.abs(x)
    finite = x.isNotNull() & ~F.isnan(x) & (size < F.lit(float("inf")))
    zero = size == 0
    return (
        df.filter(finite)
        .select(*by, F.when(zero, 0).otherwise(F.signum(x)).cast("int").alias("sign"), F.when(zero, 0).otherwise(F.ceil(F.log(size) / math.log(gamma_of(error)))).cast("int").alias("bucket"))
        .groupBy(*by, "sign", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(*sketches: DataFrame, by: list[str]) -> DataFrame:
    """Put sketches of the same error together, also over fewer group columns than they have."""
    rows = reduce(DataFrame.unionByName, (s.select(*by, "sign", "bucket", "n") for s in sketches))
    return rows.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketched: DataFrame, by: list[str], at: list[float], error: float = 0.01) -> DataFrame:
    """Rows by, n, q, value, low, high: for each q in ``at`` the value of rank ceil(q*n), at least 1.

    The exact one of that rank lies from ``low`` to ``high``, the ends of its bucket, and ``value`` is within the part
    ``error`` of it. ``sketched`` has one row per group, sign and bucket.
    """
    group = Window.partitionBy(*by)
    rising = group.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    rows = sketched.withColumn("upto", F.sum("n").over(rising)).withColumn("all", F.sum("n").over(group))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("all"))).alias("rank")) for q in at))).alias("w")
    found = rows.select(*by, "sign", "bucket", "upto", "n", F.col("all"), wanted).filter((F.col("upto") >= F.col("w.rank")) & (F.col("upto") - F.col("n") < F.col("w.rank")))
    g, sign, bucket = F.lit(gamma_of(error)), F.col("sign"), F.col("bucket")
    value = F.when(sign == 0, F.lit(0.0)).otherwise(estimate(sign, bucket, error))
    ends = [sign * F.pow(g, bucket - 1), sign * F.pow(g, bucket)]
    return found.select(*by, F.col("all").alias("n"), F.col("w.q").alias("q"), value.alias("value"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
