"""Managing sets: joining, splitting, renaming, packing; sets are key columns, so none of it moves data but where said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.sequence import numbered

Names = Sequence[str]


def appended(first: DataFrame, second: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The rows of ``second`` behind those of ``first`` in each set; ``pos`` counts through."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    return numbered(both, keys, ["_part", *order]).drop("_part")


def split(df: DataFrame, keys: Names, order: Names, length: int) -> DataFrame:
    """Chunks of ``length`` rows, the last one shorter: adds ``chunk`` and ``pos`` in the chunk."""
    rows = numbered(df, keys, order)
    return rows.withColumn("chunk", F.floor(F.col("pos") / length)).withColumn("pos", F.col("pos") % length)


def moved(df: DataFrame, key: str, old, new) -> DataFrame:
    """Set ``old`` becomes ``new``; what was ``new`` is replaced."""
    return df.filter(F.col(key) != F.lit(new)).withColumn(key, F.when(F.col(key) == F.lit(old), F.lit(new)).otherwise(F.col(key)))


def copied(df: DataFrame, key: str, old, new) -> DataFrame:
    """Set ``new`` becomes a copy of ``old``."""
    return df.filter(F.col(key) != F.lit(new)).unionByName(df.filter(F.col(key) == F.lit(old)).withColumn(key, F.lit(new)))


def swapped(df: DataFrame, key: str, a, b) -> DataFrame:
    return df.withColumn(key, F.when(F.col(key) == F.lit(a), F.lit(b)).when(F.col(key) == F.lit(b), F.lit(a)).otherwise(F.col(key)))


def killed(df: DataFrame, key: str, which: Sequence) -> DataFrame:
    return df.filter(~F.col(key).isin(*which))


def packed(df: DataFrame, key: str, out: str = "packed") -> DataFrame:
    """Number the sets 0, 1, ... in the order of ``key``, without gaps.

    The distinct keys are numbered, not the rows: first within ranges of the keys, then by the ranges' counts.
    """
    names = df.select(key).distinct()
    ranged = names.repartitionByRange(key).withColumn("_r", F.spark_partition_id())
    inner = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1)
    counts = ranged.groupBy("_r").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbers = inner.join(F.broadcast(counts), "_r").select(key, (F.col("_n") + F.col("_before")).alias(out))  # one row per partition
    return df.join(numbers, key)


def unpivoted(df: DataFrame, keys: Names, x: str, columns: Names) -> DataFrame:
    """Wide columns as sets that share x: keys, x, set (0-based), y."""
    columns = list(columns)
    spread = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("set", "y")
    return df.select(*keys, F.col(x).alias("x"), spread)


def stacked_arrays(df: DataFrame, columns: Names, out: str = "features") -> DataFrame:
    """Arrays side by side in one array."""
    return df.withColumn(out, F.concat(*columns))
