"""Exchange messages: one spelling for pairs, one identity per attempt, one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two integers in any spelling: ``3-4``, ``(3, 4)``, ``4–3``.
PAIR_PATTERN = r"(\d+)\D+(\d+)"

MESSAGE_KEY = ("run_id", "launch_no", "cycle_no", "pair_i", "pair_j")


def with_pair(df: DataFrame, pair: str = "pair") -> DataFrame:
    """Add ``pair_i`` < ``pair_j`` from any spelling and order of ``pair``.

    Null where the text doesn't hold two integers.
    """
    a = F.expr(f"try_cast(regexp_extract(`{pair}`, '{PAIR_PATTERN}', 1) AS int)".replace("\\", "\\\\"))
    b = F.expr(f"try_cast(regexp_extract(`{pair}`, '{PAIR_PATTERN}', 2) AS int)".replace("\\", "\\\\"))
    both = a.isNotNull() & b.isNotNull()
    return df.withColumn("pair_i", F.when(both, F.least(a, b))).withColumn("pair_j", F.when(both, F.greatest(a, b)))


def null_safe_hash(seed: int, *columns: Column) -> Column:
    """64-bit hash in which a null is a value of its own, wherever it stands."""
    nulls = F.lit(0)
    for k, c in enumerate(columns):
        nulls = nulls + F.when(c.isNull(), F.lit(1 << k)).otherwise(F.lit(0))
    return F.xxhash64(F.lit(seed), nulls, *columns)


def arrival(received: str = "received_at", record: str = "record_id") -> Column:
    """Order of copies: earliest arrival first, unknown arrival last, then the smallest id."""
    return F.struct(F.col(received).isNull().alias("late"), F.col(received).alias("at"), F.col(record).alias("id"))


def one_copy(df: DataFrame, *values: str) -> DataFrame:
    """One row per message with ``values`` of its kept copy (see :func:`arrival`).

    ``df`` is a table of exchange records. The copies are reduced on the map side
    first, so a message delivered millions of times costs one row per task. Rows
    whose pair can't be read are identified by the text itself.
    """
    df = with_pair(df)
    odd = F.when(F.col("pair_i").isNull(), F.col("pair")).alias("odd_pair")
    best = F.min(F.struct(arrival().alias("order"), *(F.col(v).alias(f"v_{v}") for v in values))).alias("best")
    return (
        df.select(*MESSAGE_KEY, odd, "received_at", "record_id", *(v for v in values if v not in ("received_at", "record_id")))
        .groupBy(*MESSAGE_KEY, "odd_pair")
        .agg(best)
        .select(*MESSAGE_KEY, "odd_pair", *(F.col(f"best.v_{v}").alias(v) for v in values))
    )
