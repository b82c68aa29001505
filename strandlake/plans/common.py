"""Tables as the queries use them, and rounding that both engines agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import table

ORIGIN_US = 1704067200000000  #: 2024-01-01 UTC in microseconds
USER, BY_TIME = ["user_id"], ["ts", "event_id"]


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as one set of points per user: x in hours since 2024, y the value."""
    df = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value", "props")
    return df.withColumn("x", (micros("ts") - ORIGIN_US) / 3.6e9).withColumn("y", F.col("value"))


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Known states as one sequence per replica, each cycle once: run_id, replica_index, cycle_no, state, energy."""
    df = table(spark, d, "replica_state").filter("state_index >= 0")
    return df.groupBy("run_id", "replica_index", "cycle_no").agg(F.min("state_index").alias("state"), F.min("potential_energy").alias("energy"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round columns and turn -0.0 into 0.0, as the SQL counterparts do."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


EVENTS_SQL = f"""
WITH e AS (
  SELECT user_id, event_id, event_type, ts, value, value AS y, (epoch_us(ts) - {ORIGIN_US}) / 3.6e9 AS x,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""

STATES_SQL = """
WITH t AS (
  SELECT run_id, replica_index, cycle_no, min(state_index) AS state, min(potential_energy) AS energy
  FROM replica_state WHERE state_index >= 0 GROUP BY 1, 2, 3)"""
