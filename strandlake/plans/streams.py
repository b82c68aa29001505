"""Queries that run as streams over the arrived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.plans.common import ORIGIN_US, micros
from strandlake.session import reach_workers, shared_path
from strandlake.streaming import live

QUERIES, SQL = {}, {}


def _stream(spark, d, name):
    reach_workers(spark)
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def stream_points(spark, d):
    """Events as lines of the live protocol, read by the stream into sets of points."""
    df = _stream(spark, d, "events")
    x = ((micros("ts") - ORIGIN_US) / 3.6e9).cast("string")
    line = F.concat(F.lit("g0.s"), F.col("user_id"), F.lit(" point "), x, F.lit(", "), F.col("value").cast("string"))
    points = live.points(df.select(line.alias("value"))).filter("ok").select("graph", "set", "x", "y")
    out = live.drained(points, shared_path(spark, "points"), shared_path(spark, "points-state"))
    return out.groupBy("set").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("y"), 4) + 0.0).alias("y"), (F.round(F.max("x"), 4) + 0.0).alias("x"))


SQL["stream_points"] = f"SELECT user_id::INTEGER AS set, count(*) AS n, round(sum(value), 4) + 0.0 AS y, round(max((epoch_us(ts) - {ORIGIN_US}) / 3.6e9), 4) + 0.0 AS x FROM events GROUP BY 1"


def stream_append(spark, d):
    """Points numbered as they arrive, with state per set."""
    df = _stream(spark, d, "events").select("user_id", ((micros("ts") - ORIGIN_US) / 3.6e9).alias("x"), F.col("value").alias("y"))
    out = live.drained(live.appended(df, ["user_id"], "x", "y"), shared_path(spark, "appended"), shared_path(spark, "appended-state"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"), F.count_distinct("pos").alias("positions"))


SQL["stream_append"] = "SELECT user_id, count(*) AS n, count(*) - 1 AS last_pos, count(*) AS positions FROM events GROUP BY 1"

for _f in (stream_points, stream_append):
    QUERIES[_f.__name__] = _f
