"""Terms that lie half-way between two rounded numbers come out as the SQL's sum in order gives them."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.operators import signal as G
from strandlake.plans import registry
from tests.compare import same


def test_halves_like_sql(spark, tmp_path):
    rnd, start = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = [(1000 * n + t, start + datetime.timedelta(minutes=t), n, "view", round(rnd.expovariate(0.02), 2), "") for n in (1, 16, 48, 64, 71, 80) for t in range(n)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same(registry.QUERIES["fourier_spectrum"](spark, str(tmp_path)), con, registry.SQL["fourier_spectrum"])


def test_unknown_points_and_sets(spark):
    rows = [(None, 0, 0.000025), (None, 1, None), ("none", 0, None), ("none", 1, None), ("far", 0, float("inf")), ("big", 0, 1e300), ("big", 1, 1e300)]
    got = {(r.s, r.k): (r.re, r.im, r.magnitude) for r in G.rounded_spectrum(spark.createDataFrame(rows, "s string, t long, y double"), ["s"], ["t"], "y", 5).collect()}
    assert got[None, 0] == pytest.approx((0.00001, 0, 0.00003), abs=1e-12) and got[None, 1] == pytest.approx((0.00001, 0, 0.00001), abs=1e-12)
    assert got["none", 0] == got["none", 1] == (None, None, None) and got["far", 0][0] == float("inf") and got["big", 0][0] == pytest.approx(1e300) and len(got) == 7
    halves = spark.createDataFrame([(0.5,), (-2.5,), (1.5,), (0.49999999999999994,), (-0.2,)], "v double").select(G._half_away(F.col("v"), 0).alias("v")).collect()
    assert [r.v for r in halves] == [1.0, -3.0, 2.0, 0.0, 0.0]


def test_terms_added_again_are_not_broadcast(spark, tmp_path):
    spark.range(20_000).selectExpr("id % 250 AS s", "id AS t", "id % 97 * 1e9 AS y").repartition(1).write.parquet(f"{tmp_path}/points")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100k")
    try:
        assert G.rounded_spectrum(spark.read.parquet(f"{tmp_path}/points"), ["s"], ["t"], "y", 5).count() == 250 * 41
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
