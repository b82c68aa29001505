"""The copies of points around are shuffled, however small the file they are made from: none go by way of the driver."""

from strandlake.operators.structures import native_contacts


def test_copies_are_not_broadcast(spark, tmp_path):
    points = spark.range(20_000).selectExpr("id % 40 AS s", "id", "id % 13 / 2D AS x", "id % 17 / 2D AS y", "id % 11 / 2D AS z")
    points.repartition(1).write.parquet(f"{tmp_path}/points")
    near = "a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 1"
    want = points.alias("a").join(points.alias("b"), "s").filter(near).count()
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        found = native_contacts(spark.read.parquet(f"{tmp_path}/points"), ["s"], "id", ["x", "y", "z"], 1.0, apart=1)
        assert found.count() == found.filter("i < j AND distance < 1").count() == want > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
