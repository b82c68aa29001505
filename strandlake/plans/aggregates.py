"""Queries of the aggregations: statistics, features, histograms, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import aggregates as A
from strandlake.plans.common import BY_TIME, EVENTS_SQL, USER, events, rounded
from strandlake.session import table

QUERIES, SQL = {}, {}
EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 45.0]
KT = 2.479


def set_statistics(spark, d):
    return rounded(A.statistics(events(spark, d), USER, BY_TIME, "y"), "min", "max", "avg", "sd", "sum")


SQL["set_statistics"] = (
    EVENTS_SQL
    + """SELECT user_id, count(y) AS n, round(min(y), 6) + 0.0 AS min, round(max(y), 6) + 0.0 AS max, round(avg(y), 6) + 0.0 AS avg,
  round(coalesce(stddev_samp(y), 0), 6) + 0.0 AS sd, round(sum(y), 6) + 0.0 AS sum,
  arg_min(pos, (y, pos)) AS imin, arg_min(pos, (-y, pos)) AS imax FROM e GROUP BY user_id"""
)


def set_features(spark, d):
    return rounded(A.features(events(spark, d), USER, BY_TIME, "x", "y"), "median", "slope", "intercept", "barycentre_x", "barycentre_y", "x_at_ymax", "y_at_xmax", "integral", digits=4)


SQL["set_features"] = (
    EVENTS_SQL
    + """, a AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS area FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, count(*) AS n, round(median(y), 4) + 0.0 AS median,
  round(CASE WHEN count(*) > 3 THEN regr_slope(y, x) END, 4) + 0.0 AS slope, round(CASE WHEN count(*) > 3 THEN regr_intercept(y, x) END, 4) + 0.0 AS intercept,
  round(sum(x * y) / sum(y), 4) + 0.0 AS barycentre_x, round(sum(x * y) / sum(x), 4) + 0.0 AS barycentre_y,
  round(arg_min(x, (-y, pos)), 4) + 0.0 AS x_at_ymax, round(arg_min(y, (-x, pos)), 4) + 0.0 AS y_at_xmax,
  round(coalesce(sum(area), 0), 4) + 0.0 AS integral FROM a GROUP BY user_id"""
)


def zero_crossing(spark, d):
    df = events(spark, d)
    df = df.withColumn("y", F.col("y") - F.round(F.avg("y").over(A.Window.partitionBy("user_id")), 6))
    return rounded(A.first_zero(df, USER, BY_TIME, "x", "y"), "zero_x", digits=4)


SQL["zero_crossing"] = (
    EVENTS_SQL
    + """, c AS (SELECT user_id, pos, x, y - round(avg(y) OVER (PARTITION BY user_id), 6) AS y FROM e),
p AS (SELECT user_id, pos, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, round(arg_min(CASE WHEN y0 = 0 THEN x0 ELSE x0 - (x1 - x0) * y0 / (y1 - y0) END, pos), 4) + 0.0 AS zero_x
FROM p WHERE y1 IS NOT NULL AND (y0 = 0 OR y0 * y1 < 0) GROUP BY user_id"""
)


def rise_time(spark, d):
    return rounded(A.rise_time(events(spark, d), USER, BY_TIME, "x", "y"), "rise_time", digits=4)


SQL["rise_time"] = (
    EVENTS_SQL
    + """, p AS (SELECT user_id, pos, x AS x1, y AS y1, lag(x) OVER w AS x0, lag(y) OVER w AS y0, min(y) OVER a AS lo, max(y) OVER a AS hi FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY pos), a AS (PARTITION BY user_id)),
l AS (SELECT *, lo + 0.1 * (hi - lo) AS la, lo + 0.9 * (hi - lo) AS lb FROM p),
h AS (SELECT user_id, arg_min(x0 + (x1 - x0) * (la - y0) / (y1 - y0), pos) FILTER (y0 < la AND y1 >= la) AS a,
  arg_min(x0 + (x1 - x0) * (lb - y0) / (y1 - y0), pos) FILTER (y0 < lb AND y1 >= lb) AS b FROM l GROUP BY user_id)
SELECT user_id, round(b - a, 4) + 0.0 AS rise_time FROM h WHERE a IS NOT NULL AND b IS NOT NULL"""
)


def half_width(spark, d):
    return rounded(A.half_width(events(spark, d), USER, BY_TIME, "x", "y"), "half_width", digits=4)


SQL["half_width"] = (
    EVENTS_SQL
    + """, t AS (SELECT user_id, (min(y) + max(y)) / 2 AS mid, arg_min(pos, (-y, pos)) AS peak FROM e GROUP BY user_id),
p AS (SELECT user_id, pos, x, y, lead(x) OVER w AS xn, lead(y) OVER w AS yn, lag(x) OVER w AS xb, lag(y) OVER w AS yb FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
h AS (SELECT user_id, arg_max(x + (xn - x) * (mid - y) / (yn - y), pos) FILTER (pos < peak AND y <= mid AND yn > mid) AS a,
  arg_min(xb + (x - xb) * (mid - yb) / (y - yb), pos) FILTER (pos > peak AND y <= mid AND yb > mid) AS b FROM p JOIN t USING (user_id) GROUP BY user_id)
SELECT user_id, round(b - a, 4) + 0.0 AS half_width FROM h WHERE a IS NOT NULL AND b IS NOT NULL"""
)


def _histogram(cumulative, normalised):
    def query(spark, d):
        return rounded(A.histogram(table(spark, d, "lineitem"), "l_quantity", EDGES, cumulative, normalised), "y")

    return query


_HIST = f"""
WITH g AS (SELECT generate_subscripts(l, 1)::INTEGER - 1 AS bin, unnest(l)::DOUBLE AS edge FROM (SELECT {EDGES} AS l)),
b AS (SELECT bin, edge, lag(edge) OVER (ORDER BY bin) AS lo FROM g),
v AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
m AS (SELECT v, any_value(k) AS k, min(bin) AS bin FROM v JOIN b ON v BETWEEN lo AND edge GROUP BY v),
c AS (SELECT b.bin, b.edge, coalesce(sum(m.k), 0)::DOUBLE AS y FROM b LEFT JOIN m ON b.bin = m.bin GROUP BY 1, 2)
"""
for _name, _cum, _norm in (("histogram_closed", False, False), ("histogram_cumulative", True, False), ("histogram_normalised", False, True)):
    QUERIES[_name] = _histogram(_cum, _norm)
    _y = "sum(y) OVER (ORDER BY bin)" if _cum else "y / (SELECT sum(k) FROM v)" if _norm else "y"
    SQL[_name] = _HIST + f"SELECT bin, edge, round({_y}, 6) + 0.0 AS y FROM c"


def histogram_2d(spark, d):
    df = table(spark, d, "lineitem").withColumn("v", F.col("l_discount") * 500)
    return rounded(A.histogram_2d(df, ["l_returnflag"], "l_quantity", "v", 0.0, 50.0, 20), "density")


SQL["histogram_2d"] = """
WITH p AS (SELECT l_returnflag, l_quantity AS x, l_discount * 500 AS y FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount * 500 BETWEEN 0 AND 50),
c AS (SELECT l_returnflag, greatest(0, least(19, floor(x / 50 * 20)))::INTEGER AS ix, greatest(0, least(19, floor(y / 50 * 20)))::INTEGER AS iy, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT *, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * 6.25), 6) + 0.0 AS density FROM c"""


def density_difference(spark, d):
    df = table(spark, d, "lineitem").withColumn("v", F.col("l_discount") * 500)
    grids = A.histogram_2d(df, ["l_returnflag"], "l_quantity", "v", 0.0, 50.0, 20)
    return rounded(A.density_difference(grids.filter("l_returnflag = 'A'"), grids.filter("l_returnflag = 'R'"), ["ix", "iy"], "density"), "difference")


SQL["density_difference"] = (
    SQL["histogram_2d"].replace("SELECT *, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * 6.25), 6) + 0.0 AS density FROM c", "")
    + """, q AS (SELECT *, n / (sum(n) OVER (PARTITION BY l_returnflag) * 6.25) AS density FROM c)
SELECT ix, iy, round(coalesce(a.density, 0) - coalesce(b.density, 0), 6) + 0.0 AS difference
FROM (SELECT * FROM q WHERE l_returnflag = 'A') a FULL JOIN (SELECT * FROM q WHERE l_returnflag = 'R') b USING (ix, iy)"""
)


def binned_mean(spark, d):
    return rounded(A.binned_mean(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 0.0, 50.0, 25), "mean", digits=4)


SQL["binned_mean"] = """
SELECT l_returnflag, greatest(0, least(24, floor(l_quantity / 50 * 25)))::INTEGER AS bin, count(*) AS n, round(avg(l_extendedprice), 4) + 0.0 AS mean
FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2"""


def free_energy_grid(spark, d):
    df = events(spark, d).withColumn("hour", F.col("x") % 24).withColumn("w", F.lit(1.0))
    return rounded(A.free_energy_grid(df, "y", "hour", "w", 24, KT), "weight", "free_energy")


SQL["free_energy_grid"] = (
    EVENTS_SQL
    + f""", p AS (SELECT y AS a, x % 24 AS b FROM e), m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM p),
g AS (SELECT a0 - 0.02 * (a1 - a0) AS alo, a1 + 0.02 * (a1 - a0) AS ahi, b0 - 0.02 * (b1 - b0) AS blo, b1 + 0.02 * (b1 - b0) AS bhi FROM m),
c AS (SELECT greatest(0, least(23, floor((a - alo) / (ahi - alo) * 24)))::INTEGER AS ix, greatest(0, least(23, floor((b - blo) / (bhi - blo) * 24)))::INTEGER AS iy, count(*)::DOUBLE AS w
  FROM p, g GROUP BY 1, 2),
f AS (SELECT ix, iy, w / sum(w) OVER () AS weight FROM c)
SELECT ix, iy, round(weight, 6) + 0.0 AS weight, round(-{KT} * ln(weight) - min(-{KT} * ln(weight)) OVER (), 6) + 0.0 AS free_energy FROM f"""
)


def set_extents(spark, d):
    return rounded(A.extents(events(spark, d), USER, "x", "y"), "xmin", "xmax", "ymin", "ymax")


SQL["set_extents"] = (
    EVENTS_SQL + "SELECT user_id, round(min(x), 6) + 0.0 AS xmin, round(max(x), 6) + 0.0 AS xmax, round(min(y), 6) + 0.0 AS ymin, round(max(y), 6) + 0.0 AS ymax FROM e GROUP BY user_id"
)


def polygon_measures(spark, d):
    return rounded(A.polygon(events(spark, d), USER, BY_TIME, "x", "y"), "area", "perimeter", digits=3)


SQL["polygon_measures"] = (
    EVENTS_SQL
    + """, p AS (SELECT user_id, x AS x0, y AS y0, lead(x) OVER w AS xn, lead(y) OVER w AS yn, first_value(x) OVER w AS xf, first_value(y) OVER w AS yf FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, round(abs(sum(x0 * coalesce(yn, yf) - coalesce(xn, xf) * y0)) / 2, 3) + 0.0 AS area,
  round(coalesce(sum(CASE WHEN xn IS NOT NULL THEN sqrt((xn - x0) ** 2 + (yn - y0) ** 2) END), 0), 3) + 0.0 AS perimeter FROM p GROUP BY user_id"""
)


def fit_quality(spark, d):
    df = table(spark, d, "lineitem").withColumn("fitted", F.col("l_quantity") * 1000)
    return rounded(A.fit_quality(df, ["l_returnflag", "l_linestatus"], "l_extendedprice", "fitted"), "rms_relative", "theil_u").withColumn("chi2", F.round(F.col("chi2") / 1e9, 4))


SQL["fit_quality"] = """
SELECT l_returnflag, l_linestatus, round(sum((l_quantity * 1000 - l_extendedprice) ** 2) / 1e9, 4) AS chi2,
  round(sqrt(avg(((l_quantity * 1000 - l_extendedprice) / l_extendedprice) ** 2)), 6) + 0.0 AS rms_relative,
  round(sqrt(avg((l_quantity * 1000 - l_extendedprice) ** 2)) / sqrt(avg(l_extendedprice ** 2)), 6) + 0.0 AS theil_u
FROM lineitem GROUP BY 1, 2"""


def gyration_by_group(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    return rounded(A.gyration(df, ["l_returnflag", "l_linestatus"]), "rg")


SQL["gyration_by_group"] = """
SELECT l_returnflag, l_linestatus, round(sqrt(var_pop(l_quantity) + var_pop(l_extendedprice / 1000) + var_pop(l_discount * 100)), 6) + 0.0 AS rg FROM lineitem GROUP BY 1, 2"""


def centroid_distances(spark, d):
    df = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    return rounded(A.centroid_distances(df, ["l_linestatus"], "l_returnflag"), "distance")


SQL["centroid_distances"] = """
WITH c AS (SELECT l_linestatus, l_returnflag, avg(l_quantity) AS x, avg(l_extendedprice / 1000) AS y, avg(l_discount * 100) AS z FROM lineitem GROUP BY 1, 2)
SELECT a.l_linestatus, a.l_returnflag AS part_a, b.l_returnflag AS part_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) + 0.0 AS distance
FROM c a JOIN c b ON a.l_linestatus = b.l_linestatus AND a.l_returnflag < b.l_returnflag"""

for _f in (
    set_statistics, set_features, zero_crossing, rise_time, half_width, histogram_2d, density_difference, binned_mean, free_energy_grid, set_extents, polygon_measures, fit_quality,
    gyration_by_group, centroid_distances,
):
    QUERIES[_f.__name__] = _f
