"""Queries of structure measures, stacked sets and repeated rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import structures as S
from strandlake.plans.common import BY_TIME, EVENTS_SQL, USER, events, rounded
from strandlake.session import table

QUERIES, SQL = {}, {}
CHARGES = {"purchase": 1, "click": -1, "view": 2}
XYZ = ["x", "y", "z"]


def _points(spark, d):
    """Events as beads, one structure per user: hours, value and event number."""
    return events(spark, d).select("user_id", "event_id", (F.col("x") / 24).alias("x"), (F.col("y") / 10).alias("y"), (F.col("event_id") % 50).cast("double").alias("z"))


_BEADS = EVENTS_SQL + ", p AS (SELECT user_id, event_id, x / 24 AS x, y / 10 AS y, (event_id % 50)::DOUBLE AS z FROM e)"


def net_charge(spark, d):
    return S.net_charge(events(spark, d), USER, BY_TIME, ["event_type"], "event_type", CHARGES, F.col("value") < 10)


SQL["net_charge"] = (
    EVENTS_SQL
    + """, c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS changed FROM e)
SELECT user_id, CAST(sum(CASE WHEN changed AND value >= 10 THEN CASE event_type """
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CHARGES.items())
    + " ELSE 0 END ELSE 0 END) AS BIGINT) AS charge FROM c GROUP BY 1"
)


def structure_diameters(spark, d):
    return rounded(S.diameters(_points(spark, d), USER, XYZ), "diam", "diam_xy")


SQL["structure_diameters"] = (
    _BEADS
    + """, c AS (SELECT user_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1)
SELECT user_id, round(2 * max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) + 0.0 AS diam, round(2 * max(sqrt((x - cx) ** 2 + (y - cy) ** 2)), 6) + 0.0 AS diam_xy FROM p JOIN c USING (user_id) GROUP BY 1"""
)


def cross_sections(spark, d):
    return rounded(S.cross_section(_points(spark, d), USER, XYZ, 0.5, 5.0, 40.0), "area")


SQL["cross_sections"] = (
    _BEADS
    + """, s AS (SELECT p.*, floor(x / 0.5) + a AS i, floor(y / 0.5) + b AS j FROM p, generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b) WHERE z > 5 AND z < 40)
SELECT user_id, count(*) AS cells, count(*) * 0.25::DOUBLE AS area FROM (SELECT DISTINCT user_id, i, j FROM s WHERE sqrt(((i + 0.5) * 0.5 - x) ** 2 + ((j + 0.5) * 0.5 - y) ** 2) < 0.5) GROUP BY 1"""
)


def native_contacts(spark, d):
    return rounded(S.native_contacts(_points(spark, d), USER, "event_id", XYZ, 8.0), "distance")


SQL["native_contacts"] = (
    _BEADS
    + """, q AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM p a JOIN p b ON a.user_id = b.user_id AND b.event_id - a.event_id >= 4)
SELECT user_id, i, j, round(distance, 6) + 0.0 AS distance FROM q WHERE distance < 8"""
)


def principal_extents(spark, d):
    """Extent of each structure along its own axes."""
    out = S.along_axes(_points(spark, d), USER, XYZ)
    return rounded(out.groupBy(*USER).agg(*((F.max(c) - F.min(c)).alias(f"extent_{c}") for c in XYZ)), *(f"extent_{c}" for c in XYZ), digits=4)


def best_of_rounds(spark, d):
    """Least energy of each replica over all cycles, above that of replica 0 of its run."""
    return rounded(S.best_of_rounds(table(spark, d, "replica_state"), ["run_id"], "replica_index", F.col("replica_index") == 0, "potential_energy"), "best", "ddg", digits=4)


SQL["best_of_rounds"] = """
WITH b AS (SELECT run_id, replica_index, min(potential_energy) AS best, count(*) AS rounds FROM replica_state WHERE isfinite(potential_energy) GROUP BY 1, 2)
SELECT run_id, replica_index, round(best, 4) + 0.0 AS best, rounds, round(best - min(best) FILTER (replica_index = 0) OVER (PARTITION BY run_id), 4) + 0.0 AS ddg FROM b"""


def stacked_sets(spark, d):
    """Daily totals of each event type, stacked in the order of the types."""
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return rounded(S.stacked(daily, [], "event_type", "day", "total"), "total", "top", digits=4)


SQL["stacked_sets"] = """
WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT event_type, day, round(total, 4) + 0.0 AS total, round(sum(total) OVER (PARTITION BY day ORDER BY event_type ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS top FROM t"""

def pore_measures(spark, d):
    """Each user's events as the profile of a pore: hours along it, the value as radius."""
    return rounded(S.pore(events(spark, d), USER, "x", "value"), "least_radius", "at", "factor")


SQL["pore_measures"] = (
    EVENTS_SQL
    + """, s AS (SELECT user_id, x, value, (lead(x) OVER (PARTITION BY user_id ORDER BY x) - x) / (pi() * value * value) AS f FROM e WHERE value > 0)
SELECT user_id, round(min(value), 6) + 0.0 AS least_radius, round(arg_min(x, (value, x)), 6) + 0.0 AS at, round(coalesce(sum(f), 0), 6) + 0.0 AS factor FROM s GROUP BY 1"""
)


def leaflet_points(spark, d):
    """Beads away from the middle slab, without each structure's first three."""
    df = S.without_first(S.outside_slab(_points(spark, d), "z", 25.0, 5.0), USER, ["z", "event_id"], 3)
    return rounded(df.select("user_id", "event_id", "z"), "z")


SQL["leaflet_points"] = (
    _BEADS + " SELECT user_id, event_id, z FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z, event_id) AS r FROM p WHERE abs(z - 25) >= 5) WHERE r > 3"
)

for _f in (pore_measures, leaflet_points, net_charge, structure_diameters, cross_sections, native_contacts, principal_extents, best_of_rounds, stacked_sets):
    QUERIES[_f.__name__] = _f
