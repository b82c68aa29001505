"""Queries of filters, set management and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import filters as R
from strandlake.operators import joins as J
from strandlake.operators import sequence as S
from strandlake.operators import sets as M
from strandlake.plans.common import BY_TIME, EVENTS_SQL, USER, events, micros, rounded
from strandlake.session import table

QUERIES, SQL = {}, {}
POLYGON = [(5.0, 5000.0), (45.0, 20000.0), (40.0, 60000.0), (12.0, 45000.0)]


def _items(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return df


def _counted(name, condition, sql):
    """Every query of a filter keeps the rows' keys and values."""

    def query(spark, d):
        df = _items(spark, d)
        return df.filter(condition(F.col("l_quantity"), F.col("l_extendedprice"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")

    QUERIES[name] = query
    SQL[name] = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE {sql}"


_counted("restrict_expr", lambda x, y: R.true_half((x - 25) * 0.04), "abs((l_quantity - 25) * 0.04) >= 0.5")
_counted("sample_expr", lambda x, y: R.true_rounded((x - 25) * 0.25), "round_even((l_quantity - 25) * 0.25, 0) <> 0")
_counted("restrict_region_above", lambda x, y: R.above_line(x, y, 0.0, 1000.0, 50.0, 60000.0), "l_extendedprice > 1000 + l_quantity * 1180")
_counted("restrict_region_below", lambda x, y: R.below_line(x, y, 0.0, 1000.0, 50.0, 60000.0), "l_extendedprice < 1000 + l_quantity * 1180")
_counted("restrict_region_left", lambda x, y: R.left_of_line(x, y, 0.0, 0.0, 50.0, 100000.0), "l_quantity < l_extendedprice * (50.0::DOUBLE / 100000.0)")
_counted("restrict_region_band", lambda x, y: R.in_band(x, 10.0, 20.0) & ~R.in_band(y, 20000.0, 30000.0), "l_quantity BETWEEN 10 AND 20 AND NOT l_extendedprice BETWEEN 20000 AND 30000")
_edge = lambda a, b: (
    f"CASE WHEN l_extendedprice > {min(a[1], b[1])} AND l_extendedprice <= {max(a[1], b[1])} AND l_quantity < {a[0]} + (l_extendedprice - {a[1]}) * (({b[0]} - {a[0]})::DOUBLE / ({b[1]} - {a[1]})) THEN 1 ELSE 0 END"
)
_counted("restrict_region_polygon", lambda x, y: R.in_polygon(x, y, POLYGON), "(" + " + ".join(_edge(a, b) for a, b in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])) + ") % 2 = 1")
_counted("world_filter", lambda x, y: R.in_world(x, y, 5.0, 30.0, 1000.0, 30000.0), "l_quantity BETWEEN 5 AND 30 AND l_extendedprice BETWEEN 1000 AND 30000")
_counted("disc_filter", lambda x, y: R.in_disc(x, y / 1000, 25.0, 30.0, 12.5), "(l_quantity - 25) ** 2 + (l_extendedprice / 1000 - 30) ** 2 < 156.25")


def region_report(spark, d):
    return R.region_report(events(spark, d), USER, R.in_band(F.col("y"), 100.0, 200.0))


SQL["region_report"] = EVENTS_SQL + "SELECT user_id, count(*) AS points FROM e WHERE y BETWEEN 100 AND 200 GROUP BY user_id"


def range_conditioned_extremes(spark, d):
    return R.range_of_where(_items(spark, d).withColumn("g", F.col("l_suppkey") % 7), ["g"], "l_extendedprice", "l_quantity", 10.0, 20.0)


SQL["range_conditioned_extremes"] = "SELECT l_suppkey % 7 AS g, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY 1"


def assign_column(spark, d):
    """Vector assignment, with an element assignment at position 2 of each user's events."""
    df = S.numbered(events(spark, d), USER, BY_TIME).withColumn("y", F.col("y") * 2 + 1)
    return rounded(df.withColumn("y", F.when(F.col("pos") == 2, 0.0).otherwise(F.col("y"))).select("user_id", "pos", "y"), "y")


SQL["assign_column"] = EVENTS_SQL + "SELECT user_id, pos, round(CASE WHEN pos = 2 THEN 0 ELSE y * 2 + 1 END, 6) + 0.0 AS y FROM e"


def append_sets(spark, d):
    df = events(spark, d)
    return M.appended(df.filter("event_type = 'click'"), df.filter("event_type = 'view'"), USER, BY_TIME).select("user_id", "event_id", "pos")


SQL["append_sets"] = (
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 ELSE 1 END, ts, event_id) - 1 AS pos FROM events WHERE event_type IN ('click', 'view')"
)


def split_sets(spark, d):
    return M.split(events(spark, d), USER, BY_TIME, 20).select("user_id", "event_id", "chunk", "pos")


SQL["split_sets"] = EVENTS_SQL + "SELECT user_id, event_id, pos // 20 AS chunk, pos % 20 AS pos FROM e"


def pack_sets(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return M.packed(df, "o_custkey")


SQL["pack_sets"] = "SELECT o_custkey, o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS packed FROM orders"


def swap_sets(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    return M.swapped(df, "event_type", "click", "view")


SQL["swap_sets"] = "SELECT event_id, CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE event_type END AS event_type FROM events"


def copy_and_kill_sets(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    return M.killed(M.copied(df, "event_type", "click", "click_copy"), "event_type", ["view"])


SQL["copy_and_kill_sets"] = "SELECT event_id, event_type FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, 'click_copy' FROM events WHERE event_type = 'click'"


def move_set(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    return M.moved(df, "event_type", "click", "view")


SQL["move_set"] = "SELECT event_id, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS event_type FROM events WHERE event_type <> 'view'"


def nxy_unpivot(spark, d):
    return M.unpivoted(_items(spark, d), ["l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", ["l_extendedprice", "l_discount", "l_tax"]).withColumn("y", F.col("y") + 0.0)


SQL["nxy_unpivot"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, s::INTEGER AS set, CASE s WHEN 0 THEN l_extendedprice WHEN 1 THEN l_discount ELSE l_tax END + 0.0 AS y
FROM lineitem, generate_series(0, 2) AS g(s)"""


def zip_join(spark, d):
    """Cross-set arithmetic by position: each user's values against themselves in order of size."""
    df = events(spark, d)
    a = S.numbered(df, USER, BY_TIME)
    b = S.sorted_set(df, USER, "y", BY_TIME)
    return rounded(J.zipped(a, b, USER, "pos", ["y"]).select("user_id", "pos", (F.col("a_y") - F.col("b_y")).alias("d")), "d")


SQL["zip_join"] = (
    EVENTS_SQL
    + ", s AS (SELECT user_id, y, row_number() OVER (PARTITION BY user_id ORDER BY y, pos) - 1 AS pos FROM e) SELECT e.user_id, e.pos, round(e.y - s.y, 6) + 0.0 AS d FROM e JOIN s USING (user_id, pos)"
)


def lookup_left_null(spark, d):
    parts = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return J.looked_up(_items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", "p_retailprice")


SQL["lookup_left_null"] = "SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey"


def lookup_left_default(spark, d):
    parts = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return J.looked_up(_items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", "p_retailprice", 0.0)


SQL["lookup_left_default"] = (
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_retailprice, 0.0) AS p_retailprice FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey"
)


def _pair_counts(spark, d):
    return _items(spark, d).groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.count(F.lit(1)).alias("c"))


def semi_two_axis(spark, d):
    keep = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("state"))
    return J.on_both_axes(_pair_counts(spark, d), keep)


SQL["semi_two_axis"] = """
SELECT l_partkey AS i, l_suppkey AS j, count(*) AS c FROM lineitem
WHERE l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2"""


def intersect_states(spark, d):
    df = table(spark, d, "events").groupBy("event_type", F.floor("value").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return J.shared_states(df, "event_type", "state", "n")


SQL["intersect_states"] = """
WITH s AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS state, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a.event_type AS block_a, b.event_type AS block_b, a.state, a.n AS value_a, b.n AS value_b FROM s a JOIN s b ON a.state = b.state AND a.event_type < b.event_type"""


def outer_compare(spark, d):
    df = table(spark, d, "events")
    per = lambda t: df.filter(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return J.compared(per("click"), per("view"), ["user_id"], "n")


SQL["outer_compare"] = """
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, a.n AS a_value, b.n AS b_value, CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' ELSE 'differs' END AS kind
FROM a FULL JOIN b USING (user_id) WHERE a.n IS DISTINCT FROM b.n"""


def asof_ffill(spark, d):
    df = events(spark, d).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return J.as_of(df, USER, BY_TIME, "bought", 0.0).select("user_id", "event_id", "bought")


SQL["asof_ffill"] = (
    EVENTS_SQL
    + "SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0.0) AS bought FROM e"
)


def asof_join(spark, d):
    """Each click with the latest view of the same user."""
    df = events(spark, d).select("user_id", "event_id", "event_type", micros("ts").alias("t"), "value")
    views = df.filter("event_type = 'view'").select("user_id", "t", F.col("value").alias("viewed"), F.col("event_id").alias("view_id"))
    return J.as_of_join(df.filter("event_type = 'click'").select("user_id", "t", "event_id"), views, USER, "t", ["view_id", "viewed"]).drop("t")


SQL["asof_join"] = """
SELECT c.user_id, c.event_id, v.event_id AS view_id, v.value AS viewed FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts"""


def interp_linear(spark, d):
    """Each user's values at every full day on which they are looked at, ends continued."""
    df = events(spark, d)
    mesh = df.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day")).distinct().select("user_id", (F.col("day") * 24.0).alias("x"))
    return rounded(J.interpolated(mesh, df, USER, "x", "y"), "y", digits=4)


SQL["interp_linear"] = (
    EVENTS_SQL
    + """, m AS (SELECT user_id, d * 24.0::DOUBLE AS mx FROM (SELECT DISTINCT user_id FROM e), generate_series(0, 29) AS g(d)),
b AS (SELECT m.user_id, m.mx, greatest(0, least(max(e.n) - 2, coalesce(max(CASE WHEN e.x <= m.mx THEN e.pos END), 0))) AS k FROM m JOIN e USING (user_id) GROUP BY 1, 2)
SELECT b.user_id, b.mx AS x, round(p.y + (q.y - p.y) * (b.mx - p.x) / (q.x - p.x), 4) + 0.0 AS y
FROM b JOIN e p ON p.user_id = b.user_id AND p.pos = b.k JOIN e q ON q.user_id = b.user_id AND q.pos = b.k + 1"""
)


def range_category(spark, d):
    ranges = [("small", 0.0, 100.0), ("middle", 100.0, 250.0), ("large", 250.0, 400.0)]
    return J.ranged(table(spark, d, "events").select("event_id", "value"), "value", ranges).drop("value")


SQL["range_category"] = (
    "SELECT event_id, CASE WHEN value BETWEEN 0 AND 100 THEN 'small' WHEN value BETWEEN 100 AND 250 THEN 'middle' WHEN value BETWEEN 250 AND 400 THEN 'large' END AS category FROM events"
)


def _atoms(spark, d):
    """Events as points in space, one structure per event type: hours, value and user."""
    return events(spark, d).select("event_type", "event_id", (F.col("x") / 24).alias("x"), (F.col("y") / 10).alias("y"), F.col("user_id").cast("double").alias("z"))


def contact_pairs(spark, d):
    atoms = _atoms(spark, d)
    return rounded(J.neighbours(atoms, ["x", "y", "z"], 2.0, ["event_id"], ["event_type"]), "distance")


_ATOMS = EVENTS_SQL + ", p AS (SELECT event_type, event_id, x / 24 AS x, y / 10 AS y, user_id::DOUBLE AS z FROM e)"
SQL["contact_pairs"] = (
    _ATOMS
    + """, q AS (SELECT a.event_type, a.event_id AS a_event_id, b.event_id AS b_event_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance
  FROM p a JOIN p b ON a.event_type = b.event_type AND a.event_id < b.event_id AND abs(a.z - b.z) < 2)
SELECT event_type, a_event_id, b_event_id, round(distance, 6) + 0.0 AS distance FROM q WHERE distance < 2"""
)


def neighbour_count(spark, d):
    atoms = _atoms(spark, d)
    pairs = J.neighbours(atoms, ["x", "y", "z"], 2.0, ["event_id"], ["event_type"])
    both = pairs.select("event_type", F.explode(F.array("a_event_id", "b_event_id")).alias("event_id"))
    return both.groupBy("event_type", "event_id").agg(F.count(F.lit(1)).alias("neighbours"))


SQL["neighbour_count"] = (
    _ATOMS
    + """SELECT a.event_type, a.event_id, count(*) AS neighbours FROM p a JOIN p b ON a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(a.z - b.z) < 2
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 2 GROUP BY 1, 2"""
)


def nearest_medoid(spark, d):
    """All embeddings against those whose id is divisible by 100."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    centres = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("medoid"), "embedding")
    return rounded(J.nearest(df, centres, "embedding").select("vec_id", "medoid", "distance"), "distance", digits=5)


SQL["nearest_medoid"] = """
WITH q AS (SELECT a.vec_id, b.vec_id AS medoid, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS distance
  FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)
SELECT vec_id, arg_min(medoid, (distance, medoid)) AS medoid, round(min(distance), 5) + 0.0 AS distance FROM q GROUP BY vec_id"""


def embedding_silhouettes(spark, d):
    """Silhouettes, among all embeddings, of those whose id is divisible by 100."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return rounded(J.silhouettes(df, "vec_id", "embedding", "label", df.filter("vec_id % 100 = 0")), "own", "other", "silhouette", digits=5)


SQL["embedding_silhouettes"] = """
WITH m AS (SELECT a.vec_id, a.label, b.label AS l, avg(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))) AS m
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(m) FILTER (l = label) AS own, min(m) FILTER (l <> label) AS other FROM m GROUP BY 1, 2)
SELECT vec_id, label, round(own, 5) + 0.0 AS own, round(other, 5) + 0.0 AS other, round(CASE WHEN other IS NULL THEN NULL WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 5) + 0.0 AS silhouette FROM s"""

for _f in (
    embedding_silhouettes, region_report, range_conditioned_extremes, assign_column, append_sets, split_sets, pack_sets, swap_sets, copy_and_kill_sets, move_set, nxy_unpivot, zip_join, lookup_left_null,
    lookup_left_default, semi_two_axis, intersect_states, outer_compare, asof_ffill, asof_join, interp_linear, range_category, contact_pairs, neighbour_count, nearest_medoid,
):
    QUERIES[_f.__name__] = _f
