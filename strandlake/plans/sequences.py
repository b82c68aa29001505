"""Queries of the sequence operators, on the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import sequence as S
from strandlake.plans.common import BY_TIME, EVENTS_SQL, USER, events, rounded

QUERIES, SQL = {}, {}
W = 5


def _running(how):
    def query(spark, d):
        return rounded(S.running(events(spark, d), USER, BY_TIME, "x", "y", W, how), "x", "y")

    return query


for _how, _y in {"avg": "avg(y) OVER f", "std": "stddev_samp(y) OVER f", "median": "median(y) OVER f", "min": "min(y) OVER f", "max": "max(y) OVER f"}.items():
    _x = "lead(x, 2) OVER w" if _how == "median" else "avg(x) OVER f"
    QUERIES[f"running_{_how}"] = _running(_how)
    SQL[f"running_{_how}"] = (
        EVENTS_SQL
        + f""", r AS (SELECT user_id, pos, n, {_x} AS x, {_y} AS y, count(*) OVER f AS k FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY pos), f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING))
SELECT user_id, pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM r WHERE k = {W} AND n > {W}"""
    )


def running_sum(spark, d):
    return rounded(S.cumulative_sum(events(spark, d), USER, BY_TIME, "y").select("user_id", "event_id", "running_sum"), "running_sum")


SQL["running_sum"] = EVENTS_SQL + "SELECT user_id, event_id, round(sum(y) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS running_sum FROM e"


def cumulative_integral(spark, d):
    return rounded(S.cumulative_integral(events(spark, d), USER, BY_TIME, "x", "y").select("user_id", "event_id", "integral"), "integral", digits=4)


SQL["cumulative_integral"] = (
    EVENTS_SQL
    + """, a AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS area FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, event_id, round(coalesce(sum(area) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0), 4) + 0.0 AS integral FROM a WHERE n >= 3"""
)


def _difference(kind):
    def query(spark, d):
        return rounded(S.difference(events(spark, d), USER, BY_TIME, "x", "y", kind), "x", "dy", digits=5)

    return query


for _kind, (_a, _b) in {"forward": (0, 1), "backward": (-1, 0), "centred": (-1, 1)}.items():
    QUERIES[f"difference_{_kind}"] = _difference(_kind)
    _at = lambda c, k: c if k == 0 else f"lead({c}) OVER w" if k > 0 else f"lag({c}) OVER w"
    SQL[f"difference_{_kind}"] = (
        EVENTS_SQL
        + f""", p AS (SELECT user_id, pos, x, {_at('x', _a)} AS x0, {_at('y', _a)} AS y0, {_at('x', _b)} AS x1, {_at('y', _b)} AS y1 FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, pos, round(x, 5) + 0.0 AS x, round((y1 - y0) / (x1 - x0), 5) + 0.0 AS dy FROM p WHERE x0 IS NOT NULL AND x1 IS NOT NULL"""
    )


def difference_seasonal(spark, d):
    return rounded(S.seasonal_difference(events(spark, d), USER, BY_TIME, "y", 7).select("user_id", "pos", "dy"), "dy")


SQL["difference_seasonal"] = (
    EVENTS_SQL + ", s AS (SELECT user_id, pos, y - lead(y, 7) OVER (PARTITION BY user_id ORDER BY pos) AS dy FROM e) SELECT user_id, pos, round(dy, 6) + 0.0 AS dy FROM s WHERE dy IS NOT NULL"
)


def reverse_set(spark, d):
    return S.reversed_set(events(spark, d), USER, BY_TIME).select("user_id", "event_id", "pos")


SQL["reverse_set"] = EVENTS_SQL + "SELECT user_id, event_id, n - 1 - pos AS pos FROM e"


def sort_set(spark, d):
    return S.sorted_set(events(spark, d), USER, "y", BY_TIME, descending=True).select("user_id", "event_id", "pos")


SQL["sort_set"] = EVENTS_SQL + "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, pos) - 1 AS pos FROM e"


def slice_set(spark, d):
    return S.sliced(events(spark, d), USER, BY_TIME, 3, 12).select("user_id", "event_id", "pos")


SQL["slice_set"] = EVENTS_SQL + "SELECT user_id, event_id, pos - 3 AS pos FROM e WHERE pos BETWEEN 3 AND 12"


def drop_range(spark, d):
    return S.without_range(events(spark, d), USER, BY_TIME, 3, 12).select("user_id", "event_id", "pos")


SQL["drop_range"] = EVENTS_SQL + "SELECT user_id, event_id, CASE WHEN pos > 12 THEN pos - 10 ELSE pos END AS pos FROM e WHERE NOT pos BETWEEN 3 AND 12"


def sample_step(spark, d):
    return S.every(events(spark, d), USER, BY_TIME, 2, 3).select("user_id", "event_id")


SQL["sample_step"] = EVENTS_SQL + "SELECT user_id, event_id FROM e WHERE pos >= 1 AND (pos - 1) % 3 = 0 AND n > 2"


def resize_set(spark, d):
    return rounded(S.resized(events(spark, d), USER, BY_TIME, 60, ["y"]), "y")


SQL["resize_set"] = (
    EVENTS_SQL
    + """SELECT user_id, pos, round(y, 6) + 0.0 AS y FROM e WHERE pos < 60
UNION ALL SELECT user_id, unnest(generate_series(n, 59)) AS pos, 0.0 AS y FROM (SELECT DISTINCT user_id, n FROM e WHERE n < 60)"""
)


def _correlation(covariance):
    def query(spark, d):
        return rounded(S.correlated(events(spark, d), USER, BY_TIME, "y", "y", 8, covariance), "value")

    return query


for _name, _c in {"autocorrelation": "y", "autocovariance": "y - avg(y) OVER (PARTITION BY user_id)"}.items():
    QUERIES[_name] = _correlation(_name == "autocovariance")
    SQL[_name] = (
        EVENTS_SQL
        + f""", c AS (SELECT user_id, pos, {_c} AS v FROM e), l AS (SELECT CAST(unnest(generate_series(0, 7)) AS INTEGER) AS lag),
s AS (SELECT a.user_id, l.lag, sum(a.v * b.v) AS s FROM c a JOIN l ON true LEFT JOIN c b ON a.user_id = b.user_id AND b.pos = a.pos + l.lag GROUP BY 1, 2)
SELECT user_id, lag, round(s / abs(max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY user_id)), 6) + 0.0 AS value FROM s"""
    )


def digital_filter(spark, d):
    return rounded(S.filtered(events(spark, d), USER, BY_TIME, "x", "y", [0.25, 0.5, 0.25]), "x", "y")


SQL["digital_filter"] = (
    EVENTS_SQL
    + """, f AS (SELECT user_id, pos, (x + lead(x, 2) OVER w) / 2 AS x, 0.25 * y + 0.5 * lead(y) OVER w + 0.25 * lead(y, 2) OVER w AS y FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM f WHERE x IS NOT NULL"""
)


def linear_convolution(spark, d):
    return rounded(S.convolved(events(spark, d), USER, BY_TIME, "y", [1.0, -2.0, 1.0]), "y")


SQL["linear_convolution"] = (
    EVENTS_SQL
    + """, k AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, -2.0::DOUBLE), (2, 1.0::DOUBLE)) AS k(i, c))
SELECT user_id, pos + i AS pos, round(sum(y * c), 6) + 0.0 AS y FROM e, k GROUP BY user_id, pos + i"""
)


def data_windows(spark, d):
    df = S.numbered(events(spark, d), USER, BY_TIME).withColumn("n", F.count(F.lit(1)).over(S.Window.partitionBy("user_id"))).filter("n > 1")
    kinds = ["triangular", "hanning", "welch", "hamming", "blackman", "parzen"]
    return rounded(df.select("user_id", "pos", *((F.col("x") * S.taper(k, F.col("pos"), F.col("n"))).alias(k) for k in kinds)), *kinds)


SQL["data_windows"] = (
    EVENTS_SQL
    + """SELECT user_id, pos, round(x * (1 - abs((pos - 0.5 * (n - 1)) / (0.5 * (n - 1)))), 6) + 0.0 AS triangular,
  round(x * (0.5 - 0.5 * cos(2 * pi() * pos / (n - 1))), 6) + 0.0 AS hanning,
  round(x * (1 - pow((pos - 0.5 * (n - 1)) / (0.5 * (n + 1)), 2)), 6) + 0.0 AS welch,
  round(x * (0.54 - 0.46 * cos(2 * pi() * pos / (n - 1))), 6) + 0.0 AS hamming,
  round(x * (0.42 - 0.5 * cos(2 * pi() * pos / (n - 1)) + 0.08 * cos(4 * pi() * pos / (n - 1))), 6) + 0.0 AS blackman,
  round(x * (1 - abs((pos - 0.5 * (n - 1)) / (0.5 * (n + 1)))), 6) + 0.0 AS parzen FROM e WHERE n > 1"""
)


def change_points(spark, d):
    return S.changes(events(spark, d), USER, BY_TIME, "event_type").select("user_id", "event_id", "event_type")


SQL["change_points"] = (
    EVENTS_SQL
    + ", c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM e) SELECT user_id, event_id, event_type FROM c WHERE before IS NULL OR before <> event_type"
)


def path_dihedrals(spark, d):
    """Torsions along the path (hour of x, y, day) of each user's events."""
    df = events(spark, d).withColumn("z", F.col("x") % 24)
    return rounded(S.dihedrals(df, USER, BY_TIME, ("x", "y", "z")), "sin", "cos", "degrees", digits=4)


# By the angle between the planes of three points, its sign from the triple product of the bonds.
SQL["path_dihedrals"] = (
    EVENTS_SQL
    + """, p AS (SELECT user_id, pos, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, fmod(lead(x) OVER w, 24) - fmod(x, 24) AS dz FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, pos, dx AS ux, dy AS uy, dz AS uz, lead(dx) OVER w AS vx, lead(dy) OVER w AS vy, lead(dz) OVER w AS vz, lead(dx, 2) OVER w AS wx, lead(dy, 2) OVER w AS wy, lead(dz, 2) OVER w AS wz
  FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
n AS (SELECT user_id, pos, sqrt(vx * vx + vy * vy + vz * vz) * (ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx)) AS s,
  (uy * vz - uz * vy) * (vy * wz - vz * wy) + (uz * vx - ux * vz) * (vz * wx - vx * wz) + (ux * vy - uy * vx) * (vx * wy - vy * wx) AS c FROM b WHERE wx IS NOT NULL)
SELECT user_id, pos, round(s / sqrt(s * s + c * c), 4) + 0.0 AS sin, round(c / sqrt(s * s + c * c), 4) + 0.0 AS cos, round(degrees(atan2(s, c)), 4) + 0.0 AS degrees FROM n"""
)

for _f in (running_sum, cumulative_integral, difference_seasonal, reverse_set, sort_set, slice_set, drop_range, sample_step, resize_set, digital_filter, linear_convolution, data_windows, change_points, path_dihedrals):
    QUERIES[_f.__name__] = _f
