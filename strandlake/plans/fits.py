"""Queries of fits, spectra and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import regress as R
from strandlake.operators import signal as G
from strandlake.plans.common import BY_TIME, EVENTS_SQL, USER, events, rounded
from strandlake.session import table

QUERIES, SQL = {}, {}
GROUP = ["l_returnflag", "l_linestatus"]


def regress_linear(spark, d):
    names = ["slope", "intercept", "r", "rss", "r2", "f", "se_slope", "t_slope"]
    df = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return rounded(R.linear(df, GROUP, "l_quantity", "y"), *names, digits=5)


_LINEAR = """
WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, regr_slope(y, l_quantity) AS slope, regr_intercept(y, l_quantity) AS intercept,
  regr_sxx(y, l_quantity) AS sxx, regr_syy(y, l_quantity) AS syy, regr_sxy(y, l_quantity) AS sxy
  FROM (SELECT *, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1, 2),
q AS (SELECT *, sxy / sqrt(sxx * syy) AS r, syy - slope * sxy AS rss, (syy - slope * sxy) / (n - 2) AS s2 FROM s)"""
SQL["regress_linear"] = (
    _LINEAR
    + """SELECT l_returnflag, l_linestatus, n, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept, round(r, 5) + 0.0 AS r, round(rss, 5) + 0.0 AS rss,
  round(r * r, 5) + 0.0 AS r2, round(slope * sxy / s2, 5) + 0.0 AS f, round(sqrt(s2 / sxx), 5) + 0.0 AS se_slope, round(slope / sqrt(s2 / sxx), 5) + 0.0 AS t_slope FROM q"""
)


def _transformed(kind):
    def query(spark, d):
        return rounded(R.transformed(table(spark, d, "lineitem"), GROUP, "l_quantity", "l_extendedprice", kind), "a", "b")

    return query


for _kind, (_u, _v, _a) in {
    "power": ("ln(l_quantity)", "ln(l_extendedprice)", "exp(regr_intercept(v, u))"),
    "exponential": ("l_quantity", "ln(l_extendedprice)", "exp(regr_intercept(v, u))"),
    "logarithmic": ("ln(l_quantity)", "l_extendedprice", "regr_intercept(v, u)"),
    "inverse": ("l_quantity", "1 / l_extendedprice", "regr_intercept(v, u)"),
}.items():
    QUERIES[f"regress_{_kind}"] = _transformed(_kind)
    SQL[f"regress_{_kind}"] = f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, round({_a}, 6) + 0.0 AS a, round(regr_slope(v, u), 6) + 0.0 AS b
FROM (SELECT l_returnflag, l_linestatus, {_u} AS u, {_v} AS v FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0) GROUP BY 1, 2"""


def regress_residuals(spark, d):
    """Data minus the fitted line, summed up per group and quantity."""
    df = table(spark, d, "lineitem")
    fit = R.linear(df, GROUP, "l_quantity", "l_extendedprice").select(*GROUP, "slope", "intercept")
    rest = df.join(fit, GROUP).withColumn("e", F.col("l_extendedprice") - F.col("intercept") - F.col("slope") * F.col("l_quantity"))
    return rounded(rest.groupBy(*GROUP, "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("residual")), "residual", digits=3)


SQL["regress_residuals"] = """
WITH f AS (SELECT l_returnflag, l_linestatus, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, round(avg(l_extendedprice - a - b * l_quantity), 3) + 0.0 AS residual
FROM lineitem JOIN f USING (l_returnflag, l_linestatus) GROUP BY 1, 2, 3"""


def regress_polynomial(spark, d):
    """Cubic in time of the values of each user."""
    out = R.polynomial(events(spark, d).withColumn("x", F.col("x") / 24), USER, "x", "y", 3)
    return out.withColumn("coefficients", F.transform("coefficients", lambda c: F.round(c, 5)))


def fit_nonlinear(spark, d):
    """a * exp(-b * size) + c fitted to the prices of each return flag."""
    df = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    fit = R.nonlinear(df, ["l_returnflag"], "l_quantity", "y", lambda x, p: p[0] * F.exp(-p[1] * x) + p[2], [-50.0, 0.02, 50.0], rounds=6)
    return fit.withColumn("parameters", F.transform("parameters", lambda c: F.round(c, 3))).withColumn("rss", F.round("rss", 2))


def fourier_spectrum(spark, d):
    """All terms of each user, k = 0..n/2."""
    return G.rounded_spectrum(events(spark, d), USER, BY_TIME, "y", digits=5)


_SPECTRUM = (
    EVENTS_SQL
    + """, t AS (SELECT user_id, k::INTEGER AS k, max(n) AS n, sum(y * cos(2 * pi() * ((pos * k) % n) / n)) / max(n) AS re, -sum(y * sin(2 * pi() * ((pos * k) % n) / n)) / max(n) AS im
  FROM (SELECT *, unnest(generate_series(0, n // 2)) AS k FROM e) GROUP BY 1, 2),
f AS (SELECT user_id, k, re, im, CASE WHEN 2 * k = n THEN 1 ELSE 2 END * sqrt(re * re + im * im) AS m FROM t)"""
)
SQL["fourier_spectrum"] = _SPECTRUM + "SELECT user_id, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im, round(m, 5) + 0.0 AS magnitude FROM f"


def fourier_terms(spark, d):
    """Magnitude of all terms of each user above k = 0, and its part of the power of them all."""
    terms = G.spectrum(events(spark, d), USER, BY_TIME, "y").filter("k > 0")
    power = F.col("magnitude") * F.col("magnitude")
    return rounded(terms.select("user_id", "k", "magnitude", (power / F.sum(power).over(G.Window.partitionBy("user_id"))).alias("part")), "magnitude", "part", digits=7)


SQL["fourier_terms"] = _SPECTRUM + "SELECT user_id, k, round(m, 7) + 0.0 AS magnitude, round(m * m / sum(m * m) OVER (PARTITION BY user_id), 7) + 0.0 AS part FROM f WHERE k > 0"


def dominant_frequency(spark, d):
    """The strongest of all terms of each user above k = 0, and its part of the power of them all."""
    terms = G.spectrum(events(spark, d), USER, BY_TIME, "y").filter("k > 0")
    power = terms.groupBy(*USER).agg(F.sum(F.col("magnitude") * F.col("magnitude")).alias("_power"))
    best = G.dominant_frequency(events(spark, d), USER, BY_TIME, "y").join(power, USER)
    return rounded(best.select(*USER, "k", "magnitude", (F.col("magnitude") * F.col("magnitude") / F.col("_power")).alias("part")), "magnitude", "part", digits=5)


SQL["dominant_frequency"] = (
    _SPECTRUM
    + """, g AS (SELECT user_id, k, m, round(m, 9) AS r FROM f WHERE k > 0)
SELECT user_id, arg_min(k, (-r, k)) AS k, round(max(r), 5) + 0.0 AS magnitude, round(max(r) * max(r) / sum(m * m), 5) + 0.0 AS part FROM g GROUP BY 1"""
)


def inverse_fourier(spark, d):
    """Each user's values back from all their terms."""
    df = events(spark, d)
    lengths = df.groupBy(*USER).agg(F.count(F.lit(1)).alias("n"))
    return rounded(G.inverse_spectrum(G.spectrum(df, USER, BY_TIME, "y"), USER, lengths), "y", digits=5)


SQL["inverse_fourier"] = EVENTS_SQL + "SELECT user_id, pos, round(y, 5) + 0.0 AS y FROM e"


def strongest_frequency(spark, d):
    """The strongest of all terms of each user above k = 0."""
    return rounded(G.dominant_frequency(events(spark, d), USER, BY_TIME, "y"), "magnitude", digits=5)


SQL["strongest_frequency"] = (
    _SPECTRUM
    + """, g AS (SELECT user_id, k, round(m, 9) AS m FROM f WHERE k > 0)
SELECT user_id, arg_min(k, (-m, k)) AS k, round(max(m), 5) + 0.0 AS magnitude FROM g GROUP BY 1"""
)


def akima_curve(spark, d):
    return rounded(G.akima(events(spark, d), USER, BY_TIME, "x", "y", 4), "x", "y", digits=4)


# Slopes at the points from two spans on either side, those beyond the ends carried on in a straight line; then the cubic of each span.
SQL["akima_curve"] = (
    EVENTS_SQL
    + """, m AS (SELECT user_id, pos, n, x, y, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
q AS (SELECT user_id, array_agg(m ORDER BY pos) FILTER (m IS NOT NULL) AS v FROM m WHERE n >= 3 GROUP BY 1),
v AS (SELECT user_id, list_concat([3 * v[1] - 2 * v[2], 2 * v[1] - v[2]], v, [2 * v[-1] - v[-2], 3 * v[-1] - 2 * v[-2]]) AS v FROM q),
k AS (SELECT m.*, v[pos + 1] AS p2, v[pos + 2] AS p1, v[pos + 3] AS q1, v[pos + 4] AS q2 FROM m JOIN v USING (user_id)),
t AS (SELECT user_id, pos, x, y, CASE WHEN abs(q2 - q1) + abs(p1 - p2) > 0 THEN (abs(q2 - q1) * p1 + abs(p1 - p2) * q1) / (abs(q2 - q1) + abs(p1 - p2)) ELSE (p1 + q1) / 2 END AS t FROM k),
s AS (SELECT user_id, x, y, t, lead(x) OVER w - x AS h, lead(y) OVER w AS y1, lead(t) OVER w AS t1 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
c AS (SELECT *, y AS a0, t * h AS a1, 3 * (y1 - y) - (2 * t + t1) * h AS a2, 2 * (y - y1) + (t + t1) * h AS a3, unnest([0, 0.25, 0.5, 0.75])::DOUBLE AS u FROM s WHERE h > 0)
SELECT user_id, round(x + u * h, 4) + 0.0 AS x, round(a0 + u * (a1 + u * (a2 + u * a3)), 4) + 0.0 AS y FROM c"""
)


def prune_points(spark, d):
    return G.pruned(events(spark, d), ["event_type"], BY_TIME, "x", "y", 12.0, 25.0).select("event_type", "event_id")


def spline_curve(spark, d):
    return rounded(G.cubic_spline(events(spark, d), USER, "x", "y", 4), "x", "y", digits=4)


def straighten_points(spark, d):
    return G.straightened(events(spark, d), ["event_type"], BY_TIME, "x", "y", 200.0).select("event_type", "event_id")


for _f in (spline_curve, straighten_points, regress_linear, regress_residuals, regress_polynomial, fit_nonlinear, fourier_terms, dominant_frequency, inverse_fourier, fourier_spectrum, strongest_frequency, akima_curve, prune_points):
    QUERIES[_f.__name__] = _f
