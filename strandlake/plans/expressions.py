"""Queries of column functions: arithmetic, dates, text, space."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import dates as D
from strandlake.functions import numeric as N
from strandlake.functions import special as S
from strandlake.functions import text as T
from strandlake.operators import joins as J
from strandlake.operators import spatial as P
from strandlake.plans.common import EVENTS_SQL, events, rounded
from strandlake.session import table

QUERIES, SQL = {}, {}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _expression(name, columns, sql):
    def query(spark, d):
        df = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity")).withColumn("p", F.col("l_extendedprice") / 1000).withColumn("d", F.col("l_discount") * 100)
        made = columns(F.col("q"), F.col("p"), F.col("d"))
        return rounded(df.select(*KEY, *(c.alias(n) for n, c in made.items())), *made)

    QUERIES[name] = query
    SQL[name] = f"SELECT {_KEYS}, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in sql.items()) + " FROM (SELECT *, l_quantity AS q, l_extendedprice / 1000 AS p, l_discount * 100 AS d FROM lineitem)"


_expression(
    "expr_arithmetic",
    lambda q, p, d: {"a": q * 2 - p / 3, "b": N.remainder(p, q + 1), "c": N.power(q, F.lit(1.5)), "e": N.divided(p, q * F.pi()), "f": q * N.DEG},
    {"a": "q * 2 - p / 3", "b": "fmod(p, q + 1)", "c": "pow(q, 1.5)", "e": "p / (q * pi())", "f": f"q * {N.DEG!r}::DOUBLE"},
)
_expression(
    "expr_comparison",
    lambda q, p, d: {"a": N.truth(q > p), "b": N.truth((q >= 10) & (p < 30)), "c": N.truth(~(q == 5)), "e": N.choose((q - 25) * 0.04, p, -p)},
    {
        "a": "CASE WHEN q > p THEN 1.0::DOUBLE ELSE 0.0 END", "b": "CASE WHEN q >= 10 AND p < 30 THEN 1.0::DOUBLE ELSE 0.0 END", "c": "CASE WHEN q <> 5 THEN 1.0::DOUBLE ELSE 0.0 END",
        "e": "CASE WHEN abs((q - 25) * 0.04) >= 0.5 THEN p ELSE -p END",
    },
)
_expression(
    "expr_functions",
    lambda q, p, d: {
        "a": F.sqrt(q) + F.log(p + 1), "b": F.sin(q) * F.cos(p), "c": F.atan2(q, p), "e": F.hypot(q, p), "f": F.asinh(q), "g": F.log10(q) + F.log2(q), "h": F.rint(p / 2), "i": F.signum(q - 25),
        "j": F.greatest(q, p) - F.least(q, p), "k": N.normal_density(d / 5), "l": F.floor(p) + F.ceil(p), "m": F.exp(-d),
    },
    {
        "a": "sqrt(q) + ln(p + 1)", "b": "sin(q) * cos(p)", "c": "atan2(q, p)", "e": "sqrt(q * q + p * p)", "f": "asinh(q)", "g": "log10(q) + log2(q)", "h": "round_even(p / 2, 0)", "i": "sign(q - 25)::DOUBLE",
        "j": "greatest(q, p) - least(q, p)", "k": "exp(-(d / 5) * (d / 5) / 2) / sqrt(2 * pi())", "l": "(floor(p) + ceil(p))::DOUBLE", "m": "exp(-d)",
    },
)


_expression(
    "expr_elementary",
    lambda q, p, d: {
        "a": F.abs(d - q), "b": F.acos(d / 11), "c": F.acosh(q), "e": F.asin(d / 11), "f": F.atan(p), "g": F.atanh(d / 11), "h": F.cosh(d / 5), "i": F.sinh(d / 5), "j": q * q, "k": F.tan(d / 7), "l": F.tanh(d / 5), "m": F.radians(p),
        "o": F.concat(F.lit("q"), q.cast("int").cast("string")).substr(2, 9).cast("double"),
    },
    {
        "a": "abs(d - q)", "b": "acos(d / 11)", "c": "acosh(q)", "e": "asin(d / 11)", "f": "atan(p)", "g": "atanh(d / 11)", "h": "cosh(d / 5)", "i": "sinh(d / 5)", "j": "q * q", "k": "tan(d / 7)", "l": "tanh(d / 5)", "m": "radians(p)",
        "o": "CAST(substr('q' || q::INTEGER, 2) AS DOUBLE)",
    },
)


def expr_special_closed(spark, d):
    """Special functions where they have closed forms, from the middle of distributions far into their tails, at each different quantity and discount."""
    df = table(spark, d, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))
    q, x = F.col("l_quantity"), F.col("l_discount") * 10 + 0.05
    one, two, half = F.lit(1.0), F.lit(2.0), F.lit(0.5)
    small = F.pow(F.lit(10.0), -q * 5)
    made = {
        "igam": N.gamma_lower(one, x), "igamc": F.log(N.gamma_upper(one, q * 10)), "igami": N.gamma_upper_inverse(one, small), "chdtr": N.chi2_cdf(two, x), "chdtrc": F.log(N.chi2_tail(two, q * 20)),
        "chdtri": S.chi2_upper(two, small), "pdtr": N.poisson_cdf(two, q), "pdtrc": N.poisson_tail(F.lit(0.0), x), "pdtri": S.poisson_mean(F.lit(0.0), small), "gdtr": N.gamma_cdf(x, one, q),
        "gdtrc": F.log(S.gamma_tail(x, one, q * 5)), "incbet": N.beta_incomplete(two, F.lit(3.0), x / 2), "incbi": F.log(N.beta_inverse(one, one, small)), "fdtr": N.f_cdf(two, F.lit(4.0), q), "fdtrc": F.log(N.f_tail(two, F.lit(4.0), q * 1e6)),
        "fdtri": S.f_upper(two, F.lit(4.0), x / 2), "stdtr": N.student_cdf(one, x - 0.5), "stdtri": S.student_quantile(one, x / 2), "jv": S.bessel_j(half, q * 20), "yv": S.bessel_y(half, q * 20), "iv": F.log(S.bessel_i(half, q * 10)),
        "kv": F.log(S.bessel_k(half, q * 10)), "struve": S.struve(half, q * 20), "hyperg": S.confluent(one, two, x), "hyp2f1": S.hypergeometric(one, one, two, x / 2), "expn": S.exponential_integral(F.lit(0.0), x * 9),
        "beta": S.beta(q / 7, x), "lbeta": N.log_beta(q, x), "rgamma": S.reciprocal_gamma(x), "fac": F.log(S.factorial(q)), "ellik": N.ellipse_f(x, F.lit(0.0)), "ellie": N.ellipse_e_incomplete(x, one),
    }
    return rounded(df.select("l_quantity", "l_discount", "n", *(c.alias(k) for k, c in made.items())), *made)


_CLOSED = {
    "igam": "1 - exp(-x)", "igamc": "-q * 10", "igami": "q * 5 * ln(10)", "chdtr": "1 - exp(-x / 2)", "chdtrc": "-q * 10", "chdtri": "q * 10 * ln(10)", "pdtr": "exp(-q) * (1 + q + q * q / 2)", "pdtrc": "1 - exp(-x)", "pdtri": "q * 5 * ln(10)",
    "gdtr": "1 - exp(-x * q)", "gdtrc": "-x * q * 5", "incbet": "pow(x / 2, 2) * (6 - 8 * (x / 2) + 3 * pow(x / 2, 2))", "incbi": "-q * 5 * ln(10)", "fdtr": "1 - pow(1 + q / 2, -2)", "fdtrc": "-2 * ln(1 + q * 1e6 / 2)", "fdtri": "2 * (pow(x / 2, -0.5) - 1)",
    "stdtr": "0.5 + atan(x - 0.5) / pi()", "stdtri": "tan(pi() * (x / 2 - 0.5))", "jv": "sqrt(2 / (pi() * q * 20)) * sin(q * 20)", "yv": "-sqrt(2 / (pi() * q * 20)) * cos(q * 20)", "iv": "q * 10 - 0.5 * ln(2 * pi() * q * 10) + ln(1 - exp(-q * 20))",
    "kv": "0.5 * ln(pi() / (2 * q * 10)) - q * 10", "struve": "sqrt(2 / (pi() * q * 20)) * (1 - cos(q * 20))", "hyperg": "(exp(x) - 1) / x", "hyp2f1": "-ln(1 - x / 2) / (x / 2)", "expn": "exp(-x * 9) / (x * 9)",
    "beta": "gamma(q / 7) * gamma(x) / gamma(q / 7 + x)", "lbeta": "lgamma(q) + lgamma(x) - lgamma(q + x)", "rgamma": "1 / gamma(x)", "fac": "lgamma(q + 1)", "ellik": "x", "ellie": "sin(x)",
}
SQL["expr_special_closed"] = (
    "SELECT l_quantity, l_discount, n, " + ", ".join(f"round({e}, 6) + 0.0 AS {k}" for k, e in _CLOSED.items()) + " FROM (SELECT l_quantity, l_discount, count(*) AS n, l_quantity AS q, l_discount * 10 + 0.05 AS x FROM lineitem GROUP BY 1, 2)"
)


def expr_special(spark, d):
    """Special functions of quantity and discount over all items, at each different pair of values."""
    df = table(spark, d, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))
    q, x = F.col("l_quantity") / 10, F.col("l_discount") * 10
    made = {
        "erf": N.erf(x), "gamma": N.gamma(q + 0.5), "igam": N.gamma_lower(q, x), "chi2": N.chi2_cdf(q, x), "normal": N.normal_cdf(x - 0.5), "beta": N.beta_incomplete(q, F.lit(1.5), x / 2),
        "student": N.student_cdf(q, x), "bessel_j": S.bessel_j(F.floor(q).cast("double"), x * 5), "psi": N.digamma(q),
    }
    return rounded(df.select("l_quantity", "l_discount", "n", *(c.alias(k) for k, c in made.items())), *made)


def expr_special_orders(spark, d):
    """Bessel, Airy, Struve and hypergeometric functions, integrals and quantiles, at each different quantity and discount."""
    df = table(spark, d, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))
    q, x = F.col("l_quantity") / 10, F.col("l_discount") * 10 + 0.1
    made = {
        "bessel_j": S.bessel_j(q, x), "bessel_y": S.bessel_y(x, q), "bessel_i": S.bessel_i(q, x), "bessel_k": S.bessel_k(x, q), "airy_ai": S.airy_ai(x - 0.5), "airy_bi": S.airy_bi(x - 0.5),
        "struve": S.struve(x, q), "confluent": S.confluent(x, q, x), "hypergeometric": S.hypergeometric(x, q, q + 1.5, x / 2), "expn": S.exponential_integral(F.floor(q) + 1.0, x),
        "ci": S.cosine_integral(q), "chi": S.hyperbolic_cosine_integral(x), "shi": S.hyperbolic_sine_integral(x), "beta": S.beta(q, x), "zetac": S.zeta_less_one(q + 1.05),
        "chi2_upper": S.chi2_upper(q, x / 2), "f_upper": S.f_upper(q, x * 5, x / 2), "student": S.student_quantile(q + 1, x / 2), "poisson": S.poisson_mean(q, x / 2),
    }
    return rounded(df.select("l_quantity", "l_discount", "n", *(c.alias(k) for k, c in made.items())), *made)


def expr_lgamma(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return rounded(df.select("l_quantity", "n", N.log_gamma(F.col("l_quantity") + 0.5).alias("lgamma"), N.gamma(F.col("l_quantity") / 10).alias("gamma")), "lgamma", "gamma")


SQL["expr_lgamma"] = "SELECT l_quantity, count(*) AS n, round(lgamma(l_quantity + 0.5), 6) + 0.0 AS lgamma, round(gamma(l_quantity / 10), 6) + 0.0 AS gamma FROM lineitem GROUP BY 1"


def julian_day(spark, d):
    df = table(spark, d, "orders")
    jd = D.julian_day(F.col("o_orderdate"))
    cal = D.calendar_of(jd)
    return rounded(df.select("o_orderkey", jd.alias("jd"), D.day_of_week(jd).alias("dow"), cal["year"].alias("y"), cal["month"].alias("m"), cal["day"].alias("d")), "jd")


SQL["julian_day"] = """
SELECT o_orderkey, round(epoch_us(o_orderdate) / 8.64e10 + 2440587.5, 6) + 0.0 AS jd, dayofweek(o_orderdate)::INTEGER AS dow, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d FROM orders"""


def date_parse_formats(spark, d):
    """Order dates written in three layouts and read back; made from numbers too, at noon."""
    df = table(spark, d, "orders")
    at = F.col("o_orderdate")
    layout = F.col("o_orderkey") % 3
    text = F.when(layout == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(layout == 1, F.date_format(at, "d.M.yyyy")).otherwise(F.date_format(at, "M/d/yyyy HH:mm"))
    noon = D.julian_day_of(F.year(at), F.month(at), F.dayofmonth(at))
    return rounded(df.select("o_orderkey", D.parsed_date(text).alias("jd"), noon.alias("noon")), "jd", "noon")


SQL["date_parse_formats"] = """
SELECT o_orderkey, round(epoch_us(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) ELSE date_trunc('minute', o_orderdate) END) / 8.64e10 + 2440587.5, 6) + 0.0 AS jd,
  round(epoch_us(date_trunc('day', o_orderdate)) / 8.64e10 + 2440588.0, 6) + 0.0 AS noon FROM orders"""


def json_props(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"))


SQL["json_props"] = "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k FROM events"


def map_default(spark, d):
    """Attempts of the pair 0-1 and of a pair that no run has, 0 where absent."""
    df = table(spark, d, "hremc_checkpoint")
    return df.select("run_id", "file_name", *(F.coalesce(F.try_element_at("pair_attempts", F.lit(k)), F.lit(0)).alias(n) for k, n in (("0-1", "first"), ("98-99", "none"))))


SQL["map_default"] = "SELECT run_id, file_name, coalesce(pair_attempts['0-1'], 0) AS first, coalesce(pair_attempts['98-99'], 0) AS none FROM hremc_checkpoint"


def composition_specs(spark, d):
    """Part names as NAME=count or NAME:weight, taken apart."""
    df = table(spark, d, "part")
    spec = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("="), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(":"), F.lit("0.5"))).otherwise(F.col("p_brand"))
    return df.select("p_partkey", T.composition(spec).alias("c")).select("p_partkey", "c.name", "c.n_abs", "c.w_rel")


SQL["composition_specs"] = """
SELECT p_partkey, p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS n_abs, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS w_rel FROM part"""


def sequence_identity(spark, d):
    """Each customer's name against the one of the next key."""
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    after = df.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("other"))
    r = df.join(after, "c_custkey").select("c_custkey", T.identity(F.col("c_name"), F.col("other")).alias("i"))
    return rounded(r.select("c_custkey", "i.mismatches", "i.percent"), "percent")


SQL["sequence_identity"] = """
WITH p AS (SELECT a.c_custkey, a.c_name AS x, b.c_name AS y FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1),
s AS (SELECT c_custkey, length(x) AS n, length(x) = length(y) AS same, list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN x[k] = y[k] THEN 1 ELSE 0 END))::INTEGER AS m FROM p)
SELECT c_custkey, CASE WHEN same THEN (n - m)::INTEGER END AS mismatches, CASE WHEN same THEN round(100.0 * m / n, 6) + 0.0 END::DOUBLE AS percent FROM s"""


def name_prefixes(spark, d):
    """Brands with and without a prefix, sizes as powers of two and as boxes of one or three numbers."""
    df = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    box = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", size, F.lit("2.5,"), size)).otherwise(F.concat_ws(" ", size, size))
    full = T.with_prefix(F.col("p_brand"), "FF")
    return df.select("p_partkey", full.alias("full"), T.without_prefix(full).alias("short"), N.binary_exponent(F.col("p_size")).alias("exponent"), F.least("p_size", F.lit(5)).alias("capped"), T.box_numbers(box).alias("box"))


SQL["name_prefixes"] = """
SELECT p_partkey, 'FF.' || p_brand AS full, p_brand AS short, CASE WHEN p_size > 0 AND p_size & (p_size - 1) = 0 THEN length(bin(p_size)) - 1 END::INTEGER AS exponent, least(p_size, 5) AS capped,
  CASE p_partkey % 3 WHEN 0 THEN [p_size, p_size, p_size]::DOUBLE[] WHEN 1 THEN [p_size, 2.5, p_size]::DOUBLE[] END AS box FROM part"""


def general_format(spark, d):
    """Values as C's %g writes them, by way of text and back."""
    df = table(spark, d, "events").select("event_id", T.general(F.col("value")).alias("g"))
    return df.withColumn("back", T.number(F.col("g")))


SQL["general_format"] = "SELECT event_id, printf('%g', value) AS g, CAST(printf('%g', value) AS DOUBLE) AS back FROM events"


def minimum_image(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(df.select(*KEY, P.minimum_image(F.col("l_extendedprice") / 1000, 12.5).alias("d")), "d")


SQL["minimum_image"] = f"SELECT {_KEYS}, round(l_extendedprice / 1000 - 12.5 * round_even(l_extendedprice / 1000 / 12.5, 0), 6) + 0.0 AS d FROM lineitem"


def apportion(spark, d):
    """1000 places given to each brand's parts by their size; every seventh part has 3 fixed."""
    df = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("w"), F.when(F.col("p_partkey") % 7 == 0, 3).alias("fixed"))
    return P.apportioned(df, 1000.0, "w", "fixed", ["p_brand"]).select("p_partkey", "count")


SQL["apportion"] = """
WITH p AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS w, CASE WHEN p_partkey % 7 = 0 THEN 3 ELSE 0 END AS fixed FROM part)
SELECT p_partkey, CASE WHEN fixed > 0 THEN fixed ELSE floor(greatest(0, 1000.0 - sum(fixed) OVER b) * ((CASE WHEN fixed = 0 THEN w ELSE 0 END) / sum(CASE WHEN fixed = 0 THEN w ELSE 0 END) OVER b)) END::BIGINT AS count
FROM p WINDOW b AS (PARTITION BY p_brand)"""


def _points(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"))


def lattice_occupancy(spark, d):
    return P.occupied(_points(spark, d), ["x", "y"], [110.0, 50.0], [110, 50])


SQL["lattice_occupancy"] = """
SELECT (floor(l_extendedprice / 1000 / 110.0 * 110)::BIGINT % 110)::INTEGER AS c0, (floor(l_quantity / 50.0 * 50)::BIGINT % 50)::INTEGER AS c1, count(*) AS n FROM lineitem GROUP BY 1, 2"""


def lattice_free(spark, d):
    """Cells that no item lies in or next to."""
    return P.free_cells(spark, P.occupied(_points(spark, d), ["x", "y"], [110.0, 50.0], [110, 50], reach=1.0), [110, 50])


SQL["lattice_free"] = """
WITH o AS (SELECT DISTINCT floor(l_extendedprice / 1000 / 110.0 * 110)::BIGINT % 110 AS a, floor(l_quantity / 50.0 * 50)::BIGINT % 50 AS b FROM lineitem),
s AS (SELECT DISTINCT (a + da + 110) % 110 AS a, (b + db + 50) % 50 AS b FROM o, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(da, db))
SELECT x::INTEGER AS c0, y::INTEGER AS c1 FROM generate_series(0, 109) AS g(x), generate_series(0, 49) AS h(y) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.a = x AND s.b = y)"""


def affine_map(spark, d):
    df = P.moved(events(spark, d).select("event_id", "x", "y"), "x", "y", [("rotate", 30.0, 0.0), ("translate", 5.0, -2.0), ("scale", 0.5, 2.0)])
    return rounded(df, "x", "y", digits=5)


SQL["affine_map"] = EVENTS_SQL + "SELECT event_id, round((x * cos(radians(30)) - y * sin(radians(30)) + 5) * 0.5, 5) + 0.0 AS x, round((x * sin(radians(30)) + y * cos(radians(30)) - 2) * 2, 5) + 0.0 AS y FROM e"


def contact_energy(spark, d):
    """Energy of close events of each type, taken as points in space."""
    a = events(spark, d).select("event_type", "event_id", (F.col("x") / 24).alias("x"), (F.col("y") / 10).alias("y"), F.col("user_id").cast("double").alias("z"))
    pairs = J.neighbours(a, ["x", "y", "z"], 2.0, ["event_id"], ["event_type"]).filter("distance > 0.5")
    return rounded(pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(P.pair_energy(0.9, 0.8, F.col("distance"))).alias("energy")), "energy", digits=4)


SQL["contact_energy"] = (
    EVENTS_SQL
    + """, p AS (SELECT event_type, event_id, x / 24 AS x, y / 10 AS y, user_id::DOUBLE AS z FROM e),
q AS (SELECT a.event_type, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS r FROM p a JOIN p b ON a.event_type = b.event_type AND a.event_id < b.event_id AND abs(a.z - b.z) < 2)
SELECT event_type, count(*) AS n, round(sum(4 * 0.8 * ((0.9 / r) ** 12 - (0.9 / r) ** 6)), 4) + 0.0 AS energy FROM q WHERE r < 2 AND r > 0.5 GROUP BY 1"""
)

def superposed_rmsd(spark, d):
    """Each day's mean place of every user, superposed on the means of all days."""
    df = events(spark, d).withColumn("day", F.floor(F.col("x") / 24)).withColumn("h", F.col("x") % 24)
    place = lambda *by: df.groupBy(*by, "user_id").agg(F.avg("h").alias("x"), (F.avg("y") / 10).alias("y"), F.count(F.lit(1)).cast("double").alias("z"))
    return rounded(P.superposed_rmsd(place("day"), place(), ["day"], "user_id"), "rmsd")


for _f in (
    superposed_rmsd, expr_special_closed, expr_special, expr_special_orders, expr_lgamma, julian_day, date_parse_formats, json_props, map_default, composition_specs, sequence_identity, name_prefixes, general_format, minimum_image, apportion, lattice_occupancy,
    lattice_free, affine_map, contact_energy,
):
    QUERIES[_f.__name__] = _f
