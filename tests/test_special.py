"""Special functions against tabulated values and identities."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import numeric as N
from strandlake.functions import special as S

CASES = [
    (S.bessel_j, (0.0, 1.0), 0.7651976865579666),
    (S.bessel_j, (3.0, 5.0), 0.3648312306136670),
    (S.bessel_i, (1.0, 1.0), 0.5651591039924851),
    (S.bessel_k, (0.0, 1.0), 0.4210244382407083),
    (S.bessel_j, (0.5, 2.0), math.sqrt(1 / math.pi) * math.sin(2)),
    (S.bessel_j, (1.0, -1.0), -0.4400505857449335),
    (S.bessel_j, (-0.5, 3.0), math.sqrt(2 / (3 * math.pi)) * math.cos(3)),
    (S.bessel_y, (0.0, 1.0), 0.08825696421567698),
    (S.bessel_y, (1.0, 2.0), -0.10703243154093755),
    (S.bessel_i, (0.5, 1.0), math.sqrt(2 / math.pi) * math.sinh(1)),
    (S.bessel_k, (0.5, 1.0), math.sqrt(math.pi / 2) / math.e),
    (S.bessel_k, (0.0, 1e-4), 9.326272101),
    (S.bessel_i0_scaled, (10.0,), 0.12783333716342863),
    (S.bessel_i1_scaled, (-10.0,), -0.12126268138445551),
    (S.bessel_k0_scaled, (1.0,), 1.1444630798068949),
    (S.bessel_k1_scaled, (1.0,), 1.636153486263258),
    (S.airy_ai, (1.0,), 0.13529241631288141),
    (S.airy_ai, (-2.0,), 0.22740742820168557),
    (S.airy_ai, (0.0,), 0.3550280538878172),
    (S.airy_bi, (1.0,), 1.2074235949528713),
    (S.airy_bi, (-2.0,), -0.41230258795639848),
    (S.struve, (0.0, 1.0), 0.5686566270482879),
    (S.struve, (0.5, 20.0), math.sqrt(2 / (20 * math.pi)) * (1 - math.cos(20))),
    (S.confluent, (1.0, 2.0, 1.0), math.e - 1),
    (S.confluent, (1.0, 1.0, -30.0), math.exp(-30)),
    (S.hypergeometric, (1.0, 1.0, 2.0, 0.5), 2 * math.log(2)),
    (S.hypergeometric, (1.0, 1.0, 2.0, -3.0), math.log(4) / 3),
    (S.hypergeometric, (0.5, 0.3, 0.5, 0.95), 0.05**-0.3),
    (S.hypergeometric, (0.5, 0.5, 2.0, 1.0), 4 / math.pi),
    (S.exponential_integral, (1.0, 1.0), 0.21938393439552029),
    (S.exponential_integral, (2.0, 0.0), 1.0),
    (S.exponential_integral, (0.0, 2.0), math.exp(-2) / 2),
    (S.cosine_integral, (1.0,), 0.3374039229009681),
    (S.hyperbolic_cosine_integral, (1.0,), 0.8378669409802082),
    (S.hyperbolic_sine_integral, (1.0,), 1.0572508753757286),
    (S.beta, (2.0, 3.0), 1 / 12),
    (S.beta, (-0.5, 2.0), -4.0),
    (S.reciprocal_gamma, (-2.0,), 0.0),
    (S.factorial, (5.0,), 120.0),
    (S.zeta_less_one, (2.0,), math.pi**2 / 6 - 1),
    (S.zeta_less_one, (0.0,), -1.5),
    (S.gamma_tail, (1.0, 2.0, 0.5), 1.5 * math.exp(-0.5)),
    (S.chi2_upper, (2.0, math.exp(-1.5)), 3.0),
    (S.poisson_mean, (2.0, 2.5 / math.e), 1.0),
    (S.f_upper, (2.0, 4.0, (1 + 1.5) ** -2), 3.0),
    (S.student_quantile, (1.0, 0.75), 1.0),
    (S.student_quantile, (1.0, 0.25), -1.0),
]

# Far arguments and small tails: closed forms, and values of the functions' published tables.
WIDE = [
    (S.bessel_j, (0.0, 1000.0), 0.02478668615242880),
    *((S.bessel_j, (0.5, x), math.sqrt(2 / (math.pi * x)) * math.sin(x)) for x in (1e-3, 24.0, 26.0, 1e3, 1e5)),
    *((S.bessel_y, (0.5, x), -math.sqrt(2 / (math.pi * x)) * math.cos(x)) for x in (1e-3, 24.0, 26.0, 1e3, 1e5)),
    *((S.bessel_i0_scaled, (x,), 1 / math.sqrt(2 * math.pi * x) * (1 + 1 / (8 * x) + 9 / (128 * x * x) + 225 / (3072 * x**3))) for x in (1e4, 1e6)),
    *((S.bessel_k, (0.5, x), math.sqrt(math.pi / (2 * x)) * math.exp(-x)) for x in (1e-3, 10.0, 600.0)),
    (S.struve, (0.5, 1000.0), math.sqrt(2 / (1000 * math.pi)) * (1 - math.cos(1000))),
    (S.cosine_integral, (20.0,), 0.04441982084535331),
    (N.erfc, (26.0,), math.erfc(26)),
    (N.gamma, (171.5,), math.gamma(171.5)),
    (N.log_gamma, (1e6,), math.lgamma(1e6)),
    (N.gamma_lower, (1e6, 1e6), 0.5001329807608723),
    (N.gamma_lower, (1e4, 1e4), 0.5013298083399548),
    (N.gamma_lower, (1.0, 1e-300), 1e-300),
    (N.gamma_upper, (1.0, 690.0), math.exp(-690)),
    (N.chi2_tail, (2.0, 100.0), math.exp(-50)),
    (N.chi2_tail, (2.0, 1300.0), math.exp(-650)),
    (N.poisson_cdf, (2.0, 600.0), math.exp(-600) * (1 + 600 + 180000)),
    (N.gamma_upper_inverse, (20000.0, 0.5), 19999.66666765),
    (N.gamma_upper_inverse, (1.0, 1e-300), 300 * math.log(10)),
    (S.chi2_upper, (2.0, 1e-200), 400 * math.log(10)),
    (S.poisson_mean, (0.0, 1e-100), 100 * math.log(10)),
    (N.beta_incomplete, (1.0, 3.0, 1e-12), 3e-12),
    (N.beta_incomplete, (1e6, 1e6, 0.5), 0.5),
    (N.beta_inverse, (1.0, 1.0, 1e-100), 1e-100),
    (N.f_tail, (2.0, 4.0, 1e6), (1 + 0.5e6) ** -2),
    (S.f_upper, (2.0, 4.0, 1e-20), 2 * (1e10 - 1)),
    (N.student_cdf, (1.0, -1e8), 1 / (math.pi * 1e8)),
    (S.student_quantile, (1.0, 1e-10), -1 / (math.pi * 1e-10)),
    (N.normal_quantile, (0.5 * math.erfc(20 / math.sqrt(2)),), -20.0),
    (N.ellipse_k, (1 - 1e-10,), 0.5 * math.log(16 / 1e-10)),
    (N.ellipse_f, (1.0, 0.5), 1.0832167728451687),
    (N.ellipse_e_incomplete, (10 * math.pi, 0.5), 20 * 1.3506438810476755),
    (N.dawson, (1000.0,), 0.0005000002500003750),
    (N.sine_integral, (1e6,), math.pi / 2 - math.cos(1e6) / 1e6 - math.sin(1e6) / 1e12),
    (N.fresnel_c, (100.0,), 0.5 - 1 / (math.pi**2 * 1e6)),
    (N.digamma, (-0.5,), 0.03648997397857652),
]


def test_wide_arguments(spark):
    row = spark.range(1).select(*(f(*(F.lit(x) for x in args)).alias(f"c{k}") for k, (f, args, _) in enumerate(WIDE))).first()
    wrong = {(k, str(WIDE[k][1])): (row[f"c{k}"], want) for k, (_, _, want) in enumerate(WIDE) if row[f"c{k}"] != pytest.approx(want, rel=1e-7, abs=0)}
    assert not wrong


@pytest.mark.parametrize("order", [0.0, 3.3, 20.0, 50.0])
def test_cross_products(spark, order):
    """J, Y and I, K of neighbouring orders obey their cross products from 1e-3 to 1e6."""
    x = F.col("x")
    v, w = F.lit(order), F.lit(order + 1)
    df = spark.createDataFrame([(t,) for t in (1e-3, 0.1, 1.0, 14.0, 26.0, 100.0, 500.0, 1e3, 1e6)], "x double")
    rows = df.select(
        "x", ((S.bessel_j(w, x) * S.bessel_y(v, x) - S.bessel_j(v, x) * S.bessel_y(w, x)) * math.pi * x / 2).alias("a"),
        F.when(x <= 500, (S.bessel_i(v, x) * S.bessel_k(w, x) + S.bessel_i(w, x) * S.bessel_k(v, x)) * x).alias("b"),
    ).collect()
    for r in rows:
        assert r["a"] == pytest.approx(1, rel=1e-7) and (r["b"] is None or r["b"] == pytest.approx(1, rel=1e-7)), r


def test_special_values(spark):
    row = spark.range(1).select(*(f(*(F.lit(x) for x in args)).alias(f"c{k}") for k, (f, args, _) in enumerate(CASES))).first()
    wrong = {k: (row[f"c{k}"], want) for k, (_, _, want) in enumerate(CASES) if row[f"c{k}"] != pytest.approx(want, rel=2e-7, abs=1e-9)}
    assert not wrong


def test_outside_domains_and_nulls(spark):
    row = spark.range(1).select(
        S.bessel_y(F.lit(0.0), F.lit(0.0)).alias("pole"), S.bessel_j(F.lit(0.5), F.lit(-1.0)).alias("broken"), S.cosine_integral(F.lit(-1.0)).alias("left"),
        S.hypergeometric(*(F.lit(v) for v in (1.0, 1.0, 2.0, 1.5))).alias("beyond"), S.airy_ai(F.lit(None).cast("double")).alias("null"), S.random_whole(6, 1).alias("die"),
    ).first()
    assert row["pole"] == -math.inf and 0 <= row["die"] < 6
    assert all(row[c] is None for c in ("broken", "left", "beyond", "null"))
