"""Functions against identities, tabulated values and the standard library."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import dates as D
from strandlake.functions import numeric as N
from strandlake.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*values):
    return [F.lit(float(v)) for v in values]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: N.erf(*lit(0.5)), 0.5204998778130465),
        (lambda: N.gamma(*lit(4.5)), 11.631728396567448),
        (lambda: N.log_gamma(*lit(10.0)), math.log(362880)),
        (lambda: N.gamma_lower(*lit(2.0, 1.0)), 1 - 2 / math.e),
        (lambda: N.gamma_lower(*lit(2.0, 30.0)), 1 - 31 * math.exp(-30)),
        (lambda: N.gamma_upper_inverse(*lit(1.0, 0.25)), math.log(4)),
        (lambda: N.chi2_cdf(*lit(2.0, 3.0)), 1 - math.exp(-1.5)),
        (lambda: N.poisson_cdf(*lit(2.0, 1.0)), 2.5 / math.e),
        (lambda: N.gamma_cdf(*lit(2.0, 1.0, 0.5)), 1 - math.exp(-1)),
        (lambda: N.beta_incomplete(*lit(2.0, 3.0, 0.4)), 0.5248),
        (lambda: N.beta_inverse(*lit(2.0, 3.0, 0.5248)), 0.4),
        (lambda: N.f_cdf(*lit(2.0, 4.0, 3.0)), 1 - (1 + 1.5) ** -2),
        (lambda: N.student_cdf(*lit(1.0, 1.0)), 0.75),
        (lambda: N.student_cdf(*lit(1.0, -1.0)), 0.25),
        (lambda: N.normal_cdf(*lit(1.0)), 0.8413447460685429),
        (lambda: N.normal_quantile(*lit(0.975)), 1.959963984540054),
        (lambda: N.ellipse_k(*lit(0.5)), 1.8540746773013719),
        (lambda: N.ellipse_e(*lit(0.5)), 1.3506438810476755),
        (lambda: N.ellipse_f(*lit(0.5, 0.0)), 0.5),
        (lambda: N.fresnel_s(*lit(1.0)), 0.4382591473903548),
        (lambda: N.fresnel_c(*lit(1.0)), 0.7798934003768228),
        (lambda: N.sine_integral(*lit(1.0)), 0.9460830703671830),
        (lambda: N.dawson(*lit(1.0)), 0.5380795069127684),
        (lambda: N.dilogarithm(*lit(2.0)), -math.pi**2 / 12),
        (lambda: N.digamma(*lit(1.0)), -0.5772156649015329),
        (lambda: N.zeta(*lit(2.0, 1.0)), math.pi**2 / 6),
        (lambda: N.voigt(0.5, 1e-6, F.lit(1.0)), 0.5 / math.pi / 1.25),
    ],
)
def test_special_functions(spark, make, want):
    assert value(spark, make()) == pytest.approx(want, rel=2e-6, abs=1e-9)


def test_nulls_stay_null(spark):
    assert value(spark, N.erf(F.lit(None).cast("double"))) is None
    assert value(spark, N.beta_incomplete(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5))) is None


def test_strict_arithmetic(spark):
    for bad in (N.divided(*lit(1, 0)), N.remainder(*lit(1, 0)), N.power(*lit(-2, 0.5)), N.power(*lit(0, -1))):
        with pytest.raises(Exception, match="zero|domain"):
            value(spark, bad)
    assert value(spark, N.divided(*lit(1, 0), strict=False)) is None and value(spark, N.power(*lit(-2, 0.5), strict=False)) is None
    assert value(spark, N.remainder(*lit(-7, 3))) == -1.0 and value(spark, N.choose(F.lit(-0.5), F.lit(1), F.lit(2))) == 1


def test_calendars(spark):
    jd = lambda *v: value(spark, D.julian_day_of(*(F.lit(x) for x in v)))
    assert jd(2000, 1, 1) == 2451545.0 and jd(1970, 1, 1, 0) == D.UNIX_EPOCH_JD
    assert jd(1582, 10, 15) - jd(1582, 10, 4) == 1.0 and jd(-4712, 1, 1) + 0 == jd(-4712, 1, 1)
    for day in ((2024, 2, 29), (1582, 10, 15), (1582, 10, 4), (1000, 3, 1), (1, 1, 1), (-1, 12, 31), (1900, 2, 28)):
        got = value(spark, D.calendar_of(F.lit(jd(*day))))
        assert (got["year"], got["month"], got["day"]) == day
    assert value(spark, D.day_of_week(F.lit(2451545.0))) == 6
    assert value(spark, D.full_year(F.lit(49))) == 2049 and value(spark, D.full_year(F.lit(50))) == 1950 and value(spark, D.full_year(F.lit(1234))) == 1234


@pytest.mark.parametrize("text, want", [("2000-01-01 12:00:00", 2451545.0), ("1.1.2000 12:00", 2451545.0), (" 1/2/2000 ", 2451545.5), ("2000-1-1", 2451544.5), ("nothing", None), ("", None), (None, None)])
def test_parsed_dates(spark, text, want):
    assert value(spark, D.parsed_date(F.lit(text))) == want


@pytest.mark.parametrize("v", [0.0, 1.0, 100.0, -2.5, 123456.0, 1234567.0, 0.0001, 0.00001234, 1e300, -1e-300, 3.14159265, 999999.5, float("inf"), float("nan")])
def test_general_format(spark, v):
    assert value(spark, T.general(F.lit(v))) == "%g" % v


def test_text_functions(spark):
    assert [value(spark, T.number(F.lit(s))) for s in ("1.5D3", " 2d-1 ", "7", "x", "")] == [1500.0, 0.2, 7.0, None, None]
    assert [value(spark, T.amino_acid(F.lit(s))) for s in ("arg", "R", " his ", "zz", None)] == ["R", "R", "H", None, None]
    assert tuple(value(spark, T.identity(F.lit("ABCD"), F.lit("ABXD")))) == (1, 75.0) and value(spark, T.identity(F.lit("A"), F.lit("AB"))) is None
    assert tuple(value(spark, T.identity(F.lit(""), F.lit("")))) == (0, 100.0)
    assert value(spark, T.int_list(F.lit("[3, 1, 2]"))) == [3, 1, 2] and value(spark, T.int_list(F.lit("[]"))) == []
    assert [tuple(value(spark, T.composition(F.lit(s)))) for s in ("POPC", "POPE=12", "CHOL:0.5")] == [("POPC", 0, 1.0), ("POPE", 12, 0.0), ("CHOL", 0, 0.5)]
    assert value(spark, T.mutation_label(F.lit("R"), F.lit(376), F.lit("H"))) == "R376H"


def test_years_of_two_digits(spark):
    from strandlake.functions import dates as D

    df = spark.createDataFrame([("5.3.97",), ("5.3.1997",), ("3/5/49 12:00",), ("3/5/50",), ("5.3.7",)], "t string")
    got = [r.y for r in df.select(D.calendar_of(D.parsed_date(F.col("t")))["year"].alias("y")).collect()]
    assert got == [1997, 1997, 2049, 1950, None]
