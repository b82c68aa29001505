"""Fits to sets of points, from sums that Spark adds up: lines, transformed lines, polynomials, user formulas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import written

Names = Sequence[str]


def linear(df: DataFrame, by: Names, x: str, y: str) -> DataFrame:
    """Straight line with its quality: n, slope, intercept, r, rss, r2, f, se_slope, t_slope.

    Nulls in either column are left out. Of constant x all are null; of constant y slope is 0 and r null.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy")
    )
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    s = s.withColumn("r", F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))).withColumn("rss", rss)
    s = s.withColumn("r2", F.col("r") * F.col("r")).withColumn("_s2", F.when(F.col("n") > 2, F.col("rss") / (F.col("n") - 2)))
    s = s.withColumn("f", F.try_divide(F.col("slope") * F.col("_sxy"), F.col("_s2"))).withColumn("se_slope", F.sqrt(F.try_divide(F.col("_s2"), F.col("_sxx"))))
    return s.withColumn("t_slope", F.try_divide(F.col("slope"), F.col("se_slope"))).drop("_sxx", "_syy", "_sxy", "_s2")


def transformed(df: DataFrame, by: Names, x: str, y: str, kind: str) -> DataFrame:
    """Fit after a change of variables, a and b of: power y = a*x^b, exponential y = a*exp(b*x),
    logarithmic y = a + b*ln x, inverse 1/y = a + b*x. Rows that can't be transformed are left out."""
    u, v = {
        "power": (F.log(F.when(F.col(x) > 0, F.col(x))), F.log(F.when(F.col(y) > 0, F.col(y)))),
        "exponential": (F.col(x), F.log(F.when(F.col(y) > 0, F.col(y)))),
        "logarithmic": (F.log(F.when(F.col(x) > 0, F.col(x))), F.col(y)),
        "inverse": (F.col(x), F.try_divide(F.lit(1.0), F.col(y))),
    }[kind]
    rows = df.select(*by, u.alias("u"), v.alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", "u").alias("b"), F.regr_intercept("v", "u").alias("a"))
    return out.withColumn("a", F.exp("a")) if kind in ("power", "exponential") else out


def polynomial(df: DataFrame, by: Names, x: str, y: str, degree: int) -> DataFrame:
    """by, n, coefficients (array, constant first) of the least-squares polynomial in x.

    x is scaled to [-1, 1] per group first, so that the power sums stay well-conditioned; one
    small system per group is solved where its sums lie. Groups of no more than ``degree`` different points give null.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = both.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    scaled = both.join(ends, list(by)).withColumn("z", F.when(F.col("_hi") > F.col("_lo"), (2 * F.col("x") - F.col("_lo") - F.col("_hi")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0))
    sums = scaled.groupBy(*by, "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.pow("z", F.lit(k))) for k in range(2 * degree + 1))).alias("_z"), F.array(*(F.sum(F.col("y") * F.pow("z", F.lit(k))) for k in range(degree + 1))).alias("_y")
    )
    names = [*by, "n", "coefficients"]

    def solve(batches):
        for batch in batches:
            out = []
            for z, t, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("_z", "_y", "_lo", "_hi"))):
                m = np.array([[z[a + b] for b in range(degree + 1)] for a in range(degree + 1)])
                if hi <= lo and degree or np.linalg.matrix_rank(m) <= degree:
                    out.append(None)
                    continue
                c = np.polynomial.Polynomial(np.linalg.solve(m, t), domain=[lo, hi] if hi > lo else [lo - 1, lo + 1]).convert().coef
                out.append([*c, *[0.0] * (degree + 1 - len(c))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out, pa.list_(pa.float64()))], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by, "n").schema)
    return sums.mapInArrow(solve, f"{kinds}, coefficients array<double>")


def evaluated(x: Column, coefficients: Column) -> Column:
    """Value of a polynomial by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


def nonlinear(df: DataFrame, by: Names, x: str, y: str, formula: Callable[[Column, list[Column]], Column], start: Sequence[float], rounds: int = 12, step: float = 1e-6) -> DataFrame:
    """Parameters of ``formula(x, parameters)`` by damped least squares: by, parameters, rss.

    Each round adds up the normal equations of every group on Spark, derivatives taken by small
    steps, and solves one small system per group; a round that doesn't lower the rest of a group is
    taken back and its damping raised. Only sums are gathered, so groups may have any size.
    """
    p = len(start)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    state = both.select(*by).distinct().select(
        *by, F.array(*(F.lit(float(s)) for s in start)).alias("now"), F.array(*(F.lit(float(s)) for s in start)).alias("best"), F.lit(float("inf")).alias("rss"), F.lit(1e-3).alias("damping")
    )
    names = [*by, "now", "best", "rss", "damping"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*names).schema)

    def solve(batches):
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("now", "best", "rss", "damping", "_rss", "_h", "_g")}
            out = {c: [] for c in ("now", "best", "rss", "damping")}
            for now, best, rss, damping, new, h, g in zip(*rows.values()):
                if new is not None and new < rss:
                    best, rss, damping = now, new, damping / 5
                    m = np.zeros((p, p))
                    m[np.triu_indices(p)] = h
                    m = m + np.triu(m, 1).T
                    try:
                        now = [float(v) for v in np.array(best) + np.linalg.solve(m + damping * np.diag(np.maximum(np.diag(m), 1e-12)), g)]
                    except np.linalg.LinAlgError:
                        now = best
                else:
                    damping, now = damping * 10, [float(b + (n - b) / 10) for n, b in zip(now, best)]
                for c, v in zip(out, (now, best, rss, damping)):
                    out[c].append(v)
            made = [pa.array(out["now"], pa.list_(pa.float64())), pa.array(out["best"], pa.list_(pa.float64())), pa.array(out["rss"], pa.float64()), pa.array(out["damping"], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *made], names)

    for _ in range(rounds):
        at = lambda k, h=0.0: [F.col("now")[n] + (h * F.greatest(F.abs(F.col("now")[n]), F.lit(1.0)) if n == k else 0) for n in range(p)]
        rows = both.join(state, list(by))
        rows = rows.select(
            *by, "y", formula(F.col("x"), at(-1)).alias("_f"), *((formula(F.col("x"), at(k, step)) - formula(F.col("x"), at(k, -step))).alias(f"_s{k}") for k in range(p)), *(F.greatest(F.abs(F.col("now")[k]), F.lit(1.0)).alias(f"_w{k}") for k in range(p))
        )
        d = [F.col(f"_s{k}") / (2 * step * F.col(f"_w{k}")) for k in range(p)]
        r = F.col("y") - F.col("_f")
        sums = rows.groupBy(*by).agg(
            F.sum(r * r).alias("_rss"), F.array(*(F.sum(d[a] * d[b]) for a in range(p) for b in range(a, p))).alias("_h"), F.array(*(F.sum(d[a] * r) for a in range(p))).alias("_g")
        )
        state = written(state.join(sums, list(by)).mapInArrow(solve, kinds), "fit")
    return state.select(*by, F.col("best").alias("parameters"), "rss")
