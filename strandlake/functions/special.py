"""Special functions of any real order, integrals of exponentials and quantiles, as Columns.

Each is an integral, a series or an inverse that numpy evaluates for an Arrow batch at a
time. Nulls and NaN give null, as do arguments outside a function's domain; at a pole it is infinite.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.numeric import _beta_quantile, _circular_rests, _gamma, _gamma_quantile, _integral, _log_gamma, _series, _upper, _zero, batched

EULER = 0.5772156649015329
MOST_PIECES = 4096  #: of an oscillating integral; arguments that ask for more give null


def _reciprocal_gamma(x: np.ndarray) -> np.ndarray:
    return np.where((x <= 0) & (x == np.floor(x)), 0.0, 1 / _gamma(x))


def _far(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where exp(v t - x sinh t) has become negligible."""
    t = np.full_like(x, 5.0)
    for _ in range(30):
        t = np.arcsinh((50 + np.abs(v) * t) / x)
    return t


def _far_k(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where exp(v t - x (cosh t - 1)) has become negligible."""
    t = np.full_like(x, 5.0)
    for _ in range(40):
        t = np.arccosh(1 + (50 + np.abs(v) * t) / x)
    return t


def _turned(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sign by which a function of whole order v goes on to negative x; NaN for broken orders."""
    return np.where(x >= 0, 1.0, np.where(v == np.floor(v), np.where(v % 2 == 0, 1.0, -1.0), np.nan))


def _hankel(v: np.ndarray, x: np.ndarray, turning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the even and odd terms of the expansion in 1 / x, with alternating signs if ``turning``; each row stops at its least term."""
    term = even = np.ones_like(x)
    odd, open_ = _zero(x), np.ones(x.shape, dtype=bool)
    for k in range(1, 120):
        new = term * (4 * v * v - (2 * k - 1) ** 2) / (8 * k * x)
        open_ = open_ & (np.abs(new) < np.maximum(np.abs(term), 1e-300)) | (open_ & (np.abs(v) > k))
        term = np.where(open_, new, 0.0)
        sign = -1.0 if turning and k // 2 % 2 else 1.0
        if k % 2:
            odd = odd + sign * term
        else:
            even = even + sign * term
        if not (np.abs(term) > 1e-17).any():
            break
    return even, odd


def _is_far(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the expansion in 1 / x holds to double precision."""
    return x > np.maximum(25.0, v * v / 2)


def _pieces(v: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray]:
    """How many pieces the widest oscillation that isn't far needs, and which rows need too many."""
    need = np.where(_is_far(v, x) | np.isnan(v + x), 0.0, (np.abs(v) + x) / 80)
    return int(np.ceil(np.where(need > MOST_PIECES, 0.0, need).max(initial=0.0))) + 1, need > MOST_PIECES


def _rising(v: np.ndarray, x: np.ndarray, sign: float, scaled: bool = False) -> np.ndarray:
    """(x/2)^v / Gamma(v+1) times the power series of J (sign -1) or I (1), times exp(-x) if ``scaled``; for v > -1."""
    front = np.exp(v * np.log(x / 2) - _log_gamma(v + 1) - (x if scaled else 0.0))
    return front * _series(lambda k: sign / ((k + 1) * (v + k + 1)), x * x / 4)


def _j(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.maximum(np.abs(x), 1e-12)
    far, (pieces, wide) = _is_far(v, at), _pieces(v, at)
    slow = (v > -1) & (at * at / 4 < 8 * (v + 1))  # the power series hardly cancels
    near = np.where(far | wide, 1.0, at)
    ring = _integral(lambda t: np.cos(v[:, None] * t - near[:, None] * np.sin(t)), _zero(x), np.full_like(x, math.pi), pieces)
    rest = _integral(lambda t: np.exp(-near[:, None] * np.sinh(t) - v[:, None] * t), _zero(x), _far(v, near))
    out = (ring - np.where(v == np.floor(v), 0.0, np.sin(v * math.pi) * rest)) / math.pi
    out = np.where(slow, _rising(np.where(slow, v, 0.0), np.where(slow, at, 1.0), -1.0), np.where(wide, np.nan, out))
    even, odd = _hankel(v, np.where(far, at, 1e9), turning=True)
    phase = at - (v / 2 + 0.25) * math.pi
    out = np.where(far, np.sqrt(2 / (math.pi * at)) * (even * np.cos(phase) - odd * np.sin(phase)), out)
    return _turned(v, x) * np.where(np.abs(x) < 1e-12, np.where(v == 0, 1.0, np.where(v > 0, 0.0, out)), out)


def _y(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.maximum(np.abs(x), 1e-12)
    far, (pieces, wide) = _is_far(v, at), _pieces(v, at)
    near = np.where(far | wide, 1.0, at)
    ring = _integral(lambda t: np.sin(near[:, None] * np.sin(t) - v[:, None] * t), _zero(x), np.full_like(x, math.pi), pieces)
    rest = _integral(lambda t: (np.exp(v[:, None] * t - near[:, None] * np.sinh(t)) + np.cos(v * math.pi)[:, None] * np.exp(-v[:, None] * t - near[:, None] * np.sinh(t))), _zero(x), _far(v, near), 4)
    even, odd = _hankel(v, np.where(far, at, 1e9), turning=True)
    phase = at - (v / 2 + 0.25) * math.pi
    out = np.where(far, np.sqrt(2 / (math.pi * at)) * (even * np.sin(phase) + odd * np.cos(phase)), np.where(wide, np.nan, (ring - rest) / math.pi))
    return np.where(x > 0, out, np.where(x == 0, -np.inf, np.nan))


def _i(v: np.ndarray, x: np.ndarray, scaled: bool = False) -> np.ndarray:
    """By its power series, far out by the expansion in 1 / x; negative orders by way of K."""
    at = np.maximum(np.abs(x), 1e-12)
    order, far = np.abs(v), _is_far(v, np.abs(x))
    out = _rising(order, np.where(far, 1.0, at), 1.0, scaled)
    even, odd = _hankel(v, np.where(far, at, 1e9), turning=False)
    out = np.where(far, (even - odd) * np.exp(0.0 if scaled else at) / np.sqrt(2 * math.pi * at), out)
    broken = (v < 0) & (v != np.floor(v))
    if broken.any():
        out = out + np.where(broken, 2 / math.pi * np.sin(order * math.pi) * _k(order, at) * np.exp(-at if scaled else 0.0), 0.0)
    return _turned(v, x) * out


def _k(v: np.ndarray, x: np.ndarray, scaled: bool = False) -> np.ndarray:
    at = np.maximum(x, 1e-12)
    far = _is_far(v, at)
    near = np.where(far, 1.0, at)
    off = near[:, None] if scaled else 0.0
    out = _integral(lambda t: 0.5 * (np.exp(off - near[:, None] * np.cosh(t) + v[:, None] * t) + np.exp(off - near[:, None] * np.cosh(t) - v[:, None] * t)), _zero(x), _far_k(v, near), 4)
    even, odd = _hankel(v, np.where(far, at, 1e9), turning=False)
    out = np.where(far, np.sqrt(math.pi / (2 * at)) * np.exp(0.0 if scaled else -at) * (even + odd), out)
    return np.where(x > 0, out, np.where(x == 0, np.inf, np.nan))


def _airy(x: np.ndarray, second: bool) -> np.ndarray:
    """By Bessel functions of order 1/3 of 2/3 |x|^1.5."""
    at = np.maximum(np.abs(x), 1e-7)
    z, third = 2 / 3 * at**1.5, np.full_like(x, 1 / 3)
    if second:
        return np.where(x > 0, np.sqrt(at / 3) * (_i(-third, z) + _i(third, z)), np.sqrt(at / 3) * (_j(-third, z) - _j(third, z)))
    return np.where(x > 0, np.sqrt(at / 3) / math.pi * _k(third, z), np.sqrt(at) / 3 * (_j(third, z) + _j(-third, z)))


def _struve(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By its series up to 15, beyond as Y plus a Laplace integral."""
    half = np.minimum(np.abs(x), 15.0) / 2
    series = sum((-1) ** k * half ** (2 * k + 1 + v) * _reciprocal_gamma(np.full_like(v, k + 1.5)) * _reciprocal_gamma(k + v + 1.5) for k in range(60))
    at = np.maximum(np.abs(x), 15.0)
    end = (60 + 4 * np.abs(v)) / at
    rest = _integral(lambda t: np.exp(-at[:, None] * t + (v - 0.5)[:, None] * np.log1p(t * t)), _zero(x), end, 4)
    beyond = _y(v, at) + 2 * (at / 2) ** v * rest / math.sqrt(math.pi) * _reciprocal_gamma(v + 0.5)
    return _turned(v + 1, x) * np.where(np.abs(x) <= 15, series, beyond)


def _confluent(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For negative x by Kummer's transformation, so that no terms cancel."""
    first = np.where(x < 0, b - a, a)
    return np.where(x < 0, np.exp(x), 1.0) * _series(lambda n: (first + n) / ((b + n) * (n + 1)), np.abs(x), 4000)


def _gauss(a: np.ndarray, b: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Below 0 by Pfaff's transformation; towards 1 by the series about 1 unless c - a - b is whole."""
    low, b = np.where(x < 0, (1 - np.minimum(x, 0.0)) ** -a, 1.0), np.where(x < 0, c - b, b)
    x = np.where(x < 0, x / (x - 1), x)
    s = c - a - b
    near = (x > 0.9) & (np.abs(s - np.rint(s)) > 1e-9)
    about0 = _series(lambda n: (a + n) * (b + n) / ((c + n) * (n + 1)), np.where(near | (x >= 1), 0.0, x), 20000)
    y = np.where(near, np.maximum(1 - x, 0.0), 0.0)
    s_ = np.where(near, s, 0.5)
    one = _series(lambda n: (a + n) * (b + n) / ((1 - s_ + n) * (n + 1)), y, 4000) * _gamma(c) * _gamma(s_) * _reciprocal_gamma(c - a) * _reciprocal_gamma(c - b)
    two = _series(lambda n: (c - a + n) * (c - b + n) / ((1 + s_ + n) * (n + 1)), y, 4000) * _gamma(c) * _gamma(-s_) * _reciprocal_gamma(a) * _reciprocal_gamma(b)
    about1 = one + np.where(y > 0, two * np.maximum(y, 1e-300) ** s_, np.where(s_ > 0, 0.0, np.nan))
    exact = np.where(s > 0, _gamma(c) * _gamma(np.where(s > 0, s, 1.0)) * _reciprocal_gamma(c - a) * _reciprocal_gamma(c - b), np.inf)
    return low * np.where(x > 1, np.nan, np.where(x == 1, exact, np.where(near, about1, about0)))


def _expn(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The integral of exp(-x t) / t^n from 1, over w = ln t."""
    high = np.minimum(np.log1p(50 / np.maximum(x, 1e-300)), np.where(n > 1, 700 / np.maximum(n - 1, 1e-9), 700.0))
    whole = _integral(lambda w: np.exp(-x[:, None] * np.exp(w) + (1 - n)[:, None] * w), _zero(x), high)
    return np.where(x > 0, whole, np.where((x == 0) & (n > 1), 1 / (n - 1), np.where(x == 0, np.inf, np.nan)))


def _student_quantile(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    z, rest = _beta_quantile(v / 2, np.full_like(v, 0.5), 2 * np.minimum(p, 1 - p))
    return np.where(p < 0.5, -1.0, 1.0) * np.sqrt(v * rest / z)


def _f_upper(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    rest, w = _beta_quantile(b / 2, a / 2, p)
    return b * w / (a * rest)


def _whole_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By logarithms where both are positive, so that nothing overflows."""
    return np.where((a > 0) & (b > 0), np.exp(_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)), _gamma(a) * _gamma(b) * _reciprocal_gamma(a + b))


def _cosine_integral(x: np.ndarray) -> np.ndarray:
    f, g = _circular_rests(at := np.maximum(x, 10.0))
    near = np.clip(x, 1e-300, 10.0)
    close = EULER + np.log(near) + _integral(lambda t: -2 * np.sin(t / 2) ** 2 / t, _zero(x), near)
    return np.where(x > 0, np.where(x <= 10, close, f * np.sin(at) - g * np.cos(at)), np.nan)


bessel_j = batched(_j)
bessel_y = batched(_y)
bessel_i = batched(_i)
bessel_k = batched(_k)
bessel_i0_scaled = batched(lambda x: _i(_zero(x), x, scaled=True))
bessel_i1_scaled = batched(lambda x: _i(_zero(x) + 1, x, scaled=True))
bessel_k0_scaled = batched(lambda x: _k(_zero(x), x, scaled=True))
bessel_k1_scaled = batched(lambda x: _k(_zero(x) + 1, x, scaled=True))
airy_ai = batched(lambda x: _airy(x, second=False))
airy_bi = batched(lambda x: _airy(x, second=True))
struve = batched(_struve)
confluent = batched(_confluent)
hypergeometric = batched(_gauss)
exponential_integral = batched(_expn)
cosine_integral = batched(_cosine_integral)
hyperbolic_cosine_integral = batched(lambda x: np.where(x > 0, EULER + np.log(x) + _integral(lambda t: 2 * np.sinh(t / 2) ** 2 / t, _zero(x), x, 4), np.nan))
hyperbolic_sine_integral = batched(lambda x: _integral(lambda t: np.sinh(t) / t, _zero(x), x, 4))
beta = batched(_whole_beta)
reciprocal_gamma = batched(_reciprocal_gamma)
factorial = batched(lambda n: _gamma(n + 1))
zeta_less_one = batched(lambda s: sum((k + 2.0) ** -s for k in range(30)) + 32.0 ** (1 - s) / (s - 1) + 32.0**-s / 2 + s * 32.0 ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * 32.0 ** (-s - 3) / 720)
gamma_tail = batched(lambda a, b, x: _upper(b, a * x))
chi2_upper = batched(lambda v, p: 2 * _gamma_quantile(v / 2, p))  #: x beyond which p lies
poisson_mean = batched(lambda k, p: _gamma_quantile(np.floor(k) + 1, p))  #: mean at which k or fewer have the chance p
f_upper = batched(_f_upper)  #: x beyond which p lies
student_quantile = batched(_student_quantile)


def random_normal(mean: Column | float, deviation: Column | float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


def random_whole(n: Column | int, seed: int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(F.rand(seed) * n)
