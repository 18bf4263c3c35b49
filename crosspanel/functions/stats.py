"""Distribution functions as column expressions, each with the same formula as SQL text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosspanel.functions.expr import col

# fixed values: coefficients of published rational approximations, highest power first. Normal distribution function after West (2005),
# normal quantile after Acklam (2003), which one Newton-like step on the distribution function then brings to full precision
CDF_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
CDF_TAIL_FROM, SQRT_TWO_PI = 7.07106781186547, 2.506628274631
PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
PPF_TAIL = 0.02425


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _bound(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def normal_cdf(z) -> Column:
    return _bound(col(z), _cdf)


def _cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    tail = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / SQRT_TWO_PI
    below = F.when(a < CDF_TAIL_FROM, e * _polynomial(a, CDF_TOP) / _polynomial(a, CDF_BOTTOM)).otherwise(tail)
    return F.when(z > 0, 1 - below).when(z.isNotNull(), below)


def normal_ppf(p) -> Column:
    """Inverse of the normal distribution function; NULL outside (0, 1)."""
    return _bound(col(p), _ppf)


def _ppf(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    middle = _polynomial(r, PPF_A) * q / _polynomial(r, PPF_B)
    side = lambda x: _polynomial(F.sqrt(-2 * F.ln(x)), PPF_C) / _polynomial(F.sqrt(-2 * F.ln(x)), PPF_D)
    x = F.when(p < PPF_TAIL, side(p)).when(p > 1 - PPF_TAIL, -side(1 - p)).otherwise(middle)

    def halley(x):
        step = (_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return x - step / (1 + x * step / 2)

    return F.when((p > 0) & (p < 1), _bound(x, halley))


def t_cdf(t, df) -> Column:
    """Student's distribution function with a whole number of degrees of freedom, by its finite sum."""
    t, n = col(t), col(df).cast("long")
    theta = F.atan(t / F.sqrt(n.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    odd = n % 2 == 1
    last = F.floor((n - F.when(odd, 3).otherwise(2)) / 2)
    step = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
    series = F.aggregate(
        F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct((s["term"] * step(k) * c2).alias("term"), (s["sum"] + s["term"] * step(k) * c2).alias("sum")), lambda s: s["sum"])
    two_sided = F.when(n == 1, theta * 2 / math.pi).when(odd, (theta + F.sin(theta) * F.cos(theta) * series) * 2 / math.pi).otherwise(F.sin(theta) * series)
    return F.when(t.isNotNull() & (n >= 1), 0.5 + two_sided / 2)


# -- the same in SQL ---------------------------------------------------------------------


def _polynomial_sql(x: str, coefficients: list[float]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_cdf_sql(z: str) -> str:
    """``z`` should be a column name: it is repeated often."""
    a, e = f"abs({z})", f"exp(-{z} * {z} / 2)"
    tail = f"{e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / {SQRT_TWO_PI}::DOUBLE"
    below = f"CASE WHEN {a} < {CDF_TAIL_FROM} THEN {e} * {_polynomial_sql(a, CDF_TOP)} / {_polynomial_sql(a, CDF_BOTTOM)} ELSE {tail} END"
    return f"CASE WHEN {z} > 0 THEN 1 - {below} WHEN {z} IS NOT NULL THEN {below} END"


def normal_ppf_start_sql(p: str) -> str:
    """The rational start of the quantile; ``normal_ppf_step_sql`` makes it exact."""
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    side = lambda x: f"{_polynomial_sql(f'sqrt(-2 * ln({x}))', PPF_C)} / {_polynomial_sql(f'sqrt(-2 * ln({x}))', PPF_D)}"
    return (f"CASE WHEN {p} < {PPF_TAIL} THEN {side(p)} WHEN {p} > {1 - PPF_TAIL} THEN -({side(f'(1 - {p})')}) "
            f"ELSE {_polynomial_sql(r, PPF_A)} * ({p} - 0.5) / {_polynomial_sql(r, PPF_B)} END")


def normal_ppf_step_sql(x: str, p: str) -> str:
    step = f"((({normal_cdf_sql(x)}) - {p}) * sqrt(2 * pi()) * exp({x} * {x} / 2))"
    return f"({x} - {step} / (1 + {x} * {step} / 2))"


def t_cdf_sql(t: str, df: str) -> str:
    """The terms of the finite sum through the gamma function."""
    theta = f"atan({t} / sqrt({df}))"
    even = f"list_sum(list_transform(range(({df} - 2) // 2 + 1), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - 0.5 * ln(pi()) + 2 * k * ln(cos({theta})))))"
    odd = f"list_sum(list_transform(range(({df} - 3) // 2 + 1), lambda k: exp(0.5 * ln(pi()) - ln(2.0) + lgamma(k + 1.0) - lgamma(k + 1.5) + 2 * k * ln(cos({theta})))))"
    return (f"0.5 + (CASE WHEN {df} = 1 THEN {theta} * 2 / pi() WHEN {df} % 2 = 1 THEN ({theta} + sin({theta}) * cos({theta}) * {odd}) * 2 / pi() "
            f"ELSE sin({theta}) * {even} END) / 2")
