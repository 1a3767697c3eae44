"""p-values as column expressions (no Python in the tasks).

The two-sided tail of Student's t is the regularised incomplete beta function
I_x(df/2, 1/2) at x = df / (df + t^2). It is evaluated by its continued fraction (modified Lentz
steps in a fold over a fixed sequence) on the side where that converges fast, and
ln Gamma by the Stirling series after a shift of the argument.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, TINY, SHIFT = 300, 1e-300, 10
# B_2k / (2k (2k - 1)) of the Stirling series.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]


def ln_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    y = x + SHIFT
    shift = sum((F.log(x + k) for k in range(SHIFT)), F.lit(0.0))
    series = sum((F.lit(c) / F.pow(y, 2 * k + 1) for k, c in enumerate(STIRLING)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor((k + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        coef = F.when(k % 2 == 1, even).otherwise(odd)
        d = 1.0 / safe(1.0 + coef * s["d"])
        c = safe(1.0 + coef / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    # k = 1, 2, 3, 4, ... are the terms 2m and 2m + 1 for m = 1, 1, 2, 2, ...; the term of m = 0 is in the start
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["h"]


def beta_tail(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) for 0 < x < 1."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    return F.when(x < (a + 1.0) / (a + b + 2.0), front * _fraction(a, b, x) / a) \
        .otherwise(1.0 - front * _fraction(b, a, 1.0 - x) / b)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom; null where t is null or df is not positive."""
    t, df = t.cast("double"), df.cast("double")
    x = df / (df + t * t)
    p = F.when(t == 0, F.lit(1.0)).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(beta_tail(df / 2.0, F.lit(0.5), x))
    return F.when(t.isNotNull() & (df > 0), p)


def sql_t_two_sided(t: str, df: str, points: int = 2000) -> str:
    """The same in DuckDB: Simpson's rule on cos^(df-1), the density after t = sqrt(df) tan(angle)."""
    end = f"LEAST(atan(ABS({t}) / SQRT({df})), 12.0 / SQRT({df}))"
    value = f"pow(cos({end} * i / {points}), {df} - 1.0) * CASE WHEN i IN (0, {points}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    area = f"(SELECT SUM({value}) * {end} / {points} / 3.0 FROM range(0, {points + 1}) AS p(i))"
    scale = f"EXP(lgamma(({df} + 1.0) / 2.0) - lgamma({df} / 2.0)) / SQRT(pi())"
    return f"(CASE WHEN {t} IS NOT NULL AND {df} > 0 THEN GREATEST(0.0, 1.0 - 2.0 * {scale} * {area}) END)"
