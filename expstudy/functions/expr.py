"""Column-expression helpers that keep work inside Spark's code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")
# Fixed value: a count this near a whole number (relative above 1) counts as whole.
WHOLE = 1e-9


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Clamp to ``[lo, hi]`` and keep NULL as NULL.

    ``greatest``/``least`` skip NULL arguments, which would turn a missing value
    into a bound; a CASE keeps it missing, as R's ``pmax``/``pmin`` do.
    """
    x = col_of(c)
    expr = None
    if lo is not None:
        expr = F.when(x < F.lit(lo), F.lit(lo))
    if hi is not None:
        expr = (expr.when(x > F.lit(hi), F.lit(hi)) if expr is not None
                else F.when(x > F.lit(hi), F.lit(hi)))
    return x if expr is None else expr.otherwise(x)


def safe_div(num, den) -> Column:
    """``num / den`` with NULL instead of an error when the denominator is 0."""
    d = col_of(den)
    return col_of(num) / F.when(d != 0, d)


def log_factorial(c) -> Column:
    """``ln(y!)`` for a non-negative whole number ``y`` (as double).

    Exact through ``factorial`` up to 20 (``factorial(21)`` overflows to NULL);
    above that the Stirling series with three correction terms, accurate to
    far below 1e-10 for y > 20.
    """
    y = col_of(c).cast("double")
    small = F.log(F.factorial(F.least(y, F.lit(20.0)).cast("int")).cast("double"))
    big = (y * F.log(y) - y + 0.5 * F.log(F.lit(2.0 * math.pi) * y)
           + 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, 3)) + 1.0 / (1260.0 * F.pow(y, 5)))
    return F.when(y <= 20, small).otherwise(big)


def poisson_logpmf(y, mu) -> Column:
    """``log P(Y = y)`` for ``Y ~ Poisson(mu)``, following R's ``dpois(log=TRUE)``.

    mu < 0 -> NaN; y < 0 or fractional -> -Inf (rounding noise of up to ``WHOLE`` is
    taken for the whole number, as sums of doubles have it); mu = 0 -> 0 when y = 0 else -Inf;
    y = 0 -> -mu; otherwise ``y ln mu - mu - ln y!``.  Never takes ``ln(0)``.
    """
    given = col_of(y).cast("double")
    yc = F.round(given)
    m = col_of(mu).cast("double")
    return (
        F.when(yc.isNull() | m.isNull(), F.lit(None).cast("double"))
        .when(m < 0, F.lit(float("nan")))
        .when((yc < 0) | (F.abs(given - yc) > WHOLE * F.greatest(F.lit(1.0), yc)), F.lit(NEG_INF))
        .when(m == 0, F.when(yc == 0, F.lit(0.0)).otherwise(F.lit(NEG_INF)))
        .when(yc == 0, -m)
        .otherwise(yc * F.log(m) - m - log_factorial(yc))
    )
