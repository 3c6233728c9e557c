"""Column helpers with the panel's rules: missing is NULL (never NaN), zero denominators give NULL, frames count rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def null_nan(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or the result is not finite."""
    return null_nan(F.try_divide(a, b))


def by_pair() -> Window:
    return Window.partitionBy("pair").orderBy("open_time")


def at_time() -> Window:
    return Window.partitionBy("open_time")


def rolling(n: int, last: int = 0):
    """The n rows of a pair that end `last` rows before this one."""
    return by_pair().rowsBetween(-(n - 1) - last, -last)


def guarded(agg: Column, x: Column, n: int, last: int = 0) -> Column:
    """agg over a rolling frame, NULL unless x has n values there."""
    w = rolling(n, last)
    return F.when(F.count(x).over(w) == n, agg.over(w))


def log_ratio(a: Column, b: Column) -> Column:
    """Natural logarithm of a / b; NULL for ratios that are not positive."""
    r = safe_div(a, b)
    return F.when(r > 0, F.ln(r))


def pct_rank(x: Column, by: str = "open_time") -> Column:
    """Percent rank among the non-NULL values of the group, ties averaged; NULL stays NULL."""
    ties = F.count(x).over(Window.partitionBy(by, x))
    place = F.rank().over(Window.partitionBy(by).orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (place + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(by)))


def zscore(x: Column, by: str = "open_time") -> Column:
    """(x - mean) / sample deviation in the group; NULL for a constant group."""
    w = Window.partitionBy(by)
    return safe_div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


# Cody's rational Chebyshev approximations of the error function (1969), lowest order last but one.
ERF_SMALL = ([1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3], [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
ERF_MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
ERF_LARGE = ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4], [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])


def _ratio(of: tuple[list[float], list[float]], x: Column) -> Column:
    """The quotient of two polynomials given by their coefficients, highest order first."""
    up, down = (F.lit(c[0]) for c in of)
    for a, b in zip(of[0][1:], of[1][1:]):
        up, down = up * x + a, down * x + b
    return up / down


def erf(x: Column) -> Column:
    """The error function to about 1e-15, in plain arithmetic that stays in generated code; saturated from 6 on."""
    y, square = F.abs(x), x * x
    middle = 1.0 - F.exp(-square) * _ratio(ERF_MIDDLE, y)
    inverse = 1.0 / square
    large = 1.0 - F.exp(-square) / y * (1.0 / math.sqrt(math.pi) - inverse * _ratio(ERF_LARGE, inverse))
    beyond = F.when(y <= 4, middle).when(y < 6, large).otherwise(F.lit(1.0))
    return F.when(y <= 0.46875, x * _ratio(ERF_SMALL, square)).otherwise(F.signum(x) * beyond)


def varied(x: Column) -> Column:
    """Whether a group has two distinct values at least (aggregate expression; extremes instead of a set of values)."""
    return F.coalesce(F.min(x) < F.max(x), F.lit(False))


def pearson(x: str, y: str) -> Column:
    """Grouped Pearson correlation of complete pairs, NULL for a side without two distinct values (aggregate expression)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(varied(a) & varied(b), safe_div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def quantile_bucket(x: Column, edges: Column) -> Column:
    """The place (from 0) of x among right-closed buckets with the given rising edges; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < x)) - 1, F.lit(0)))
