"""Numeric expressions that stay defined on empty, constant or tiny groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


# Digits after the point that sums of money keep of each value.
MONEY_DIGITS = 6


def total(value: Column) -> Column:
    """Sum that is 0 for a group with no values, and has the same bits in whatever order its rows
    are added: whole units and millionths are added up as integers. What a value has beyond six
    digits is rounded off (`checks.money_scale` counts such values); NaN counts as missing."""
    unit = 10 ** MONEY_DIGITS
    known = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    whole = F.floor(known)
    rest = F.round((known - whole) * float(unit)).cast("bigint")
    exact = (F.sum(whole).cast("decimal(20,0)") * F.lit(unit).cast("decimal(7,0)")
             + F.sum(rest).cast("decimal(20,0)"))
    return F.coalesce(exact.cast("double") / float(unit), F.lit(0.0))


def mean(value: Column) -> Column:
    """Mean of money from its `total`; null for a group with no values."""
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    return ratio(total(value), F.count_if(known))


def as_percent(rate: Column, digits: int = 1, twice: bool = False) -> Column:
    """Percentage of a 0-1 rate, rounded half-even.

    `twice` rounds the rate to two digits first, as some reports do; it loses
    the decimal of the percentage (0.248 becomes 25.0).
    """
    return F.bround((F.bround(rate, 2) if twice else rate) * 100, digits)


def pearson(x: str, y: str) -> Column:
    """Correlation over complete pairs; null when either side is constant."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0))


def log_gamma(z: Column) -> Column:
    """ln Gamma(z), z > 0: shift z up by ten, then Stirling's series."""
    shift = 10
    big = z + shift
    series = (1 / (12 * big) - 1 / (360 * F.pow(big, F.lit(3.0)))
              + 1 / (1260 * F.pow(big, F.lit(5.0))) - 1 / (1680 * F.pow(big, F.lit(7.0))))
    stirling = (big - 0.5) * F.ln(big) - big + 0.5 * F.ln(F.lit(2.0) * F.pi()) + series
    down = F.ln(z)
    for k in range(1, shift):
        down = down + F.ln(z + k)
    return stirling - down


def chi2_upper_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for a chi-square variable with `dof` degrees.

    One minus the lower incomplete gamma series. Its terms peak near
    x - a and fall off within about ten standard deviations, so the number
    of terms grows with the square root of the degrees of freedom. Absolute
    accuracy is about 1e-13.
    """
    a = dof / 2.0
    x = statistic / 2.0
    far = x > a + 10 * F.sqrt(a) + 40
    safe_x = F.when(far | (x <= 0), a).otherwise(x)
    n_terms = F.ceil(F.greatest(safe_x - a, F.lit(0.0)) + 10 * F.sqrt(F.greatest(a, safe_x)) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * safe_x / (a + n)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), n_terms.cast("int")), start, step,
                         lambda acc: acc["sum"])
    lower = F.exp(a * F.ln(safe_x) - safe_x - log_gamma(a + 1)) * series
    return (F.when(statistic.isNull(), None)
            .when((dof <= 0) | (x <= 0), 1.0)
            .when(far, 0.0)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - lower))))
