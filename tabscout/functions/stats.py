"""Statistical expressions built from Spark SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least number of terms of the incomplete-gamma expansions. They are evaluated on
# measurement tables (one row per feature), never on data rows.
_TERMS = 300


def guarded_corr(covariance: Column, sd_x: Column, sd_y: Column) -> Column:
    """Pearson r from population moments; NULL for a constant side, within [-1, 1]."""
    r = F.try_divide(covariance, sd_x * sd_y)
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def xlogx(n: Column) -> Column:
    """``n ln n`` with the limit 0 at n = 0."""
    return F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0)


def entropy_from_sum(total: Column, sum_xlogx: Column) -> Column:
    """Entropy in nats of counts with the given total and ``sum(n ln n)``."""
    return F.when(total > 0, F.log(total.cast("double")) - sum_xlogx / total)


def log_gamma_half(dof: Column) -> Column:
    """``ln Gamma(dof / 2)`` for a whole number of degrees of freedom."""
    d = dof.cast("int")
    even = F.aggregate(
        F.when(d > 2, F.sequence(F.lit(1), (d / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, i: acc + F.log(i.cast("double")),
    )
    odd = F.aggregate(
        F.when(d > 1, F.sequence(F.lit(1), ((d - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.5 * math.log(math.pi)),
        lambda acc, i: acc + F.log(i.cast("double") - 0.5),
    )
    return F.when(d % 2 == 0, even).otherwise(odd)


def chi2_sf(statistic: Column, dof: Column) -> Column:
    """Survival function of the chi-squared distribution, any whole dof >= 1.

    The regularised upper incomplete gamma function: a power series left of the
    mode, a continued fraction (evaluated from its tail) right of it.
    """
    a = dof.cast("double") / 2
    y = statistic / 2
    scale = F.exp(-y + a * F.log(y) - log_gamma_half(dof))
    # Both expansions need some eight times the root of ``a`` terms near their border.
    terms = (F.lit(_TERMS) + 10 * F.sqrt(dof.cast("double"))).cast("int")
    series = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct((1 / a).alias("term"), (1 / a).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * y / (a + i)).alias("term"),
            (acc["total"] + acc["term"] * y / (a + i)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(
        F.sequence(terms, F.lit(1), F.lit(-1)),
        y + (2 * terms + 1) - a,
        lambda acc, i: (y + 2 * i - 1 - a) - i * (i - a) / acc,
    )
    return (
        F.when(statistic.isNull() | dof.isNull() | (dof < 1), F.lit(None).cast("double"))
        .when(statistic <= 0, 1.0)
        .when(y < a + 1, 1 - scale * series)
        .otherwise(F.try_divide(scale, fraction))
    )


def unbiased_skewness(population_skewness: Column, n: Column) -> Column:
    """Sample skewness G1 from the population value g1; NULL below three rows."""
    count = n.cast("double")
    return F.when(n > 2, population_skewness * F.sqrt(count * (count - 1)) / (count - 2))


def yates_gap(gap: Column) -> Column:
    """Continuity correction: the gap shrinks by a half, not below zero."""
    return gap - F.least(F.lit(0.5), gap)
