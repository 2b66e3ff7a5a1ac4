"""Statistical kernels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-6
MAD_SCALE = 1.4826


def robust_z(value: Column, median: Column, mad: Column, std: Column) -> Column:
    """Distance from the median in scaled MADs, else in standard deviations, clipped to +-10; +-3 where neither spreads; 0 without data."""
    off = value - median
    clip = lambda z: F.greatest(F.least(z, F.lit(10.0)), F.lit(-10.0))
    flat = F.when(F.abs(off) < TINY, 0.0).otherwise(F.signum(off) * 3.0)
    scaled = F.when(MAD_SCALE * mad >= TINY, clip(F.try_divide(off, MAD_SCALE * mad))).when(std >= TINY, clip(F.try_divide(off, std))).otherwise(flat)
    return F.when(value.isNull() | median.isNull(), 0.0).otherwise(scaled)


def mean_percentile(below: Column, upto: Column, n: Column) -> Column:
    """The mean of the strict and weak percentile ranks, 0.5 without data."""
    return F.coalesce(F.least(F.greatest(F.try_divide(below + upto, 2.0 * n), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


#: Terms of the Poisson sum on either side: beyond 12 standard deviations and 60 terms nothing reaches double precision.
SPREAD, EXTRA = 12.0, 60.0


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series from x + 8 on."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    below = x
    for i in range(1, 8):
        below = below * (x + i)
    return series - F.log(below)


def poisson_cdf(k: Column, mu: Column) -> Column:
    """P(X <= k): terms from k down relative to the first, until they no longer count, scaled by the probability of k; from the
    mean up the sum starts at most ``SPREAD`` deviations below it.  The number of terms grows with the root of the mean, not with k."""
    top = F.least(k.cast("double"), F.floor(mu + SPREAD * F.sqrt(mu) + EXTRA))
    low = F.greatest(F.least(top, F.floor(mu)) - F.ceil(SPREAD * F.sqrt(mu) + EXTRA), F.lit(0.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    down = F.sequence(F.lit(0), F.greatest(top - low - 1, F.lit(0.0)).cast("int"))

    def add(acc: Column, i: Column) -> Column:
        term = F.when(top - i > low, acc["term"] * (top - i) / mu).otherwise(0.0)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ratio = F.aggregate(down, start, add, lambda acc: acc["sum"])
    first = F.exp(top * F.log(mu) - mu - log_gamma(top + 1))
    return F.when(mu > 0, F.least(first * ratio, F.lit(1.0))).otherwise(1.0)


def entropy_bits(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Shannon entropy in bits of the non-null values of each key."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__c"))
    total = counts.groupBy(*key).agg(F.sum("__c").alias("__n"), F.sum(F.col("__c") * F.log2("__c")).alias("__s"))
    return total.select(*key, F.greatest(F.log2("__n") - F.col("__s") / F.col("__n"), F.lit(0.0)).alias(name))


def gini(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Gini coefficient of non-negative values of each key; 0 where they add up to nothing."""
    order = Window.partitionBy(*key).orderBy(value)
    ranked = rows.where(F.col(value) >= 0).withColumn("__i", F.row_number().over(order))
    sums = ranked.groupBy(*key).agg(F.sum(F.col("__i") * F.col(value)).alias("__w"), F.sum(value).alias("__t"), F.count("*").alias("__n"))
    return sums.select(*key, F.coalesce(F.try_divide(2.0 * F.col("__w"), F.col("__n") * F.col("__t")) - (F.col("__n") + 1) / F.col("__n"), F.lit(0.0)).alias(name))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation of n pairs by Student's distribution with n - 2 degrees of freedom, null below three pairs.

    For whole degrees the distribution is a finite series, of about n / 2 terms, in the angle whose tangent is t / sqrt(n - 2)."""
    free = n.cast("int") - 2
    odd = free % 2
    angle = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.abs(rho))))  # t / sqrt(n - 2) is the tangent of this angle
    cos, sin = F.cos(angle), F.sin(angle)
    start = F.when(odd == 1, cos).otherwise(1.0)
    last = F.floor((free - 2 - odd) / 2).cast("int")

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (2 * j - 1 + odd) / (2 * j + odd) * cos * cos
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), F.struct(start.alias("term"), start.alias("sum")), add, lambda acc: acc["sum"])
    within = F.when(free == 1, 2 / math.pi * angle).when(odd == 1, 2 / math.pi * (angle + sin * series)).otherwise(sin * series)
    return F.when(free >= 1, F.greatest(F.lit(0.0), 1 - within))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rank correlation with average ranks for ties: one row (rho, n).  For tables of entities."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    return rows.select(rank(x).alias("rx"), rank(y).alias("ry")).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
