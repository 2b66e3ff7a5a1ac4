"""Quantiles of a group without each of its members, from one cumulative histogram a group.

A group's values are counted once.  What a member's own values take from a rank follows from the member's counts alone: the item
of rank k among the others is the group's item of rank k plus the own counts at values that lie wholly before it.  So the work
is linear in the distinct values of groups and of members; there is no table of members and their peers.

Sums run in two levels, within a bucket of values and over a group's buckets, so that no group is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.sources.scratch import written

#: Width of a bucket of values; durations are in seconds.
HOUR = 3600.0


def cumulative(counts: DataFrame, group: list[str], width: float = HOUR) -> DataFrame:
    """Counts ``m`` of distinct values of a group, with the numbers of items ``below`` a value and ``upto`` it."""
    binned = counts.withColumn("bin", F.floor(F.col("value") / width))
    earlier = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*group, "bin").agg(F.sum("m").alias("__m")).select(*group, "bin", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = binned.join(bins.hint("merge"), [*group, "bin"]).withColumn("upto", F.col("__start") + F.sum("m").over(within))
    return out.withColumn("below", F.col("upto") - F.col("m")).drop("__start")


def at_ranks(histogram: DataFrame, ranks: DataFrame, group: list[str]) -> DataFrame:
    """``ranks`` (the group, ``rank`` from 0, anything else) with the ``value`` of that rank in the cumulative histogram:
    first its bucket is looked up, then the value within the bucket."""
    asked = ranks.select(*group, F.col("rank").alias("__at"), F.lit(1).alias("__side"), F.struct(*ranks.columns).alias("__row"))
    starts = histogram.groupBy(*group, F.col("bin").alias("__bin")).agg(F.min("below").alias("__at")).withColumn("__side", F.lit(0))
    order = lambda *more: Window.partitionBy(*group, *more).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    binned = asked.unionByName(starts, allowMissingColumns=True).withColumn("__bin", F.last("__bin", ignorenulls=True).over(order())).where("__row is not null")
    items = histogram.select(*group, F.col("bin").alias("__bin"), F.col("below").alias("__at"), F.lit(0).alias("__side"), F.col("value").alias("__value"))
    found = binned.unionByName(items, allowMissingColumns=True).withColumn("__value", F.last("__value", ignorenulls=True).over(order("__bin")))
    return found.where("__row is not null").select("__row.*", F.col("__value").alias("value"))


def place(histogram: DataFrame, own: DataFrame, group: list[str], who: str) -> DataFrame:
    """A member's counts (``who``, group, ``value``, ``m``, ``apart``, ``n``) with the numbers of items ``below`` and ``upto`` each value
    among those that remain: all ``n`` of the group where ``apart`` is false, else those of the others."""
    mine = cumulative(own, [*group, who]).withColumnsRenamed({"below": "__below", "upto": "__upto"})
    both = mine.join(histogram.select(*group, "bin", "value", "below", "upto").hint("merge"), [*group, "bin", "value"])
    less = lambda c: F.when(F.col("apart"), F.col(c)).otherwise(0)
    return both.select(who, *group, "value", "m", "apart", "n", less("m").alias("taken"), (F.col("below") - less("__below")).alias("below"), (F.col("upto") - less("__upto")).alias("upto"))


def quantiles(histogram: DataFrame, placed: DataFrame, group: list[str], who: str, shares: dict[str, float]) -> DataFrame:
    """Of each member and group with ``n`` > 0: ``n`` and the quantiles, interpolated between neighbours, of the items that remain."""
    names = list(shares)
    position = {s: F.lit(shares[s]) * (F.col("n") - 1) for s in names}
    ends = [(f"{s}_{side}", cut(position[s]).cast("long")) for s in names for side, cut in (("low", F.floor), ("high", F.ceil))]
    before = [F.coalesce(F.sum(F.when(F.col("upto") <= rank, F.col("taken"))), F.lit(0)).alias(name) for name, rank in ends]
    members = placed.where("n > 0").groupBy(who, *group, "n").agg(*before)
    asked = members.select(who, *group, "n", F.inline(F.array(*[F.struct(F.lit(name).alias("end"), (rank + F.col(name)).alias("rank")) for name, rank in ends])))
    found = at_ranks(histogram, asked, group).groupBy(who, *group, "n").agg(*[F.max(F.when(F.col("end") == name, F.col("value"))).alias(name) for name, _ in ends])

    def between(s: str) -> Column:
        low, high, at = F.col(f"{s}_low"), F.col(f"{s}_high"), position[s]
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(who, *group, "n", *[between(s).alias(s) for s in names])


def peers(counts: DataFrame, own: DataFrame, group: list[str], who: str, shares: dict[str, float], least: int) -> tuple[DataFrame, DataFrame]:
    """Members' values against the group, or against the others where at least ``least`` items of them remain.

    ``counts``: group, ``value``, ``m``; ``own``: ``who``, group, ``value``, ``m``, a part of them.  Members with fewer than ``least`` items are left
    out, as are small groups.  Returns the placed values (``below``, ``upto``, ``n``), and for each member ``n``, mean and standard
    deviation, the shares' quantiles, which must have a ``median``, and the median absolute deviation ``mad``.

    Deviations are counted once for each distinct median of a group: medians without one member differ by few ranks, so there are few.
    Histograms and placed values, which several steps read, are written."""
    spark = counts.sparkSession
    whole = written(spark, cumulative(counts, group), "histogram")
    counts = whole.select(*group, "value", "m")
    square = F.col("value") * F.col("value")
    sizes = counts.groupBy(*group).agg(F.sum("m").alias("__all"), F.sum(F.col("value") * F.col("m")).alias("__s1"), F.sum(square * F.col("m")).alias("__s2")).where(F.col("__all") >= least)
    mine = own.groupBy(who, *group).agg(F.sum("m").alias("__own"), F.sum(F.col("value") * F.col("m")).alias("__o1"), F.sum(square * F.col("m")).alias("__o2")).where(F.col("__own") >= least).join(sizes, group)
    mine = mine.withColumn("apart", F.col("__all") - F.col("__own") >= least)
    rest = lambda a, o: F.col(a) - F.when(F.col("apart"), F.col(o)).otherwise(0)
    mine = mine.select(who, *group, "apart", rest("__all", "__own").alias("n"), rest("__s1", "__o1").alias("s1"), rest("__s2", "__o2").alias("s2"))
    placed = written(spark, place(whole, own.hint("merge").join(mine.select(who, *group, "apart", "n"), [who, *group]), group, who), "placed")
    first = written(spark, quantiles(whole, placed, group, who, shares), "quantiles")
    centres = first.select(who, *group, "median")
    off = F.abs(F.col("value") - F.col("median"))
    around = [*group, "median"]
    apart = counts.join(centres.select(*around).distinct(), group).groupBy(*around, off.alias("value")).agg(F.sum("m").alias("m"))
    near = placed.hint("merge").join(centres, [who, *group]).groupBy(who, *around, off.alias("value"), "apart", "n").agg(F.sum("m").alias("m"))
    whole_off = written(spark, cumulative(apart, around), "deviations")
    second = quantiles(whole_off, place(whole_off, near, around, who), around, who, {"mad": 0.5}).select(who, *group, "mad")
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    stats = first.join(mine.select(who, *group, mean.alias("mean"), spread.alias("std")), [who, *group]).join(second, [who, *group])
    return placed, stats
