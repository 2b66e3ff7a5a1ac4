"""As-of and range joins by one sorted pass, without a table of pairs.

Both sides become one stream of events of a key, sorted by time.  A key's stream is cut into time buckets, so that a hot key
is spread over tasks: within a bucket a window carries the last value or the running sum forward, and what earlier buckets end
with, one row a key and bucket, is carried over by a window over those rows.  Every event is shuffled once.

Rows without a key or a time match nothing and stay, with nulls or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / (width * 1_000_000)).cast("long")


def _stream(points: DataFrame, by: list[str], at: str, width: int, side: int) -> DataFrame:
    """Points as events: their row, key, time and bucket."""
    t = _micros(at)
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    return points.select(F.struct(*points.columns).alias("__row"), *keys, t.alias("__t"), _bucket(t, width).alias("__b"), F.lit(side).alias("__side"))


def _carried(events: DataFrame, keys: list[str], ends: Column, forward) -> DataFrame:
    """For each key and bucket what the earlier buckets end with."""
    per = events.groupBy(*keys, "__b").agg(ends.alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "__b", forward(F.col("__end"), earlier).alias("__carried"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, when: str, values: list[str], width: int = DAY, strict: bool = False) -> DataFrame:
    """``left`` with ``when`` and ``values`` of the latest row of ``right`` of the same key whose time is at most ``left``'s (before it, if
    ``strict``); of several at one time, the one with the greatest values.  ``width``: seconds of a bucket."""
    keys = [f"__k{i}" for i in range(len(by))]
    t = _micros(when)
    known = right.where(" and ".join(f"{c} is not null" for c in [*by, when]))
    payload = F.struct(F.col(when), *[F.col(v) for v in values])
    seen = known.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], t.alias("__t"), _bucket(t, width).alias("__b"), F.lit(1 if strict else 0).alias("__side"), payload.alias("__seen"))
    events = _stream(left, by, at, width, 0 if strict else 1).unionByName(seen, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__seen").rowsBetween(Window.unboundedPreceding, 0)
    carried = _carried(events, keys, F.max("__seen"), lambda c, w: F.last(c, ignorenulls=True).over(w))
    own = events.withColumn("__last", F.last("__seen", ignorenulls=True).over(within)).where("__row is not null")
    found = own.join(carried, [*keys, "__b"], "left").withColumn("__found", F.coalesce("__last", "__carried"))
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in [when, *values]])


def open_at(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, name: str = "open", width: int = DAY) -> DataFrame:
    """``points`` with the number of intervals [start, end) of the same key that hold their time: running sums of starts and
    ends.  Intervals without an end stay open; those that end before they start hold nothing."""
    keys = [f"__k{i}" for i in range(len(by))]
    real = intervals.where(" and ".join(f"{c} is not null" for c in [*by, start])).where(F.col(end).isNull() | (F.col(end) > F.col(start)))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    change = F.explode(F.array(F.struct(_micros(start).alias("t"), F.lit(1).alias("d")), F.struct(_micros(end).alias("t"), F.lit(-1).alias("d")))).alias("c")
    changes = real.select(*named, change).where("c.t is not null").select(*keys, F.col("c.t").alias("__t"), _bucket(F.col("c.t"), width).alias("__b"), F.lit(0).alias("__side"), F.col("c.d").alias("__d"))
    events = _stream(points, by, at, width, 1).unionByName(changes, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = _carried(events, keys, F.sum("__d"), lambda c, w: F.sum(c).over(w))
    own = events.withColumn("__sum", F.sum("__d").over(within)).where("__row is not null")
    total = F.coalesce("__sum", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    return own.join(carried, [*keys, "__b"], "left").select("__row.*", F.when(F.col("__t").isNull(), 0).otherwise(total).cast("long").alias(name))


def holding(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: int = DAY) -> DataFrame:
    """All pairs of a point and an interval [start, end) of its key that holds its time.

    Intervals are repeated in each bucket that they touch, points lie in one: an equi-join by key and bucket, each pair once.  The
    width should be about an interval's length.  Column names of the two sides must differ but for the key."""
    last = points.agg(F.max(at).alias("__last"))  # one row
    closed = intervals.where(F.col(start).isNotNull()).crossJoin(F.broadcast(last))
    until = F.coalesce(F.col(end).cast("timestamp"), F.col("__last") + F.expr("interval 1 microsecond"))
    real = closed.withColumn("__until", until).where(F.col("__until") > F.col(start))
    first, final = _bucket(_micros(start), width), _bucket(_micros("__until") - 1, width)
    cut = real.withColumn("__b", F.explode(F.sequence(first, final)))
    dealt = points.withColumn("__b", _bucket(_micros(at), width))
    met = dealt.join(cut, [*by, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col("__until")))
    return met.drop("__b", "__until", "__last")
