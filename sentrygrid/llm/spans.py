"""Regular-expression spans in DataFrame functions: where every match of a pattern lies, in code points.

Spark returns the matches of a pattern but not their places.  Splitting by the same pattern gives the gaps between
them; running sums of gap and match lengths are the places.  Patterns must not match the empty string, and use
possessive quantifiers so that long runs neither recurse nor backtrack.

Array functions copy what they grow, so running values are taken over slices of ``SLICE`` entries and then over the
slices' totals: a text with hundreds of thousands of matches costs little more than its length.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries that one slice of a running value holds, and code points of one piece of a text that is cut.
SLICE, PIECE = 256, 4096


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an expression would be computed for every entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(items: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, start, lambda acc, x: F.concat(acc, F.array(combine(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running combination (sum or maximum of integers from 0 on) up to and with each entry."""

    def over(items: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(SLICE)), lambda i: F.slice(items, i, F.lit(SLICE)))
        return F.transform(slices, lambda part: F.struct(_grown(part, nothing("int"), combine).alias("run")))

    def joined(runs: Column) -> Column:
        before = _grown(F.transform(runs, lambda s: F.coalesce(F.try_element_at(s["run"], F.lit(-1)), F.lit(0))), F.array(F.lit(0)), combine)
        return F.flatten(F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), lambda s, at: F.transform(s["run"], lambda x: combine(at, x))))

    return let(let(values, over), joined)


def add(a: Column, b: Column) -> Column:
    return a + b


def last_word(text: Column) -> Column:
    """The last run of non-space characters, lower-cased and bare of marks at both ends; empty if it is marks alone."""
    tail = F.reverse(F.regexp_extract(F.reverse(text), r"^\s*+[^\s\p{L}\p{N}]*+(\S*+)", 1))
    return F.lower(F.regexp_extract(tail, r"^[^\p{L}\p{N}]*+(\S*+)", 1))


def located(text: Column, pattern: str, found: Column, words: bool = False) -> Column:
    """``found``, the whole matches of ``pattern`` in ``text``, as structs (start, end, value) in order; ``words`` adds the
    word before each, ``before``, looked for from the end of the match before it on."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    step = lambda m, gap: F.struct(m.alias("value"), (F.char_length(gap) + F.char_length(m)).alias("n"), *([last_word(gap).alias("before")] if words else []))
    more = ["before"] if words else []
    placed = lambda x, end: F.struct((end - F.char_length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"), *[x[c].alias(c) for c in more])
    whole = let(F.zip_with(found, gaps, step), lambda xs: F.zip_with(xs, running(F.transform(xs, lambda x: x["n"]), add), placed))
    return F.when(F.size(found) > 0, whole).otherwise(nothing("struct<start:int,end:int,value:string" + ",before:string" * words + ">"))


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by one pass over both in order: a span stands behind all others
    that start before its end, so that the furthest end so far tells whether one of them reaches into it."""

    def point(at: Column, behind: int, end: Column, i: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(behind).alias("behind"), end.alias("end"), i.alias("i"))

    def free(mine: Column) -> Column:
        line = F.sort_array(F.concat(F.transform(others, lambda s: point(s["start"], 1, s["end"], F.lit(-1))), F.transform(mine, lambda s, i: point(s["end"], 0, F.lit(0), i))))
        held = let(line, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["end"]), F.greatest), lambda p, r: F.struct(p["i"].alias("i"), r.alias("reach"))))
        clear = F.filter(held, lambda p: (p["i"] >= 0) & (p["reach"] <= F.get(mine, p["i"])["start"]))
        return F.transform(F.sort_array(F.transform(clear, lambda p: p["i"])), lambda i: F.get(mine, i))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(spans, free)).otherwise(spans)


def labelled(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def replaced(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts (key, text) with every marked span (key, start, end, kind) replaced by ``<KIND>``: (key, text) of the keys in ``rows``.

    Spans that overlap become one mark of the first.  Texts are cut into pieces and spans into the parts that lie in a
    piece, so that the work grows with the length of a text whatever the number of its spans."""
    order = Window.partitionBy("key").orderBy("start", "end", "kind")
    furthest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = marks.withColumn("fresh", F.coalesce(F.col("start") >= furthest, F.lit(True)).cast("long"))
    grouped = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = grouped.groupBy("key", "island").agg(F.min(F.struct("start", "end", "kind")).alias("first"), F.max("end").alias("end"))
    parts = islands.select("key", F.col("first.start").alias("start"), "end", F.col("first.kind").alias("kind"), F.explode(F.sequence(F.floor(F.col("first.start") / PIECE), F.floor((F.col("end") - 1) / PIECE))).alias("piece"))
    base = F.col("piece") * PIECE
    cut = F.struct((F.greatest(F.col("start"), base) - base).cast("int").alias("a"), (F.least(F.col("end"), base + PIECE) - base).cast("int").alias("b"), F.when(F.col("start") >= base, F.concat(F.lit("<"), F.upper("kind"), F.lit(">"))).otherwise("").alias("mark"))
    parts = parts.select("key", F.col("piece").cast("int").alias("piece"), F.lit(None).cast("string").alias("text"), cut.alias("cut"))
    texts = rows.select("key", F.posexplode(matches(F.col("text"), rf"(?s).{{1,{PIECE}}}")).alias("piece", "text"), F.lit(None).cast("struct<a:int,b:int,mark:string>").alias("cut"))
    both = texts.unionByName(parts).repartition("key")  # one exchange serves both groupings
    pieces = both.groupBy("key", "piece").agg(F.max("text").alias("text"), F.sort_array(F.collect_list("cut")).alias("cuts"))  # at most PIECE cuts
    ends = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["b"]))
    kept = F.zip_with("cuts", F.slice(ends, F.lit(1), F.size("cuts")), lambda c, after: F.concat(F.substring(F.col("text"), after + 1, c["a"] - after), c["mark"]))
    rest = F.substring(F.col("text"), F.element_at(ends, -1) + 1, F.lit(PIECE))
    clean = pieces.select("key", "piece", F.concat(F.array_join(kept, ""), rest).alias("text"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"])
    return clean.groupBy("key").agg(F.array_join(whole, "").alias("text"))
