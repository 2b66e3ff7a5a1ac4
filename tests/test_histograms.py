"""Quantiles without each member, from histograms, against sorted lists of the others' values."""

import random
from statistics import median

import pytest

from sentrygrid.operators import histograms

COUNTS, OWN = "key string, value double, m long", "who string, key string, value double, m long"


def frames(spark, rows):
    """Rows (who, key, value) as counts of a group and counts of its members."""
    group, own = {}, {}
    for who, key, value in rows:
        group[key, value] = group.get((key, value), 0) + 1
        own[who, key, value] = own.get((who, key, value), 0) + 1
    return spark.createDataFrame([(*k, n) for k, n in group.items()], COUNTS), spark.createDataFrame([(*k, n) for k, n in own.items()], OWN)


def at(values, share):
    values, p = sorted(values), share * (len(values) - 1)
    low, high = values[int(p)], values[min(int(p) + 1, len(values) - 1)]
    return low + (p - int(p)) * (high - low)


@pytest.mark.parametrize("seed", [1, 2])
def test_peers_equal_sorted_lists(spark, seed):
    rng = random.Random(seed)
    sizes = {("a", "x"): 60, ("b", "x"): 7, ("c", "x"): 3, ("d", "y"): 9, ("e", "y"): 2, ("f", "z"): 6, ("g", "x"): 25}
    spread = {1: lambda: float(rng.randrange(40)), 2: lambda: rng.random() * 20_000}[seed]
    rows = [(who, key, 5.0 if who == "g" else spread()) for (who, key), n in sizes.items() for _ in range(n)]
    placed, stats = histograms.peers(*frames(spark, rows), ["key"], "who", {"p5": 0.05, "median": 0.5}, least=5)
    got = {r["who"]: r for r in stats.collect()}
    ranks = {(r["who"], r["value"]): (r["below"], r["upto"]) for r in placed.collect()}
    assert set(got) == {"a", "b", "d", "f", "g"}
    for who, key in sizes:
        if who in got:
            rest = [v for w, k, v in rows if k == key and w != who]
            rest = rest if len(rest) >= 5 else [v for _, k, v in rows if k == key]
            mid, r = median(rest), got[who]
            assert r["n"] == len(rest) and r["mean"] == pytest.approx(sum(rest) / len(rest))
            assert (r["p5"], r["median"], r["mad"]) == pytest.approx((at(rest, 0.05), mid, median(abs(v - mid) for v in rest)))
            for v in {v for w, _, v in rows if w == who}:
                assert ranks[who, v] == (sum(x < v for x in rest), sum(x <= v for x in rest))


def test_no_rows_and_no_table_of_pairs(spark):
    placed, stats = histograms.peers(*frames(spark, []), ["key"], "who", {"median": 0.5}, least=5)
    assert placed.count() == 0 and stats.count() == 0
    histogram = histograms.cumulative(frames(spark, [("a", "x", 1.0), ("b", "x", 9000.0)])[0], ["key"])
    ranks = spark.createDataFrame([("x", 0, "first"), ("x", 1, "second")], "key string, rank long, name string")
    found = histograms.at_ranks(histogram, ranks, ["key"])
    assert {r["name"]: r["value"] for r in found.collect()} == {"first": 1.0, "second": 9000.0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
