"""Joins over time, reach, sketches and merged state against plain loops."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrygrid.operators import feedback, feedback_state, intervals, reach, sketches
from sentrygrid.sources import scratch

T0 = datetime(2026, 3, 1)


def times(rng, n, days=20):
    return [None if rng.random() < 0.05 else T0 + timedelta(hours=rng.randrange(24 * days)) for _ in range(n)]


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_a_search(spark, strict):
    rng = random.Random(strict)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(i, rng.choice(keys), t) for i, t in enumerate(times(rng, 300))]
    right = [(rng.choice(keys), t, rng.randrange(5), rng.choice(["x", "y", None])) for t in times(rng, 200)]
    out = intervals.as_of(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v int, w string"), ["k"], "t", "ts", ["v", "w"], width=86_400, strict=strict)
    assert out.columns == ["id", "k", "t", "ts", "v", "w"]
    got = {r["id"]: (r["ts"], r["v"], r["w"]) for r in out.collect()}
    order = lambda r: (r[1], r[2], r[3] is not None, r[3] or "")
    for i, k, t in left:
        fit = [r for r in right if k is not None and r[0] == k and t is not None and r[1] is not None and (r[1] < t or r[1] == t and not strict)]
        assert got[i] == (max(fit, key=order)[1:] if fit else (None, None, None))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_open_intervals_equal_a_count(spark):
    rng = random.Random(5)
    keys = ["hot"] * 8 + ["a", None]
    points = [(i, rng.choice(keys), t) for i, t in enumerate(times(rng, 200))]
    spans = [(j, rng.choice(keys), s, None if rng.random() < 0.1 else (s or T0) + timedelta(hours=rng.randrange(-5, 100))) for j, s in enumerate(times(rng, 150))]
    p = spark.createDataFrame(points, "id int, k string, t timestamp")
    s = spark.createDataFrame(spans, "span int, k string, a timestamp, z timestamp")
    holds = lambda x, y: x[1] is not None and x[1] == y[1] and x[2] is not None and y[2] is not None and y[2] <= x[2] and (y[3] is None or x[2] < y[3])
    got = {r["id"]: r["n"] for r in intervals.open_at(p, s, ["k"], "t", "a", "z", "n").collect()}
    assert got == {x[0]: sum(holds(x, y) for y in spans) for x in points}
    pairs = sorted((r["id"], r["span"]) for r in intervals.holding(p, s, ["k"], "t", "a", "z", width=40 * 3600).collect())
    assert pairs == sorted((x[0], y[0]) for x in points for y in spans if holds(x, y))
    assert intervals.holding(p.limit(0), s, ["k"], "t", "a", "z").count() == intervals.open_at(p.limit(0), s, ["k"], "t", "a", "z").count() == 0


def test_reach_to_any_depth(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(60)] + [(5, 5), (None, 3)]
    want, frontier, hops = {0: 0, 150: 0}, [0, 150], 0
    while frontier:
        hops += 1
        frontier = sorted({v for u, v in edges if u in frontier and v not in want})
        want |= dict.fromkeys(frontier, hops)
    df = spark.createDataFrame(edges, "u long, v long")
    seeds = spark.createDataFrame([(0,), (150,), (0,), (None,)], "node long")
    got = {r["node"]: r["hops"] for r in reach.reach(spark, df, seeds).collect()}
    assert got == want and max(want.values()) > 20
    near = {r["node"]: r["hops"] for r in reach.reach(spark, df, seeds, most=2).collect()}
    assert near == {n: h for n, h in want.items() if h <= 2}
    assert reach.reach(spark, df, seeds.limit(0)).count() == 0


def test_sketches_merge_to_the_sketch_of_the_whole(spark):
    rows = [(f"E{i % 2}", f"A{i * 7919 % 900}", T0 + timedelta(hours=i), float(i * 31 % 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id string, asset_id string, created_ts timestamp, s double")
    days = sketches.daily(df, F.col("s"))
    assert days.count() == 2 * 125
    got = {r["entity_id"]: r for r in sketches.estimates(sketches.merged(days, "entity_id"), (0.5,)).collect()}
    for e, r in got.items():
        mine = [x for x in rows if x[0] == e]
        exact = len({x[1] for x in mine})
        assert r["alerts"] == len(mine) and abs(r["assets"] - exact) <= exact * sketches.COUNT_ERROR
        assert abs(sum(x[3] <= r["p50"] for x in mine) / len(mine) - 0.5) <= sketches.RANK_ERROR


def decisions(n=400):
    rng = random.Random(n)
    return [(i, f"F{i % 30}", f"E{rng.randrange(3)}", f"D{rng.randrange(4)}", rng.choice(["dismiss", "confirm", "note"]), "x", "", str(i)) for i in range(n)]


def table(df):
    return sorted((r["entity_id"], r["detector_id"], round(r["factor"], 6), r["version"], r["updated_at"]) for r in df.collect())


def test_any_split_of_the_ledger_gives_the_weights(spark):
    rows = decisions()
    whole = table(feedback.weights(spark.createDataFrame(rows, feedback.LEDGER)))
    for cuts in ([0, 400], [0, 1, 2, 399, 400], [0, 150, 150, 300, 400]):
        path = scratch.folder(spark, "test-state")
        for a, b in zip(cuts, cuts[1:], strict=False):
            batch = spark.createDataFrame(rows[a:b], feedback.LEDGER)
            version = feedback_state.merge(spark, path, batch)
            assert feedback_state.merge(spark, path, batch) == version  # once more changes nothing
        assert table(feedback_state.weights(spark, path)) == whole
    before = feedback_state.current(spark, path)["folders"]
    feedback_state.merge(spark, path, spark.createDataFrame([(1000, "F", "E0", "D0", "dismiss", "x", "", "1000")], feedback.LEDGER))
    after = feedback_state.current(spark, path)["folders"]
    assert len([p for p in after if after[p] != before.get(p)]) == 1  # other parts stay where they are


def test_two_writers_lose_nothing(spark):
    rows = decisions(200)
    path = scratch.folder(spark, "test-race")
    frames = [spark.createDataFrame(rows, feedback.LEDGER) for _ in range(2)]
    done = [threading.Thread(target=feedback_state.merge, args=(spark, path, f)) for f in frames]
    for t in done:
        t.start()
    for t in done:
        t.join()
    assert table(feedback_state.weights(spark, path)) == table(feedback.weights(frames[0]))
    assert not scratch.put_if_absent(spark, f"{path}/versions/00000001.json", "x")
    assert len(scratch.names(spark, f"{path}/versions")) == 1
