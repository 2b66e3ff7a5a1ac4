"""Turn repair against a search over all edit sequences, and its defined results."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sentrygrid.llm import turn_repair as T

SHAPE = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Cost, audit and repaired rows of the best edits, by Dijkstra over (turns taken, automaton state) with the audits as ties.

    turns: (role, text, fault) with faults as in the module."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, rows = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, rows
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in "ua":
            if (state, r) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*rows, (T.ROLE[T.U if r == "u" else T.A], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, rows))
            if fault not in (T.BLANK, T.DUPLICATE):
                more = 5 * (fault == T.TRUNCATED)
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[state, role[:1]], (*rows, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in step:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r, (*rows, (name, text))))
    raise AssertionError


def brute(rows):
    """The report of damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = T.BLANK if not body else T.DUPLICATE if (role, text) in seen else T.TRUNCATED if body[-1] not in ".!?" else T.SOUND
        seen.add((role, text))
        turns.append((role, text, fault))
    cost, audit, kept = cheapest(turns)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    faults = [sum(f == k for _, _, f in turns) for k in (1, 2, 3)]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        group = out.setdefault(conv, [])
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        group += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def reported(df):
    names = [x.split()[0] for x in T.REPORT.split(", ")]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations_equal_the_search(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Yes.", "No!", "open", " ", "", None, f"Text {turn}.", f"Text {turn}?\n", "sure. \t"])))
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi.")]
    found = reported(T.report(T.damage(spark.createDataFrame(rows, SCHEMA).repartition(5))))
    want = {c: brute(g) for c, g in damaged(rows).items()}
    assert found == want
    assert all(SHAPE.fullmatch(re.sub("x", "", "")) for _ in found)


def test_long_conversation_and_all_gone(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B.", f"{i}.", "cut"]) + "x" * (200_000 if i == 7 else 0)) for i in range(3000)]
    gone = next(c for c in range(2, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    found = reported(T.report(T.damage(spark.createDataFrame(rows, SCHEMA))))
    assert found == {c: brute(g) for c, g in damaged(rows).items()}
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [("c", 1, "system", "Be brief."), ("c", 2, "assistant", "Hello."), ("c", 3, "assistant", "Again."), ("c", 4, "user", "Why?"), ("d", None, "user", " "), ("d", 1, "user", "Only.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("fault", F.lit("x")).withColumn("state", F.lit(1))
    out = T.repair(T.turns_of(df)).orderBy("conv_id", "position").collect()
    kept = {c: [r for r in out if r["conv_id"] == c and r["position"] is not None] for c in "cd"}
    assert [r["position"] for r in kept["c"]] == list(range(len(kept["c"])))
    for c in "cd":
        assert SHAPE.fullmatch("".join(r["role"][0] for r in kept[c]))
    assert sum(r["edit"] == "D" for r in out if r["conv_id"] == "d") == 2  # deleting both is cheaper than an answer
    report = reported(T.report(T.turns_of(df)))
    assert report["c"] == brute([r[1:] for r in rows if r[0] == "c"])


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, n):
    assert T.report(T.damage(spark.createDataFrame([], SCHEMA))).count() == n


def test_query_over_its_table(spark):
    from sentrygrid.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(QUERIES["op11_turn_repair"](spark, d)) == {c: brute(g) for c, g in damaged(rows).items()}
