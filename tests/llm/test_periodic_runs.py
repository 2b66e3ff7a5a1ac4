"""Runs against all periods compared word by word, and the query's defined results."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from sentrygrid.llm import periodic_runs as P


def all_runs(w, least=24, exponent=3):
    """Every period's maximal stretches, the smallest period of each."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def patched_words(rng):
    """Few distinct words, periods, and pieces of what came before."""
    k, w = rng.choice([1, 2, 3, 5]), []
    while len(w) < rng.choice([30, 80, 250]):
        r = rng.random()
        if r < 0.3 or not w:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
        elif r < 0.7:
            p = rng.randrange(1, 15)
            w += ([rng.randrange(k) for _ in range(p)] * 12)[: rng.randrange(p, 12 * p + 1)]
        else:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(1, 80)]
    return w


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (2, 2), (6, 3)])
def test_runs_equal_all_periods(least, exponent):
    rng = random.Random(least)
    for _ in range(600):
        w = patched_words(rng)
        assert P.find_runs(w, least, exponent) == sorted(all_runs(w, least, exponent))
        if exponent == 3:
            assert P.runs_of([b"%d" % x for x in w], least, exponent) == all_runs(w, least, exponent)


def test_factors_are_the_longest_that_occur_before():
    rng = random.Random(1)
    for _ in range(100):
        w, i = patched_words(rng)[:120], 0
        for start, size, source in P.factors(w):
            assert start == i
            earlier = [n for j in range(i) for n in [next((n for n in range(len(w) - i) if w[j + n] != w[i + n]), len(w) - i)]]
            assert size == max([1, *earlier])
            assert source == -1 or source < start and w[source : source + size] == w[start : start + size]
            i += size
        assert i == len(w)


def brute(doc_id, text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = all_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def digests(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_over_its_table(spark):
    from sentrygrid.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    found = digests(QUERIES["op13_periodic_runs"](spark, d))
    assert found == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    assert any(r[1] for r in found)


def test_defined_results(spark):
    tail = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "x y " * 30), (4, "x y " * 30), (None, "la " * 24), (5, "la " * 23), (tail, "one two three four five six seven eight nine"), (6, ("a b c " * 10) + "d " + ("a b c " * 10)), (7, "wort " * 300_000)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, collapsed string, runs int")
    assert digests(P.digest_runs(df.where("doc_id is null or doc_id <> 7"), P.repeat_tails)) == sorted(((i, *brute(i, t)) for i, t in rows if i != 7), key=str)
    assert P.digest_runs(df.where("doc_id = 7")).first()[1:6] == (1, 0, 300_000, 1, 300_000_000)
    out = {r["doc_id"]: r for r in P.periodic_runs(df).collect()}
    assert out[6]["collapsed"] == "a b c d a b c" and [tuple(r) for r in out[6]["runs"]] == [(0, 30, 3), (31, 30, 3)]
    assert out[1]["n_words"] == 0 and out[7]["collapsed"] == "wort"
    assert P.digest_runs(df.limit(0)).count() == 0
