"""Exact and near deduplication and components against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrygrid.llm import exact_dedup as ed
from sentrygrid.llm import near_dedup as nd
from sentrygrid.llm.common import text_buffers
from sentrygrid.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_cuckoo_filter():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    bucket = ed.IndexBucket()
    for i, k in enumerate(keys):
        bucket.add(k, i, 1)
        bucket.add(k, i + 7, 2)
    f = bucket.live
    assert f.resizes > 0 and all(f.maybe(k) and bucket.find(k) == [i, 3] for i, k in enumerate(keys))
    for k in keys[::2]:
        bucket.remove(k)
        bucket.remove(k)
    assert all(bucket.find(k) for k in keys[1::2]) and not any(bucket.find(k) for k in keys[::2]) and f.held == 2500
    others = [hashlib.sha256(f"o{i}".encode()).digest() for i in range(20000)]
    assert sum(map(f.maybe, others)) < 60 and not any(map(bucket.find, others))


def test_exact_groups(spark):
    rows = [(1, "a  b"), (2, "a\t\nb"), (3, "a b "), (4, None), (5, ""), (6, "a\xa0b"), (7, "a b"), (7, "a b"), (8, " a b"), (None, "a b")] + [(100 + i, "hot\ntext") for i in range(300)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, n int")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    got = ed.dedup_groups(spark, df).collect()
    assert len(got) == len(rows)
    for d, t in rows:
        mine = [r for r in got if r.doc_id == d and r.digest == hashlib.sha256(norm(t).encode()).digest()]
        assert mine and all(r.keep_id == min(x for x in groups[norm(t)] if x is not None) and r.group_size == len(groups[norm(t)]) for r in mine)
    assert sorted(r.doc_id for r in got if r.kept) == sorted({min(x for x in g if x is not None) for g in groups.values()})
    kept = ed.drop_duplicates(spark, df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8, 100]
    assert ed.dedup_groups(spark, df.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "x"), (7, "x")], "doc_id long, text string")
    assert [r.kept for r in ed.dedup_groups(spark, twice).collect()].count(True) == 1 and ed.drop_duplicates(spark, twice).count() == 1


def test_index_maintenance(spark):
    rng = random.Random(4)
    live = [(rng.randrange(9), f"t{rng.randrange(12)}") for _ in range(60)] + [(None, "t1"), (3, "hot"), (2, "hot")]
    changes = [(i, rng.choice(["insert", "delete", "delete"]), rng.randrange(9), f"t{rng.randrange(14)}") for i in range(200)]
    changes += [(900, "delete", 3, "hot"), (901, "delete", 2, "hot"), (902, "delete", 2, "hot"), (903, "insert", 8, "hot"), (904, "delete", None, "t1")]
    want = {}
    for op, doc, t in [("insert", *x) for x in live] + [(op, d, t) for _, op, d, t in changes]:
        held = want.setdefault(t, [])
        if op == "insert":
            held.append(doc)
        elif doc in held:
            held.remove(doc)
    d = lambda x: bytearray(hashlib.sha256(x.encode()).digest())
    before = spark.createDataFrame([(i, d(t)) for i, t in live], "doc_id long, digest binary")
    after = spark.createDataFrame([(s, op, i, d(t)) for s, op, i, t in changes], "seq long, op string, doc_id long, digest binary")
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in ed.maintain_index(before, after, 3).collect()}
    assert got == {bytes(d(t)): (min((x for x in v if x is not None), default=None), len(v)) for t, v in want.items() if v}


def test_many_repeats_of_a_row(spark):
    df = spark.createDataFrame([(7, "x")], "doc_id long, text string").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("i")
    got = ed.dedup_groups(spark, df).groupBy("doc_id", "group_size", "kept").count().collect()
    assert sorted((r.kept, r.group_size, r["count"]) for r in got) == [(False, 10_000, 9_999), (True, 10_000, 1)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingles(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed=3, groups=12, size=12):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefg", k=4)) for _ in range(400)]
    rows, n = [], 0
    for g in range(groups):
        base = rng.choices(vocab, k=rng.randint(20, 200))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // (10 + 2 * g)))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            text = " ".join(copy)
            rows.append((n, text.upper() if n % 5 == 0 else text.replace(" ", "\n", 3)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "One  Two"), (n + 5, "one two three"), (n + 6, "É é"), (n + 7, "é é")]


def test_shingle_sets_by_hand():
    texts = [t or "" for _, t in corpus(groups=3)]
    values, offs = nd.shingle_sets(*text_buffers(pa.array(texts)))
    sets = [set(values[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    for i, t in enumerate(texts):
        assert len(sets[i]) == len(shingles(t))
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(shingles(t) & shingles(texts[j]))
    alone, o = nd.shingle_sets(*text_buffers(pa.array(texts[7:8])))
    assert set(alone.tolist()) == sets[7] and o.tolist() == [0, len(sets[7])]


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b, both = x[:2000], x[500:2500], x[:2500]
    one, two, union = (nd.registers(s, np.array([0, len(s)])) for s in (a, b, both))
    assert (nd.merge(one, two) == union).all()
    assert nd.similarity(one, two, np.array([2000.0]), np.array([2000.0]))[0] == pytest.approx(0.6, abs=0.12)
    assert nd.similarity(one, one, np.array([2000.0]), np.array([2000.0]))[0] > 0.98


@pytest.mark.parametrize("seed", [3, 4])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, id int")
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.find_components(spark, df).collect()}
    assert got == want
    kept = nd.drop_near_duplicates(spark, df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_family_blocks_link_strays(spark):
    """A chain through strays: the blocks find links that pivots miss."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocab, k=100)
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(100)] = rng.choice(vocab)
        rows.append((i, " ".join(copy)))
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.find_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.find_components(spark, empty).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.find_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(2, 2, True), (5, 2, False), (5, 2, False), (None, 2, False), (None, None, True)], key=str)


def test_rows_that_share_an_id(spark):
    """Ids name rows only for output: of two texts under one id, one may have a near copy and the other none."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(500)]
    alone, twin = (" ".join(rng.choices(vocab, k=80)) for _ in range(2))
    near = " ".join([*twin.split()[:-1], "other"])
    third = " ".join(rng.choices(vocab, k=60))
    rows = [(7, alone), (7, twin), (3, near), (9, third), (9, third), (None, third), (None, None), (None, "- "), (None, alone + " more"), (8, None), (8, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.find_components(spark, df).collect()), key=str)
    want = [(7, 7, True), (7, 3, False), (3, 3, True), (9, 9, True), (9, 9, True), (None, 9, False), (None, None, True), (None, None, True), (None, 7, False), (8, 8, True), (8, 8, True)]
    assert got == sorted(want, key=str)
    kept = nd.drop_near_duplicates(spark, df)
    stays = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert stays == sorted([(7, alone), (3, near), (9, third), (None, None), (None, "- "), (8, None), (8, None)], key=str)
    assert kept.columns == df.columns


def test_long_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.id: r.component for r in components(spark, links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def _similar(a, b):
    return nd.enough(len(a & b), len(a), len(b))


def test_blocks_pass_on_classes_and_links_equal_brute_force():
    """A group that is alike at about 0.7, mostly without links: classes go on, at most once each, and every component is found."""
    rng = random.Random(11)
    core = rng.sample(range(1 << 60), 400)
    sets = [frozenset(core[:330] + rng.sample(range(1 << 60), 70)) for _ in range(60)]
    sets += [frozenset([*list(s)[:-25], *rng.sample(range(1 << 60), 25)]) for s in sets[:20]]
    sets += [frozenset(rng.sample(range(1 << 60), 400)) for _ in range(20)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    offs = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    regs = nd.registers(nd.mix(np.concatenate(arrays)), offs)
    for same in (True, False):
        left = [same or i % 2 == 0 for i in range(len(sets))]
        met = [(i, j) for i in range(len(sets)) for j in range(i) if same or left[i] != left[j]]
        wanted = set(nd._crossing([(left[i], i, i, len(sets[i]), regs[i].tobytes()) for i in range(len(sets))], same).tolist())
        assert {x for i, j in met if _similar(sets[i], sets[j]) for x in (i, j)} <= wanted and not wanted & set(range(80, 100))
        links = nd._linked([(left[i], i, i, arrays[i].tobytes()) for i in sorted(wanted)], same)
        assert all(_similar(sets[u], sets[v]) for u, v in links)
        part = lambda pairs: _parts(len(sets), pairs)
        assert part(links) == part([(i, j) for i, j in met if _similar(sets[i], sets[j])]) and len(links) < len(sets)
    one = (True, 5, 5, 400, regs[0].tobytes())
    assert not len(nd._crossing([one], True)) and not len(nd._crossing([one], False)) and nd._linked([(True, 5, 5, arrays[0].tobytes())], False) == []


def _parts(n, pairs):
    name = list(range(n))
    for u, v in pairs:
        a, b = name[u], name[v]
        name = [min(a, b) if x in (a, b) else x for x in name]
    return name


def test_pairs_of_several_buckets_count_in_one():
    rng = random.Random(12)
    base = rng.sample(range(1 << 60), 500)
    sets = [np.array(sorted([*base[:450], *rng.sample(range(1 << 60), 50)]), np.uint64) for _ in range(2)]
    regs = nd.registers(nd.mix(np.concatenate(sets)), np.array([0, 500, 1000]))
    keys = nd.band_keys(regs)
    shared = [int(k) for k in keys[0] if k in keys[1]]
    rows = [(True, i, i, 500, regs[i].tobytes()) for i in range(2)]
    assert len(shared) > 1
    assert [len(nd._crossing(rows, True, k)) for k in sorted(shared)] == [2] + [0] * (len(shared) - 1)
