import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrygrid.llm import packing
from sentrygrid.llm.packing import TOLERANCE, combinations, make_plan, nnls
from sentrygrid.llm.queries import tokenizer

W = 64


def byte_ids():
    """Ids without a tokenizer: one a byte.  A nested function travels to the workers by value."""

    def ids(texts):
        return [np.frombuffer(t, np.uint8).astype("<u4").tobytes() for t in texts]

    return ids


fake = byte_ids()


def check(rows, docs, window):
    """Pieces cover every document exactly and lie gaplessly in sequences; returns padding over tokens."""
    ids = {}
    for doc, text in docs:
        ids.setdefault(doc, []).append(np.append(np.frombuffer((text or "").encode(), np.uint8).astype("<u4"), 1).astype("<u4"))
    for doc, arrays in ids.items():
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc)
        want = sorted(arrays[0].size for _ in arrays)
        assert sum(n for _, n, _ in mine) == sum(a.size for a in arrays) if len(arrays) > 1 else [s for s, _, _ in mine] == list(np.cumsum([0] + [n for _, n, _ in mine])[:-1])
        if len(arrays) == 1:
            assert sum(n for _, n, _ in mine) == want[0]
            assert all(zlib.crc32(arrays[0][s : s + n].tobytes()) == c for s, n, c in mine)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    pad = total = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(total, 1)


def pack(spark, docs, window=W):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return packing.pack_pieces(spark, df, "", window, encode=fake).collect()


def test_pieces_cover_documents(spark):
    rng = np.random.default_rng(5)
    docs = [(i, "x" * int(n)) for i, n in enumerate(rng.geometric(0.02, 600))]
    assert check(pack(spark, docs), docs, W) < 0.02


def test_hot_length_is_cut(spark):
    docs = [(i, "y" * 40) for i in range(500)] + [(1000 + i, "z" * 5) for i in range(20)]
    assert check(pack(spark, docs), docs, W) < 0.02


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a" * 1000), (4, "b" * 63), (5, "b" * 64), (6, "b" * 127), (None, "q")]
    check(pack(spark, docs), docs, W)
    check(pack(spark, [(7, "abc"), (7, "abc"), (7, "abc")]), [(7, "abc")] * 3, W)
    assert pack(spark, []) == []
    with pytest.raises(ValueError):
        packing.pack_pieces(spark, spark.createDataFrame(docs, "doc_id long, text string"), "", 100, encode=fake)


def test_clashing_columns_and_sequences(spark):
    docs = [(i, "t" * (10 + i)) for i in range(40)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, bucket int, tail int")
    rows = packing.pack_pieces(spark, df, "", W, encode=fake).collect()
    check(rows, docs, W)
    seqs = packing.pack_sequences(spark, df, "", W, encode=fake).collect()
    assert sum(len(s.ids) // 4 for s in seqs) == sum(len(t) + 1 for _, t in docs)
    assert all(len(s.ids) // 4 == sum(p.length for p in s.pieces) for s in seqs)


def test_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    from sentrygrid.llm.word_ids import encoder

    path = tokenizer("word_bpe_49k.json")
    texts = ["", " ", "Hello, World's  END", "tab\tand\x1cfs ", "<|endoftext|> x<|startoftext|>y", "é É ß ﬁ ǅ İ", "日本語 😀", "12 a1b2 --- ,,,", "x" * 3000]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoder(path).encode([t.encode() for t in texts]) == want


def test_least_squares_meets_an_exact_histogram():
    lengths = np.array([10, 20, 34, 44, 54])
    combos = combinations(lengths, W)
    assert {tuple(c) for c in combos.tolist()} == {(0, 10, 54), (0, 20, 44), (10, 10, 44), (10, 20, 34)}
    target = np.zeros(W + 1)
    for parts, n in (((10, 54), 7), ((20, 44), 5)):
        for p in parts:
            target[p] += n
    x = nnls(combos, target)
    got = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=W + 1)
    got[0] = 0
    assert (x >= 0).all() and np.abs(got - target).max() < 0.1


def least(columns, target):
    """Least squares with x >= 0 by Lawson and Hanson's active set: one column enters at a time, dense solves."""
    a = np.zeros((len(target), len(columns)))
    for j, parts in enumerate(columns):
        for p in parts:
            if p:
                a[p, j] += 1
    x, free = np.zeros(len(columns)), np.zeros(len(columns), bool)
    while True:
        pull = a.T @ (target - a @ x)
        pull[free] = 0
        if pull.max() < 1e-9:
            return x, 0.5 * np.sum((target - a @ x) ** 2)
        free[np.argmax(pull)] = True
        while True:
            z = np.zeros(len(columns))
            z[free] = np.linalg.lstsq(a[:, free], target, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            low = free & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12


def test_least_squares_equal_an_independent_solver():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, W), 30, replace=False))
        target = np.zeros(W + 1)
        target[lengths] = rng.integers(1, 30, 30)
        combos = combinations(lengths, W)
        x = nnls(combos, target)
        got = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=W + 1)
        got[0] = 0
        assert (x >= 0).all() and 0.5 * np.sum((target - got) ** 2) <= least(combos.tolist(), target)[1] + 0.5


def test_large_histogram_is_solved_as_the_query_solves_it():
    """Some 10,000 tails of a window of 2048: the optimality conditions, and a bound from the dual problem."""
    rng = np.random.default_rng(7)
    target = np.bincount(np.minimum(2047, 1 + rng.gamma(1.2, 300, 10_000).astype(int)), minlength=2049).astype(float)
    combos = combinations(np.flatnonzero(target), 2048)
    x = nnls(combos, target)
    got = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=2049)
    got[0] = 0
    rest = target - got
    pull = np.where(combos > 0, rest[combos], 0).sum(axis=1)
    assert (x >= 0).all() and pull.max() <= TOLERANCE and np.abs(pull[x > 0]).max() <= TOLERANCE
    feasible = rest - pull.max() / 2  # every combination has two lengths or more
    feasible[0] = 0
    bound = target @ feasible - 0.5 * feasible @ feasible
    assert 0.5 * rest @ rest <= bound + 0.01 * 0.5 * target @ target
    placed = np.floor(x + 0.5)
    assert (placed[:, None] * (combos > 0)).sum() > 0.75 * target.sum()


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, W - 1), st.integers(1, 40), max_size=20))
def test_plan_places_every_tail(hist):
    plan = make_plan(hist, W)
    room = {}
    for length, n in hist.items():
        first, seq, offset = plan.runs.get(length, ((), (), ()))
        for rank in range(plan.whole[length]):
            k = int(np.searchsorted(first, rank, side="right")) - 1
            room.setdefault(int(seq[k]) + rank - int(first[k]), []).append((int(offset[k]), length))
        assert plan.whole[length] <= n
    for parts in room.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) <= W
