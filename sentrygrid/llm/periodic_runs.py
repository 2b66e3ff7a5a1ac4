"""Runs of periodically repeated words, by the method of Kolpakov and Kucherov (operator 13).

A run is a stretch of words with smallest period q, at least ``EXPONENT`` periods and ``LEAST`` words long, that no
neighbouring word extends keeping q.  For a sequence of words:

1. a suffix automaton, which knows where each state's strings end first, gives the factorisation into longest stretches
   that occur before (Lempel-Ziv, the earlier occurrence may overlap);
2. a run that begins at or before a factor's first word, or ends with the last word of the factor in front of it, lies near that
   boundary: Main's algorithm finds these, as common prefixes and suffixes around the boundary, for all periods by two Z functions
   to each side;
3. every other run lies inside a factor and is copied from the factor's earlier occurrence.

Before that, stretches where no run can lie are set aside: a run of at least 24 words and three periods has 16 or more
words in a row that recur q words later, so its words all lie in 16-grams (by hash) that occur twice.  Runs lie in the unions of
such 16-grams, which are searched again alone, then factorised.  This loses no run and keeps most texts out of the automaton.

One document is one row, so its words are in one task; memory grows with the longest text alone.  Defined results:
null and blank texts have no words and no runs; documents without an id are read like others; repeated rows each give
a row; of equal exponents the run that starts first, then the shorter period, is the strongest; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentrygrid.llm.common import id_text, slices, text_buffers

#: The fewest words of a run, and its fewest periods.
LEAST, EXPONENT = 24, 3
Run = tuple[int, int, int]  # start, length, period


# ---------------------------------------------------------------- where runs can lie
def repeated_stretches(codes: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches covered by ``gram``-word windows (a power of two) that occur at least twice within them, by hash."""
    found, todo = [], [(0, len(codes))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= gram:
            continue
        h, width = codes[lo:hi].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
        base = 0xD6E8FEB86659FD93
        while width < gram:  # mod 2^64
            h = h[:-width] * np.uint64(base) + h[width:]
            h ^= h >> np.uint64(29)
            base, width = base * base % 2**64, 2 * width
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        starts = np.flatnonzero(np.isin(h, twice))
        breaks = np.flatnonzero(np.diff(starts) > gram) + 1
        parts = [(lo + int(p[0]), lo + int(p[-1]) + gram) for p in np.split(starts, breaks)]
        if 4 * sum(b - a for a, b in parts) > 3 * (hi - lo):
            found += parts  # little to gain from looking again
        else:
            todo += parts
    return sorted(found)


# ---------------------------------------------------------------- factors
class SuffixAutomaton:
    """States in arrays; most have one transition, the others' are in ``more``."""

    def __init__(self, words: Sequence[int]) -> None:
        self.link, self.length, self.first_end = array("q", [-1]), array("q", [0]), array("q", [-1])
        self.word, self.to, self.more = array("q", [-1]), array("q", [0]), {}
        link, length, first_end, word, to, more = self.link, self.length, self.first_end, self.word, self.to, self.more
        last = 0
        for i, c in enumerate(words):
            new = len(link)
            link.append(0)
            length.append(i + 1)
            first_end.append(i)
            word.append(-1)
            to.append(0)
            p, q = last, -1
            last = new
            while p >= 0:
                q = self.step(p, c)
                if q >= 0:
                    break
                if word[p] < 0:
                    word[p], to[p] = c, new
                else:
                    more.setdefault(p, {})[c] = new
                p = link[p]
            if p < 0:
                continue
            if length[p] + 1 == length[q]:
                link[new] = q
                continue
            copy = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            first_end.append(first_end[q])
            word.append(word[q])
            to.append(to[q])
            if q in more:
                more[copy] = dict(more[q])
            while p >= 0 and self.step(p, c) == q:
                if word[p] == c:
                    to[p] = copy
                else:
                    more[p][c] = copy
                p = link[p]
            link[q] = link[new] = copy

    def step(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(c, -1)


def factors(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """Start, length and the start of an earlier occurrence (-1: a word not seen before) of each factor."""
    automaton, out, i, n = SuffixAutomaton(words), [], 0, len(words)
    step, first_end = automaton.step, automaton.first_end
    while i < n:
        state, end = 0, i
        while end < n:
            after = step(state, words[end])
            if first_end[after] >= end:
                break
            state, end = after, end + 1
        out.append((i, end - i, first_end[state] - (end - i) + 1) if end > i else (i, 1, -1))
        i = max(end, i + 1)
    return out


# ---------------------------------------------------------------- runs
def z_function(s: Sequence[int]) -> list[int]:
    """How many words s and s[i:] begin with in common, for each i."""
    n, lo, hi = len(s), 0, 0
    z = [0] * n
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        lo, hi = i, i + k
    return z


def _at_boundary(words: Sequence[int], b: int, before: int, size: int, least: int, exponent: int) -> Iterator[Run]:
    """Runs as (start, end, period) with start <= b that end in the factor of ``size`` words at b, or just before b.

    With the factors' lengths m and k, a run that ends in the second one has a period below (m + k) / (exponent - 1) and
    begins less than m + period words before b: else the first factor would have been longer."""
    n, f = len(words), b + size
    most = (before + size) // (exponent - 1) + 1
    if (before + size) * exponent <= least * (exponent - 1):
        return
    low = max(0, b - (before + most + 1))
    t, u = words[low:b], words[b:f]
    back, gap = t[::-1], [-1]
    right = z_function(u)
    left = z_function(back)
    left_over = z_function(back + gap + u[::-1] + back)  # suffixes of t against those of t + u[:q]
    right_over = z_function(u + gap + t + u)  # u against t[-q:] + u
    for q in range(1, min(most, max(size, len(t))) + 1):
        ends = []
        if q <= size:  # a period to the right of b
            ends.append((b - left_over[len(t) + 1 + size - q], b + q + (right[q] if q < size else 0)))
        if q <= len(t):  # a period to the left of b
            ends.append((b - q - (left[q] if q < len(t) else 0), b + min(size, right_over[size + 1 + len(t) - q])))
        for s, e in ends:
            if e - s >= max(least, exponent * q) and (s > low or not low) and not (e == f < n and words[f] == words[f - q]):
                yield s, e, q


def find_runs(words: Sequence[int], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs of a sequence of non-negative numbers, by start, then period."""
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    by_start: list[tuple[int, int]] = []

    def add(s: int, e: int, q: int) -> None:
        if (s, e) not in found:
            insort(by_start, (s, e))
            found[s, e] = q
        elif q < found[s, e]:
            found[s, e] = q

    before = 0
    for b, size, source in [*factors(words), (len(words), 0, -1)]:
        for s, e, q in _at_boundary(words, b, before, size, least, exponent):
            add(s, e, q)
        if source >= 0 and size > least:
            shift, end = b - source, b + size - 1
            i = bisect_right(by_start, (source + 1, -1))
            while i < len(by_start) and by_start[i][0] + shift < end:  # grows while copies of copies are made
                s, e = by_start[i]
                if e + shift <= end:
                    add(s + shift, e + shift, found[s, e])
                i += 1
        before = size
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """Runs of a document's words, from the stretches where they can lie."""
    if len(words) < least:
        return []
    shortest = -(-least * (exponent - 1) // exponent)  # a run's words that recur a period later are at least so many
    gram = 1 << (shortest.bit_length() - 1)
    out: list[Run] = []
    for lo, hi in repeated_stretches(np.fromiter(map(hash, words), np.int64, len(words)), gram):
        if hi - lo >= least:
            numbers: dict[bytes, int] = {}
            out += [(lo + s, n, q) for s, n, q in find_runs([numbers.setdefault(w, len(numbers)) for w in words[lo:hi]], least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        steps[s + q] += 1
        steps[s + n] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    best = None
    for s, n, q in runs:  # by start, then period: the first of equal exponents stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


# ---------------------------------------------------------------- documents
Change = Callable[[int | None, list[bytes]], list[bytes]]


def repeat_tails(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Periodic tails, planted by a checksum of the id."""
    n = len(words)
    tenths, h = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if doc_id is None or h or not n:
        return words
    a = tenths % n
    p = 1 + (n - a) // (3 + tenths % 8)
    period = words[a : a + p]
    return words[:a] + (period * -(-(n - a) // p))[: n - a]


def _documents(batches: Iterable[pa.RecordBatch], change: Change | None) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            raw, offs = text_buffers(part.column("text"))
            raw, offs = raw.tobytes(), offs.tolist()
            rows = []
            for doc_id, lo, hi in zip(part.column("doc_id").to_pylist(), offs, offs[1:], strict=False):
                words = raw[lo:hi].split()  # of bytes: at space, tab, LF, VT, FF and CR alone
                rows.append((doc_id, change(doc_id, words) if change else words))
            yield rows


def periodic_runs(docs: DataFrame, change: Change | None = None, least: int = LEAST, exponent: int = EXPONENT, text: str = "text") -> DataFrame:
    """One row a document: its runs, and its text without their repetitions, words joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for rows in _documents(batches, change):
            out = []
            for doc_id, words in rows:
                runs = runs_of(words, least, exponent)
                out.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapse(words, runs)).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), kind, pa.string()), strict=True)], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs, text).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest_runs(docs: DataFrame, change: Change | None = None, least: int = LEAST, exponent: int = EXPONENT, text: str = "text") -> DataFrame:
    """``periodic_runs`` as its strongest run and digests; the texts do not leave the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()] * 2
        for rows in _documents(batches, change):
            out = []
            for doc_id, words in rows:
                runs = runs_of(words, least, exponent)
                best = strongest(runs)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return id_text(docs, text).mapInArrow(run, DIGEST)
