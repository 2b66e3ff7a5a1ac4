"""Packing token sequences into fixed windows by non-negative least squares over a length histogram (operator 1).

A document's ids (with an end id) are cut into full windows and a tail shorter than a window.  The histogram of
tail lengths, at most ``window`` - 1 numbers, goes to the driver, which

1. enumerates the combinations of two to ``DEPTH`` lengths that fill a window exactly,
2. solves for their repeat counts by non-negative least squares against the histogram, until the conditions of an optimum hold,
3. rounds the counts to the nearest number and places them, largest first, within what the histogram still holds; then
   solves again for what is left, ``ROUNDS`` times at most,
4. packs the residual lengths greedily, best fit in descending order, keeping windows that are nearly full, and
5. cuts what is left into powers of two, which fill windows without gaps.

Ids never move between tasks: pass one computes each piece's checksum for both outcomes of step 5, and only
narrow rows are numbered (two-level, per length and hash bucket) and mapped to sequences by the plan, whose size
depends on the window alone.  ``pack_sequences`` returns the sequences' ids themselves.

Defined results: null text is the empty text and packs as the end id alone; repeated rows are packed each;
an empty table gives an empty result; ties are broken by doc_id and checksum; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.llm.common import buckets_for, hash_bucket, id_text, materialize, slices, text_buffers

WINDOW, END_ID = 2048, 1
#: A greedily packed window may stay this much short of full.
SLACK = 0.01
#: Pull below which a solution is optimal, at least, and as a share of the most frequent length's count.
TOLERANCE, RELATIVE = 0.02, 1e-4
#: Solutions that are rounded and placed one after another, and the most lengths of a combination, 2 or 3: a plan takes time
#: with window ** (DEPTH - 1).
ROUNDS, DEPTH = 3, 3


# ---------------------------------------------------------------- the plan, from the histogram alone
def combinations(lengths: np.ndarray, window: int, deepest: int = DEPTH) -> np.ndarray:
    """Rows of three ascending lengths (0: unused) that add up to the window, all of them present."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    small = lengths[lengths * 2 <= window]
    two = small[present[window - small]]
    rows = [np.stack([np.zeros_like(two), two, window - two], axis=1)]
    if deepest >= 3:
        for a in lengths[lengths * 3 <= window]:
            b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
            b = b[present[window - a - b]]
            rows.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(rows)


def nnls(combos: np.ndarray, target: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """Minimise |A x - target|^2 over x >= 0, where column j of A counts the lengths of combination j, up to the optimality conditions:
    no combination's pull (the objective's fall per repeat) above ``tolerance``, and none of a used one below it.

    An active set: all combinations are priced by what is left of the histogram; for each length the one with the most pull that
    holds it joins the set; accelerated projected gradients, restarted where they turn back, solve for the set alone.
    A solution uses a few thousand combinations at most, so that its counts are worth rounding."""
    size = len(target)
    goal = target.astype(float)
    goal[0] = 0.0
    if tolerance is None:
        tolerance = max(TOLERANCE, RELATIVE * goal.max(initial=0.0))
    x, rest, active = np.zeros(len(combos)), goal.copy(), np.zeros(0, np.int64)

    def laid(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.bincount(columns.ravel(), np.repeat(counts, 3), size)
        out[0] = 0.0
        return out

    while len(combos):
        pull = rest[combos].sum(axis=1)
        wanted = np.flatnonzero(pull > tolerance)
        if not len(wanted) and np.abs(pull[x > 0]).max(initial=0.0) <= tolerance:
            break
        wanted = wanted[np.argsort(pull[wanted], kind="stable")]
        best = np.full(size, -1)
        best[combos[wanted].ravel()] = np.repeat(wanted, 3)  # the last, with the most pull, stays
        best[0] = -1
        active = np.union1d(active[(x[active] > 0) | (pull[active] > -tolerance)], best[best >= 0])
        columns = combos[active]
        norm = np.ones(len(active))
        for _ in range(8):
            norm = laid(columns, norm)[columns].sum(axis=1)
            steepest = np.linalg.norm(norm)
            norm /= steepest
        steepest *= 1.05
        z = ahead = x[active]
        speed, turn = 1.0, 0
        while True:
            moved = np.maximum(0.0, ahead + (goal - laid(columns, ahead))[columns].sum(axis=1) / steepest)
            if (ahead - moved) @ (moved - z) > 0:
                speed = 1.0
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            ahead, z, speed, turn = moved + (speed - 1) / faster * (moved - z), moved, faster, turn + 1
            if turn % 25 == 0:
                rest = goal - laid(columns, z)
                pull = rest[columns].sum(axis=1)
                if pull.max() <= tolerance / 2 and np.abs(pull[z > 0]).max(initial=0.0) <= tolerance / 2:
                    break
        x = np.zeros(len(combos))
        x[active] = z
    return x


@dataclass
class Plan:
    """``runs[l]``: (first ranks, first sequences, offsets), by rank, of tails of length l that stay whole; ``whole[l]``: how many.
    Tails beyond that are cut into powers of two, laid out one after another from sequence ``cut_from`` on."""

    window: int
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    whole: dict[int, int] = field(default_factory=dict)
    cut_from: int = 0
    bit_base: dict[int, int] = field(default_factory=dict)
    cut_base: dict[tuple[int, int], int] = field(default_factory=dict)
    sequences: int = 0


def make_plan(hist: dict[int, int], window: int = WINDOW, slack: float = SLACK, rounds: int = ROUNDS, deepest: int = DEPTH) -> Plan:
    left = np.zeros(window + 1, np.int64)
    for n, c in hist.items():
        left[n] = c
    shapes: list[tuple[list[int], int]] = []
    for _ in range(rounds):
        combos = combinations(np.flatnonzero(left), window, deepest)
        x = np.floor(nnls(combos, left.astype(float)) + 0.5).astype(np.int64)
        order = np.argsort(-x, kind="stable")[: np.count_nonzero(x)]
        if not len(order):
            break
        for parts, repeat in zip(combos[order].tolist(), x[order].tolist(), strict=True):
            parts = [p for p in parts if p]
            need = {p: parts.count(p) for p in parts}
            n = min(repeat, *(int(left[p]) // k for p, k in need.items()))
            if n > 0:
                shapes.append((parts, n))
                for p, k in need.items():
                    left[p] -= n * k
    # Residual lengths, best fit in descending order, on counts: open[s] lists the shapes with s tokens to spare.
    spare: dict[int, list[tuple[list[int], int]]] = {}
    sizes: list[int] = []  # sorted keys of spare

    def put(parts: list[int], n: int, room: int) -> None:
        if room not in spare or not spare[room]:
            spare[room] = []
            if room not in sizes:
                sizes.insert(int(np.searchsorted(sizes, room)), room)
        spare[room].append((parts, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        c = int(left[length])
        while c:
            at = int(np.searchsorted(sizes, length))
            if at < len(sizes):
                room = sizes[at]
                parts, n = spare[room].pop()
                if not spare[room]:
                    del spare[room]
                    sizes.pop(at)
                take = min(n, c)
                if n > take:
                    put(parts, n - take, room)
                put([*parts, length], take, room - length)
                c -= take
            else:
                k = min(c, window // length)
                put([length] * k, c // k, window - k * length)
                c -= c // k * k
    plan, cut = Plan(window), dict.fromkeys(hist, 0)
    for room, some in spare.items():
        full = window - room
        for parts, n in some:
            if room <= slack * window or full & (full - 1) == 0:
                shapes.append((parts, n))
            else:
                for p in parts:
                    cut[p] += n
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = dict.fromkeys(hist, 0)
    for parts, n in shapes:
        offset = 0
        for p in sorted(parts, reverse=True):
            runs.setdefault(p, []).append((used[p], plan.sequences, offset))
            used[p] += n
            offset += p
        plan.sequences += n
    plan.runs = {p: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for p, r in runs.items()}
    plan.whole, plan.cut_from = used, plan.sequences
    position = 0
    for bit in [1 << i for i in range(window.bit_length() - 2, -1, -1)]:
        plan.bit_base[bit], n = position, 0
        for length in sorted(cut):
            if length & bit:
                plan.cut_base[length, bit] = n
                n += cut[length]
        position += n * bit
    plan.sequences += -(-position // window)
    return plan


# ---------------------------------------------------------------- pass one: ids and checksums
def _bits(tail: int) -> list[int]:
    return [1 << i for i in range(tail.bit_length() - 1, -1, -1) if tail >> i & 1]


MEASURED = "doc_id long, doc_tokens long, n_full long, tail int, full_crc array<long>, tail_crc long, bit_crc array<long>"


def _measure(encode: Callable[[list[bytes]], list[bytes]] | None, path: str, window: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentrygrid.llm.word_ids import encoder

        to_ids = encode or encoder(path).encode
        step = window * 4
        for batch in batches:
            for part in slices(batch, "text", 3 << 20):
                raw, offs = text_buffers(part.column("text"))
                raw = raw.tobytes()
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), to_ids([raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    full, tail = divmod(n, window)
                    at, bits = full * step, []
                    for size in _bits(tail):
                        bits.append(zlib.crc32(ids[at : at + 4 * size]))
                        at += 4 * size
                    rows.append((doc, n, full, tail, [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(full)], zlib.crc32(ids[full * step :]) if tail else None, bits, *([ids] if keep_ids else [])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), *([pa.binary()] if keep_ids else [])]
                names = [x.split()[0] for x in MEASURED.split(", ")] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


# ---------------------------------------------------------------- pass two: numbering and assignment
def _ranked(measured: DataFrame, rows: int) -> DataFrame:
    """Add ``tail_rank`` (among tails of that length) and ``full_rank`` (full windows before this document's), from counts per bucket."""
    dealt = measured.withColumn("bucket", hash_bucket(buckets_for(rows), "doc_id", "tail_crc"))
    per = dealt.groupBy("bucket", "tail").agg(F.count("*").alias("n"), F.sum("n_full").alias("f"))
    fulls = per.groupBy("bucket").agg(F.sum("f").alias("f"))
    full_start = fulls.select("bucket", F.coalesce(F.sum("f").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_start"))
    tail_start = per.select("bucket", "tail", F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tail_start"))
    starts = tail_start.join(full_start, "bucket")
    by_doc = Window.partitionBy("bucket").orderBy("doc_id", "tail_crc", "doc_tokens")
    by_tail = Window.partitionBy("bucket", "tail").orderBy("doc_id", "tail_crc", "doc_tokens")
    before = F.sum("n_full").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_full")
    numbered = dealt.withColumn("full_rank", before).withColumn("tail_rank", F.row_number().over(by_tail) - 1)
    return numbered.join(starts, ["bucket", "tail"]).withColumn("full_rank", F.col("full_rank") + F.col("full_start")).withColumn("tail_rank", F.col("tail_rank") + F.col("tail_start")).drop("bucket", "full_start", "tail_start")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _assign(plan_of: Callable[[], Plan], full_total: int, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of()
        w = plan.window
        names = ["doc_id", "doc_tokens", "n_full", "tail", "full_crc", "tail_crc", "bit_crc", "full_rank", "tail_rank"] + ["ids"] * keep_ids
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                batch, out = big.slice(lo, 2000), []
                for doc, tokens, n_full, tail, full_crc, tail_crc, bit_crc, full_rank, tail_rank, *ids in zip(*(batch.column(c).to_pylist() for c in names), strict=True):

                    def piece(start: int, length: int, crc: int, seq: int, offset: int, doc=doc, tokens=tokens, ids=ids) -> None:
                        out.append((doc, start, length, crc, tokens, seq, offset, *([ids[0][4 * start : 4 * (start + length)]] if ids else [])))

                    for i in range(n_full):
                        piece(i * w, w, full_crc[i], full_rank + i, 0)
                    if not tail:
                        continue
                    whole = plan.whole[tail]
                    if tail_rank < whole:
                        first, seq, offset = plan.runs[tail]
                        k = int(np.searchsorted(first, tail_rank, side="right")) - 1
                        piece(n_full * w, tail, tail_crc, full_total + int(seq[k]) + tail_rank - int(first[k]), int(offset[k]))
                    else:
                        at = n_full * w
                        for bit, crc in zip(_bits(tail), bit_crc, strict=True):
                            position = plan.bit_base[bit] + (plan.cut_base[tail, bit] + tail_rank - whole) * bit
                            piece(at, bit, crc, full_total + plan.cut_from + position // w, position % w)
                            at += bit
                types = [pa.int64()] * 7 + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids)

    return run


def pack_pieces(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", encode: Callable | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence; ``keep_ids`` adds the ids themselves."""
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    schema = MEASURED + (", ids binary" if keep_ids else "")
    measured = materialize(spark, id_text(docs, text).mapInArrow(_measure(encode, tokenizer_path, window, end_id, keep_ids), schema), "packing")
    hist = {r["tail"]: (r["n"], r["f"]) for r in measured.groupBy("tail").agg(F.count("*").alias("n"), F.sum("n_full").alias("f")).collect()}  # at most `window` rows
    plan = make_plan({t: n for t, (n, _) in hist.items() if t}, window)
    held = spark.sparkContext.broadcast(plan)  # its size depends on the window, not on the corpus
    ranked = _ranked(measured, sum(n for n, _ in hist.values()))
    return ranked.mapInArrow(_assign(lambda: held.value, sum(f for _, f in hist.values()), keep_ids), PIECES + (", ids binary" if keep_ids else ""))


def pack_sequences(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", encode: Callable | None = None) -> DataFrame:
    """One row per sequence: its ids (little-endian unsigned 32-bit) and its pieces in order."""
    pieces = pack_pieces(spark, docs, tokenizer_path, window, end_id, text, encode, keep_ids=True)
    listed = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))  # at most `window` pieces
    rows = pieces.groupBy("sequence_id").agg(listed.alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("pieces", lambda p: F.struct(p["offset"], p["doc_id"], p["start"], p["length"])).alias("pieces"))
