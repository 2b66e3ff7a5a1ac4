"""Near-duplicate detection by SetSketch registers (operator 7).

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z) text.

1. Every set gets ``REGISTERS`` SetSketch registers: for each register the least of exponential hash values over the
   set, truncated to the exponent of base ``BASE``.  Registers of a union are the element-wise maximum.
2. Equal sets become one class, under a number of its own; only classes go on.  A class's text is that of its smallest row by
   id and text (``row_key``), so rows that share an id are told apart.
3. Each band of ``ROWS`` registers is a bucket key.  In a bucket every class is paired with the smallest one (its
   pivot), never all with all.  A pair's registers are compared jointly: the maximum-likelihood similarity given both
   set sizes and how many registers are larger, smaller and equal.  Pairs ``MARGIN`` below the threshold go.
4. Pairs are confirmed on the full sets, computed again from the texts: first each class with the pivot it shares most
   buckets with, which gives a forest whose trees are the components so far.
5. Classes whose best pivots are at all alike (``FAMILY``) form families.  In a family that still holds several
   components, the classes outside its largest component are compared by registers with that component and with each
   other; in buckets that hold several families, classes of different families are compared alike.  Groups are cut
   into blocks of about ``GROUP`` classes or ``BLOCK_BYTES`` of sets, and a task compares the registers of two blocks.
   Only classes with a likely pair of different components go on, each once for a pair of blocks, never the pairs
   themselves: a pair that shares several buckets counts in the one of its least band key.  A task then holds the full
   sets of two blocks, counts what each set shares with all sets of the other block by one sorted index of their
   members, and returns the links that join something new there.  Texts are thus repeated by blocks and not by pairs,
   and a true link inside a pair of blocks is left out only if it joins nothing new.
6. Components are the transitive closure of the confirmed links, named by their smallest doc_id at the end.

A pair at the threshold shares a bucket with probability 1 - 2e-5, more similar pairs with more.

Defined results: null text is the empty text; without words a document has no shingles and is linked with nothing;
with one to four words the whole sequence is the one shingle; equal sets are linked even if texts differ in white
space or case; repeated rows give repeated results; rows that share an id but not the text are separate documents, so that one
may stay and the other go; null ids join their class and name it only where it has no other; very long texts are read
whole, and one at a time by a task; an empty table gives an empty result; extra columns are ignored by ``find_components``
and carried through by ``drop_near_duplicates``, which keeps exactly one row of each component, and all rows without words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.llm.common import discard, id_text, materialize, row_key, salted_join, slices, text_buffers
from sentrygrid.llm.components import components, roots

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register.
BASE, RATE, LARGEST = 1.001, 20.0, 65535
#: Estimates this far below the threshold (about five standard errors) rule a pair out.
MARGIN = 0.15
#: Classes of a block and pairs of one pivot that one task confirms, about, and bytes of the sets of a block.
GROUP, BLOCK_BYTES = 1024, 32 << 20
#: Equal registers that a pair needs to be estimated at all: a pair at the threshold has about 150, with a deviation of 6.
EQUAL = 100
#: Likeness to the best pivot that makes a class one of its family.
FAMILY = 0.3

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _rng.integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_STEP, _UNSTEP)):
            one = np.full(size, base, np.uint64)
            one[0] = 1
            _powers[i] = np.multiply.accumulate(one)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts to their sets of 64-bit shingle hashes, ascending in each text, and the n + 1 offsets into them.

    Words are hashed from differences of a running polynomial over all bytes, so there is no loop over words."""
    n_docs = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    low = raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _steps(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(raw)], out=total[1:])
    words = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(offs, begin, side="right") - 1
    per = np.bincount(doc, minlength=n_docs)
    m = len(words) - SHINGLE + 1
    if m > 0:
        ok = np.flatnonzero(doc[:m] == doc[SHINGLE - 1 :])
        value = np.zeros(len(ok), np.uint64)
        for k in range(SHINGLE):
            value += words[ok + k] * _PLACE[k]
        owner = doc[ok]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)[:-1]])[short]
        whole = per[short].astype(np.uint64) * _STEP
        for k in range(SHINGLE - 1):
            has = per[short] > k
            whole[has] += words[first[has] + k] * _PLACE[k]
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    value = mix(value)
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    if len(value):
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(n_docs + 1))


def registers(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SetSketch registers, one row a non-empty set."""
    some = np.flatnonzero(np.diff(offs))
    starts, bare = offs[:-1][some], (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(some)), np.uint32)
    work = np.empty_like(bare)
    for i in range(REGISTERS):
        np.multiply(bare, _SCALE[i], out=work)
        work += _SHIFT[i]
        np.minimum.reduceat(work, starts, out=least[i])
    # the least of n uniform numbers u becomes the least of n exponential ones; then its exponent to the base
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 128) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows whose set sizes are known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, grid + 1)[None, :-1] * top + top / (2 * grid)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    p, q = chance(u - v * j), chance(v - u * j)
    fit = more[:, None] * np.log(p) + less[:, None] * np.log(q) + same[:, None] * np.log(np.clip(1 - p - q, 1e-12, 1))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def enough(common: int, a: int, b: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets, as ascending arrays, are similar enough."""
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    return enough(int((both[1:] == both[:-1]).sum()), len(x), len(y))


SKETCHED = "doc_id long, mark string, n_shingles long, digest binary, registers binary"


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            values, offs = shingle_sets(*text_buffers(part.column("text")))
            size = np.diff(offs)
            some = np.flatnonzero(size)
            digest: list[bytes | None] = [None] * len(size)
            sketch: list[bytes | None] = [None] * len(size)
            if len(some):
                starts = offs[:-1][some]
                one, two = np.add.reduceat(mix(values ^ _STEP), starts), np.add.reduceat(mix(values + _UNSTEP), starts)
                keys = np.stack([one, two, size[some].astype(np.uint64)], axis=1)
                for i, k, r in zip(some.tolist(), keys, registers(values, offs), strict=True):
                    digest[i], sketch[i] = k.tobytes(), r.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "mark", "n_shingles", "digest", "registers"])


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key a band for each row of registers."""
    split = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((mix(split + _STEP) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            ids = np.asarray(part.column("id"))
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(_rows(part.column("registers"))).ravel()), pa.array(np.repeat(ids, BANDS))], ["key", "id"])


LIKELY = NUMERATOR / DENOMINATOR - MARGIN


def _estimate(limit: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n_a, n_b = (np.asarray(part.column(c)).astype(float) for c in ("n_a", "n_b"))
                est = similarity(_rows(part.column("r_a")), _rows(part.column("r_b")), n_a, n_b)
                keep = pa.array(est >= limit)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(est[est >= limit])], ["a", "b", "est"])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``text`` by ``members``, the set as bytes."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            values, offs = shingle_sets(*text_buffers(part.column("text")))
            sets = [values[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "members"])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that each pivot (b null) comes before its partners: one set is held at a time."""
    held, pivot = None, np.zeros(0, np.uint64)
    for batch in batches:
        left, right = [], []
        for a, salt, b, members in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "members")), strict=True):
            mine = np.frombuffer(members, np.uint64)
            if b is None:
                held, pivot = (a, salt), mine
            elif held == (a, salt):
                if alike(pivot, mine):
                    left.append(a)
                    right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def _crossing(rows: list[tuple], same: bool, band: int | None = None) -> np.ndarray:
    """Which rows (left, id, component, size, registers) have a likely pair of another component in the other block, or in
    the same one: their positions.  With a ``band`` key, only pairs whose least shared key it is."""
    place, comps, sizes = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3))
    regs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
    keys = None if band is None else band_keys(regs)
    left, right = (np.arange(len(rows)),) * 2 if same else (np.flatnonzero(place), np.flatnonzero(place == 0))
    wanted = np.zeros(len(rows), bool)
    for at, i in enumerate(left.tolist()):
        fit = right[at + 1 :] if same else right
        fit = fit[(comps[fit] != comps[i]) & (DENOMINATOR * np.minimum(sizes[i], sizes[fit]) >= NUMERATOR * np.maximum(sizes[i], sizes[fit]))]
        if wanted[i]:
            fit = fit[~wanted[fit]]  # two classes that both go on need no further reason
        fit = fit[(regs[fit] == regs[i]).sum(axis=1) >= EQUAL]
        if keys is not None and len(fit):
            least = np.where(keys[fit] == keys[i], keys[i], np.iinfo(np.int64).max).min(axis=1)
            fit = fit[least == band]
        if len(fit):
            est = similarity(np.broadcast_to(regs[i], (len(fit), REGISTERS)), regs[fit], np.full(len(fit), float(sizes[i])), sizes[fit].astype(float))
            fit = fit[est >= LIKELY]
            wanted[fit] = True
            wanted[i] |= len(fit) > 0
    return np.flatnonzero(wanted)


def _by_blocks(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int, int], list[tuple]]]:
    """The rows of each pair of blocks (group, l, r), which lie together: two blocks are held at a time."""
    held: list[tuple] = []
    key = (0, 0, 0)
    for batch in batches:
        for group, l, r, *row in zip(*(batch.column(c).to_pylist() for c in ["group", "l", "r", *columns]), strict=True):
            if held and key != (group, l, r):
                yield key, held
                held = []
            key = (group, l, r)
            held.append(tuple(row))
    if held:
        yield key, held


NEEDED = "group long, l int, r int, left boolean, id long"


def _block_pairs(banded: bool):
    """The classes that have a likely pair in a pair of blocks: at most the rows that came in.  ``banded``: groups are band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, l, r), rows in _by_blocks(batches, ["left", "id", "component", "n_shingles", "registers"]):
            found = [rows[i] for i in _crossing(rows, l == r, group if banded else None).tolist()]
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * n, pa.int64()), pa.array([l] * n, pa.int32()), pa.array([r] * n, pa.int32()), pa.array([x[0] for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.int64())],
                ["group", "l", "r", "left", "id"],
            )

    return run


def _compared(spark: SparkSession, members: DataFrame, per: DataFrame, reps: DataFrame, banded: bool, tag: str) -> DataFrame:
    """The classes that have a likely pair of another component in their group, for each pair of blocks where they have one.

    ``members``: (group, id, component, inner); ``per``: (group, nb_g, nb_s), the numbers of blocks of inner members,
    which are not compared with each other, and of the others.  Inner blocks have codes below 0."""
    rows = salted_join(members, per, ["group"], "id")
    code = F.when(F.col("inner"), -1 - F.pmod(F.xxhash64("id"), F.col("nb_g"))).otherwise(F.pmod(F.xxhash64("id"), F.col("nb_s"))).cast("int")
    rows = rows.withColumn("code", code)
    outer, core = F.sequence(F.lit(0), F.col("nb_s") - 1), F.when(F.col("nb_g") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("nb_g") - 1, F.lit(0))), lambda j: -1 - j)).otherwise(F.array().cast("array<int>"))
    others = F.when(F.col("inner"), outer).otherwise(F.concat(outer, core))
    rows = rows.select("group", "id", "component", "code", F.explode(others).alias("other"))
    rows = rows.select("group", F.least("code", "other").alias("l"), F.greatest("code", "other").alias("r"), (F.col("code") <= F.col("other")).alias("left"), "id", "component")
    full = reps.select("id", "n_shingles", "registers").hint("merge").join(rows, "id").select("group", "l", "r", "left", "id", "component", "n_shingles", "registers")
    dealt = full.repartition("group", "l", "r").sortWithinPartitions("group", "l", "r", "id")
    return materialize(spark, dealt.mapInArrow(_block_pairs(banded), NEEDED), tag)


def _linked(rows: list[tuple], same: bool) -> list[tuple[int, int]]:
    """Links (u, v) between the full sets of two blocks, or within one, that join different components: rows (left, id, component, set)."""
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(x) for x in sets], np.int64)
    right = [i for i, r in enumerate(rows) if same or not r[0]]
    if not right:
        return []
    values, owners = np.concatenate([sets[i] for i in right]), np.repeat(np.array(right, np.int32), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    links = []
    for i, (left, doc, comp, _) in enumerate(rows):
        if not (same or left):
            continue
        low = np.searchsorted(values, sets[i], "left")
        n = np.searchsorted(values, sets[i], "right") - low
        common = np.bincount(owners[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(rows))
        fit = np.flatnonzero((common > 0) & (DENOMINATOR * common >= NUMERATOR * (sizes[i] + sizes - common)))
        for j in fit.tolist():
            a, b = find(comp), find(rows[j][2])
            if a != b:
                links.append((doc, rows[j][1]))
                root[max(a, b)] = min(a, b)
    return links


def _new_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, l, r), rows in _by_blocks(batches, ["left", "id", "component", "members"]):
        links = _linked(rows, l == r)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])


def _read(texts: tuple[DataFrame, DataFrame], wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, ...) with the texts of its classes: from (mark, text) and (id, mark)."""
    rows, marks = texts
    return rows.hint("merge").join(wanted.join(marks, "id"), "mark")


def _joining(spark: SparkSession, needed: DataFrame, comps: DataFrame, texts: tuple[DataFrame, DataFrame], tag: str) -> DataFrame:
    """The links on full sets among the classes of ``_compared`` that, within their pair of blocks, join something new: edges (u, v)."""
    named = needed.join(comps, "id", "left").select("group", "l", "r", "left", "id", F.coalesce("component", "id").alias("component"))
    named = materialize(spark, named, f"{tag}-needed")
    sets = _read(texts, named).select("group", "l", "r", "left", "id", "component", "text").mapInArrow(_sets, "group long, l int, r int, left boolean, id long, component long, members binary")
    dealt = sets.repartition("group", "l", "r").sortWithinPartitions("group", "l", "r", "id")
    return materialize(spark, dealt.mapInArrow(_new_links, "u long, v long"), tag)


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / GROUP), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("int")


def _family_pairs(spark: SparkSession, families: DataFrame, comps: DataFrame, reps: DataFrame) -> DataFrame:
    """Classes with likely pairs of different components within families: those outside the largest component with it and with each other."""
    placed = families.join(comps.withColumnRenamed("component", "found"), "id", "left").join(reps.select("id", "n_shingles"), "id")
    placed = materialize(spark, placed.select(F.col("family").alias("group"), "id", F.coalesce("found", "id").alias("component"), "n_shingles"), "families-placed")
    sizes = placed.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    per = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "component", "s")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    per = per.select("group", F.col("top.component").alias("largest"), _blocks(F.col("top.n"), F.col("top.s")).alias("nb_g"), _blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("nb_s"))
    members = salted_join(placed, per.select("group", "largest"), ["group"], "id").select("group", "id", "component", (F.col("component") == F.col("largest")).alias("inner"))
    return _compared(spark, members, per.select("group", "nb_g", "nb_s"), reps, False, "family-needed")


def _bucket_pairs(spark: SparkSession, buckets: DataFrame, families: DataFrame, reps: DataFrame) -> DataFrame:
    """Classes with likely pairs of different families within one bucket."""
    member = buckets.join(families, "id", "left").join(reps.select("id", "n_shingles"), "id")
    member = materialize(spark, member.select(F.col("key").alias("group"), "id", F.coalesce("family", "id").alias("component"), F.lit(False).alias("inner"), "n_shingles"), "bucket-families")
    mixed = member.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("lo != hi")
    return _compared(spark, member.drop("n_shingles"), mixed.select("group", F.lit(0).alias("nb_g"), _blocks(F.col("n"), F.col("s")).alias("nb_s")), reps, True, "bucket-needed")


def _likely(spark: SparkSession, pairs: DataFrame, reps: DataFrame, tag: str, limit: float = LIKELY) -> DataFrame:
    """Distinct pairs (a, b) with their estimated similarity, without those below the limit."""
    sides = [reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")) for c in ("a", "b")]
    fit = DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b")
    sized = pairs.join(sides[1].hint("merge"), "b").join(sides[0].hint("merge"), "a").where(fit)
    return materialize(spark, sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_estimate(limit), "a long, b long, est double"), tag)


def _verified(spark: SparkSession, pairs: DataFrame, texts: tuple[DataFrame, DataFrame], tag: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    pairs = materialize(spark, pairs.select("a", "b"), f"{tag}-pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    partners = salted_join(pairs, groups, ["a"], "b").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", F.col("b").alias("id"))
    pivots = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    wanted = partners.unionByName(pivots)
    read = _read(texts, wanted).select("a", "salt", "b", "text").mapInArrow(_sets, "a long, salt int, b long, members binary")
    dealt = read.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(spark, dealt.mapInArrow(_confirm, "u long, v long"), tag)


def sketch(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, mark (of id and text), n_shingles, digest of the set, registers: a written table."""
    rows = id_text(docs, text)
    return materialize(spark, rows.select("doc_id", row_key(rows["doc_id"], rows["text"]).alias("mark"), "text").mapInArrow(_sketch, SKETCHED), "sketch")


def _found(spark: SparkSession, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The sketched rows with what names their component, ``first`` (doc_id, mark), null for rows without words; the marks that repeat."""
    rows = sketch(spark, docs, text)
    smallest = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min(smallest).alias("first"), F.min("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    reps = materialize(spark, classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so each class keeps its number; equal sets have equal registers
    repeated = rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    source = id_text(docs, text)
    source = source.select(row_key(source["doc_id"], source["text"]).alias("mark"), "text")
    if not repeated.isEmpty():  # rows that repeat id and text: one of them is read
        source = materialize(spark, source.dropDuplicates(["mark"]), "texts")
    texts = (source, reps.select("id", F.col("first.mark").alias("mark")))

    bands = reps.mapInArrow(_band, "key long, id long")
    shared = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot != other").select("key", "pivot")
    buckets = materialize(spark, bands.join(shared, "key"), "buckets")

    stars = buckets.where("id != pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    near = _likely(spark, best, reps, "best-likely", FAMILY)
    links = _verified(spark, near.where(F.col("est") >= LIKELY), texts, "links-best")
    comps = roots(spark, links.select(F.col("v").alias("id"), F.col("u").alias("parent")).distinct())
    families = materialize(spark, roots(spark, near.select(F.col("b").alias("id"), F.col("a").alias("parent"))).withColumnRenamed("component", "family"), "families")
    discard(spark, near)
    within = _joining(spark, _family_pairs(spark, families, comps, reps), comps, texts, "links-families")
    if not within.isEmpty():
        links = links.unionByName(within)
        comps = components(spark, links)
    links = links.unionByName(_joining(spark, _bucket_pairs(spark, buckets, families, reps), comps, texts, "links-buckets"))
    comps = components(spark, links)
    discard(spark, buckets, families)

    placed = reps.select("id", "digest", "first").join(comps, "id", "left").select("digest", "first", F.coalesce("component", "id").alias("component"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("least"))
    named = placed.join(firsts, "component").select("digest", F.col("least").alias("first"))
    return rows.select("doc_id", "mark", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "mark", "n_shingles", "first"), repeated


def find_components(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    found, _ = _found(spark, docs, text)
    out = found.select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component and all without words, with all their columns."""
    found, repeated = _found(spark, docs, text)
    kept = found.where(F.col("first").isNull() | (F.col("first.mark") == F.col("mark"))).select(F.col("mark").alias("__kept"), F.col("first").isNotNull().alias("__one")).distinct()
    mark = row_key(docs["doc_id"].cast("long"), F.coalesce(docs[text].cast("string"), F.lit("")))
    joined = docs.withColumn("__mark", mark).join(kept, F.col("__mark") == F.col("__kept"))
    if not repeated.isEmpty():
        several = joined.where("__one").dropDuplicates(["__mark"])
        joined = several.unionByName(joined.where("not __one"))
    return joined.drop("__mark", "__kept", "__one")
