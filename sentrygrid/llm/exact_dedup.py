"""Exact dedup over a cuckoo-filter index of live digests (operator 4).

A text's key is the SHA-256 of the text with every run of ``[\\x20\\x09-\\x0D]`` replaced by one space.
Keys are pre-aggregated per (digest, salt), dealt to index buckets by digest, and each bucket keeps

* a cuckoo filter of 16-bit fingerprints that answers "surely new" or "maybe seen", two bytes a slot, and
* the bucketed content, the only place of the full 32-byte digests, with the smallest doc_id and the number of rows.

A digest that the filter does not know is new and goes to the content unseen; a filter hit counts only after the full
digest is found there, so fingerprint clashes never merge texts.  A full filter is rebuilt at twice its size from the
keys of the content.  Digests can be deleted again (``maintain_index``), which a Bloom filter could not do.

Defined results: null text is the empty text; all empty texts are one group; of rows that repeat the same
doc_id and text one is kept; a null doc_id is kept only if its group has no other id; an empty table gives an
empty result; extra columns are ignored by ``dedup_groups`` and carried through by ``drop_duplicates``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.llm.common import WS_CLASS, buckets_for, hash_bucket, id_text, materialize

#: Digests that one bucket of the index holds on average: about 100 MB of Python objects at most.
DIGESTS_PER_BUCKET = 150_000
#: Rows of one digest after pre-aggregation, at most, whatever the size of its group.
SALTS = 16
#: Copies of a repeated row that are numbered at once.
REPEATS = 4096


class CuckooFilter:
    """Partial-key cuckoo hashing: four 16-bit fingerprints a bucket, two buckets a key.

    ``stored`` holds the live keys (any collection that the owner keeps up to date); the filter keeps marks alone."""

    SLOTS, KICKS, LOAD = 4, 500, 0.9

    def __init__(self, stored: dict | set, capacity: int = 1024):
        self.stored = stored
        self.resizes = self.held = 0
        self._allocate(capacity)

    def _allocate(self, capacity: int) -> None:
        need = max(2, int(capacity / (self.SLOTS * self.LOAD)) + 1)
        self.n = 1 << (need - 1).bit_length()
        self.table = array("H", bytes(2 * self.SLOTS * self.n))  # 0: an empty slot

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def _swap(self, place: int, old: int, new: int) -> bool:
        """Replace one mark of a bucket; False if it is not there."""
        for at in range(place * self.SLOTS, (place + 1) * self.SLOTS):
            if self.table[at] == old:
                self.table[at] = new
                return True
        return False

    def _place(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        if self._swap(a, 0, mark) or self._swap(b, 0, mark):
            return True
        for kick in range(self.KICKS):
            slot = a * self.SLOTS + kick % self.SLOTS
            mark, self.table[slot] = self.table[slot], mark
            a = self._other(a, mark)
            if self._swap(a, 0, mark):
                return True
        return False

    def _resize(self) -> None:
        """Fingerprints alone cannot be rehashed, so the table is filled anew from the stored keys."""
        while True:
            self.resizes += 1
            self._allocate(self.n * self.SLOTS * 2)
            if all(self._place(k) for k in self.stored):
                return

    def insert(self, key: bytes) -> None:
        """Mark a key that has just been stored and was not before."""
        self.held += 1
        if self.held > self.n * self.SLOTS * self.LOAD or not self._place(key):
            self._resize()

    def delete(self, key: bytes) -> None:
        """Unmark a key that has just been taken out of the store.  Only such keys: by a clashing mark another would be lost."""
        self.held -= 1
        mark, a, b = self._places(key)
        if not (self._swap(a, mark, 0) or self._swap(b, mark, 0)):
            raise KeyError(key)

    def maybe(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return any(mark in self.table[x * self.SLOTS : (x + 1) * self.SLOTS] for x in (a, b))


class IndexBucket:
    """One bucket of the index: the filter in front, and the content that it guards."""

    def __init__(self) -> None:
        self.content: dict[bytes, list] = {}
        self.live = CuckooFilter(self.content)

    def find(self, key: bytes) -> list | None:
        """What is held for a digest: the content is read on a hit of the filter alone."""
        return self.content.get(key) if self.live.maybe(key) else None

    def add(self, key: bytes, first: int | None, n: int) -> None:
        held = self.find(key)
        if held is None:
            self.content[key] = [first, n]
            self.live.insert(key)
        else:
            held[0] = min((x for x in (held[0], first) if x is not None), default=None)
            held[1] += n

    def remove(self, key: bytes) -> None:
        if self.find(key) is not None:
            del self.content[key]
            self.live.delete(key)

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys = list(self.content)
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            columns = [pa.array(part, pa.binary()), *(pa.array([self.content[k][c] for k in part], pa.int64()) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "keep_id", "group_size"])


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS_CLASS}+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text), 256))


INDEX = "digest binary, keep_id long, group_size long"


def _index_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: rows (digest, first_id, n) to one row per digest, through the filter."""
    bucket = IndexBucket()
    for batch in batches:
        for key, first, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "first_id", "n")), strict=True):
            bucket.add(key, first, n)
    yield from bucket.rows()


def _changed_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: what was live (step 0), then for each changed digest a null count that takes it out (step 1) and its new rows (step 2)."""
    bucket = IndexBucket()
    for batch in batches:
        for key, first, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "first_id", "n")), strict=True):
            if n is None:
                bucket.remove(key)
            else:
                bucket.add(key, first, n)
    yield from bucket.rows()


def _combined(keys: DataFrame) -> DataFrame:
    """(doc_id, digest, n) to at most ``SALTS`` rows (digest, first_id, n) a digest, summed by tasks first."""
    return keys.groupBy("digest", hash_bucket(SALTS, "doc_id").alias("salt")).agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("n")).select("digest", "first_id", "n")


def build_index(keys: DataFrame, rows: int) -> DataFrame:
    """(doc_id, digest, n) to the index (digest, keep_id, group_size).  Map tasks and salts combine copies first."""
    return _combined(keys).repartition(buckets_for(rows, DIGESTS_PER_BUCKET) * 4, "digest").mapInArrow(_index_bucket, INDEX)


def maintain_index(live: DataFrame, changes: DataFrame, rows: int) -> DataFrame:
    """Apply inserts and deletions to live rows.

    ``live``: (doc_id, digest) of the rows indexed so far; ``changes``: (seq, op, doc_id, digest) with op
    ``insert`` or ``delete``, applied in the order of ``seq``.  Returns the index (digest, keep_id, group_size)
    of what is live afterwards; deleting what is not there changes nothing.

    Changes of one document and digest are summed in order, never below nothing, before digests meet their bucket, so
    that a digest with very many rows reaches it as ``SALTS`` rows."""
    held = live.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "digest").orderBy("seq")
    step = F.when(F.col("op") == "insert", 1).otherwise(-1)
    sums = changes.withColumn("sum", F.sum(step).over(order))
    folded = sums.groupBy("doc_id", "digest").agg(F.max_by("sum", "seq").alias("last"), F.min("sum").alias("lowest"))
    after = held.join(folded, held["doc_id"].eqNullSafe(folded["doc_id"]) & (held["digest"] == folded["digest"]), "full_outer").select(
        F.coalesce(held["doc_id"], folded["doc_id"]).alias("doc_id"), F.coalesce(held["digest"], folded["digest"]).alias("digest"),
        # x + last where no sum falls below nothing, else what follows the lowest point
        (F.coalesce("n", F.lit(0)) + F.coalesce("last", F.lit(0)) - F.least(F.lit(0), F.coalesce("n", F.lit(0)) + F.coalesce("lowest", F.lit(0)))).alias("n"),
    )
    touched = changes.select("digest").distinct()
    steps = [(0, _combined(held)), (1, touched.select("digest", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("n"))), (2, _combined(after.where("n > 0").join(touched, "digest", "left_semi")))]
    parts = [df.withColumn("step", F.lit(i)) for i, df in steps]
    dealt = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(buckets_for(rows, DIGESTS_PER_BUCKET) * 4, "digest")
    return dealt.sortWithinPartitions("step").mapInArrow(_changed_bucket, INDEX)


def dedup_groups(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    base = id_text(docs, text)
    keys = materialize(spark, base.select("doc_id", digest(F.col("text")).alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "dedup-keys")
    joined = keys.join(build_index(keys, keys.count()), "digest")
    # A row repeated n times comes back n times, its copies numbered in two levels: no array is longer than REPEATS or n / REPEATS.
    upto = lambda last: F.explode(F.sequence(F.lit(0), last))
    blocks = joined.withColumn("block", upto(F.floor((F.col("n") - 1) / REPEATS)))
    copies = blocks.withColumn("copy", upto(F.least(F.col("n") - 1 - F.col("block") * REPEATS, F.lit(REPEATS - 1))))
    first = (F.col("block") == 0) & (F.col("copy") == 0)
    return copies.select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"))


def drop_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = dedup_groups(spark, docs, text).where("kept").select(F.col("doc_id").alias("__keep_id"), F.col("digest").alias("__keep_digest"))
    marked = docs.withColumn("__digest", digest(F.coalesce(docs[text], F.lit(""))))
    joined = marked.join(kept, marked["doc_id"].cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("__digest") == F.col("__keep_digest")))
    return joined.dropDuplicates(["__keep_id", "__keep_digest"]).select(*[joined[f"`{c}`"] for c in docs.columns])
