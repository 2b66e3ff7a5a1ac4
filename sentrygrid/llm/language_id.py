"""Language identification by rank-order n-gram profiles (operator 2).

A text is lower-cased; runs of non-letters count as one border; its 1- to 3-grams that do not cross a border are
ranked by frequency.  A language's profile is such a ranking of its training texts.  The distance of a document to
a language is the sum of the out-of-place distances of its most frequent n-grams, ``PROFILE`` for an n-gram that
the profile lacks; the nearest language wins.

Profiles are fitted on a bounded sample: about ``FIT_ROWS`` texts of each of the ``LANGUAGES`` most frequent labels,
picked by a hash of the id among the labelled rows outside the held-out quarter.  Prediction reads whole texts and
nothing but texts; a long text is counted in parts of ``PART`` characters, so memory stays at a few times its length.

Defined results: null text, or text without a letter, is ``und`` with score 0; ties of frequency go by code point,
ties of distance by language name; with nothing to learn from every text is ``und``; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.llm.common import id_text, slices

UNDETERMINED = "und"
#: Stands for non-letters in n-grams; no letter has this code point.
BORDER = 1
#: N-grams in a profile; texts a language that the fit reads, about; sharpness of the score.
PROFILE, FIT_ROWS, SHARPNESS = 400, 2000, 60.0
#: Characters whose n-grams are counted at once.
PART = 1 << 18

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter; made once a worker."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a text, coded in 21 bits a character, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.full(len(codes) + 2, BORDER, np.uint32)
    c[1:-1] = np.where(letter, codes, BORDER)
    c = c[np.concatenate([[True], (c[1:] != BORDER) | (c[:-1] != BORDER)])]
    held: tuple[np.ndarray, np.ndarray] | None = None
    for i in range(0, len(c), PART):
        a = c[i : i + PART].astype(np.int64)
        b, d = (c[i + k : i + k + PART].astype(np.int64) for k in (1, 2))  # n-grams that start in this part
        two = (a[: len(b)] << 21) | b
        three = (two[: len(d)] << 21) | d
        part = _counted(np.concatenate([a[a != BORDER], two, three[b[: len(d)] != BORDER]]))
        if held is None:
            held = part
        else:
            every, place = np.unique(np.concatenate([held[0], part[0]]), return_inverse=True)
            held = every, np.bincount(place, weights=np.concatenate([held[1], part[1]])).astype(np.int64)
    return held


def top(grams: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent n-grams, most frequent first."""
    return grams[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang)
        self.grams = np.unique(np.array([g for v in by_lang.values() for g in v], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, np.array(by_lang[lang], np.int64))] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.langs:
            return UNDETERMINED, 0.0
        mine = top(grams, counts)
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != mine] = len(self.grams)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, PROFILE, np.minimum(np.abs(ranks - np.arange(len(mine))), PROFILE)).sum(axis=1)
        best = int(away.argmin())
        share = np.exp(-SHARPNESS * (away - away[best]) / (PROFILE * len(mine)))
        return self.langs[best], float(1 / share.sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum a task's n-gram counts by language before anything is shuffled."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams, counts = ngrams("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """A profile of at most ``PROFILE`` n-grams for each language of the labelled rows that are not held out: the model, whose
    size depends on the number of languages alone.  Without such rows it is empty."""
    usable = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    steps = 1 << 24
    quota = usable.groupBy("lang").agg(F.least(F.lit(float(steps)), F.floor(F.lit(float(steps * fit_rows)) / F.count("*")) + 1.0).cast("int").alias("quota"))
    chosen = usable.join(F.broadcast(quota), "lang")  # a row a language, like the model
    sample = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < F.col("quota")).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()  # PROFILE rows a language
    out: dict[str, list[int]] = {}
    for row in sorted(ranked, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def identify(spark: SparkSession, docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    held = spark.sparkContext.broadcast(profiles)  # PROFILE n-grams a language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(held.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [model.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs, text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns and the predicted language in ``lang``, where
    there is such a column: rows are judged where they lie, without a join.  Where no language was learned, texts with a
    letter stay as they are."""
    held = spark.sparkContext.broadcast(profiles)
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(held.value)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = part.column(text).to_pylist()
                if model.langs:
                    found = [model.predict(t)[0] for t in texts]
                    stays = [x != UNDETERMINED for x in found]
                    columns = [pa.array(found, c.type) if n == lang else c for n, c in zip(names, part.columns, strict=True)]
                else:
                    stays, columns = [any(map(str.isalpha, t or "")) for t in texts], part.columns
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, schema)
