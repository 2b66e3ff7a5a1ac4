"""Queries over a small table against their SQL, and the pipeline against a brute-force version."""

import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_dedup import brute
from test_scans import base_pii

from sentrygrid.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet' ORDER BY 1").fetchall()


def test_exact_query_equals_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLE_SQL['op4_exact_dedup']})").fetchall())
    got = sorted(tuple(r) for r in queries.op4_exact_dedup(spark, str(DATA)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_language_accuracy(spark, docs):
    lang = {d: x for d, _, x in docs}
    rows = queries.op2_language_id(spark, str(DATA)).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_pipeline_equals_brute_force(spark, docs):
    import corpus_pipeline

    kept = [(d, t) for d, t, _ in docs if t and any(c.isalpha() for c in t)]
    seen, unique = set(), []
    for d, t in kept:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if n not in seen:
            seen.add(n)
            unique.append((d, t))
    comp = brute(unique)
    left = [(d, t) for d, t in unique if comp[d][1] == d]

    def clean(t):
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base_pii(t)))
        out, at = [], 0
        merged = []
        for a, b, k in spans:
            if merged and merged[-1][1] > a:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
            else:
                merged.append((a, b, k))
        for a, b, k in merged:
            out += [t[at:a], f"<{k.upper()}>"]
            at = b
        return "".join(out) + t[at:]

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = {d: np.array([*tok.encode(clean(t), add_special_tokens=False).ids, 1], "<u4") for d, t in left}
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r.doc_id for r in rows} == set(want)
    for d, ids in want.items():
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert sum(n for _, n, _ in mine) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine)


def test_stages_keep_columns_with_extra_ones(spark, docs):
    import corpus_pipeline

    extra = spark.createDataFrame([(d, t, lang, "s", 1, "e", 2) for d, t, lang in docs[:60]] + [(None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, key string, id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, str(DATA))
        assert out.columns == extra.columns and 0 < out.count() <= 61


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
    return sorted(((r.doc_id, r.text, r.lang) for r in docs.collect()), key=str), corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))


def test_shared_ids_and_unlabelled_tables(spark):
    """Rows that share an id are separate documents, and a table without labels loses only rows without a letter."""
    import random

    rng = random.Random(2)
    alone, twin = (" ".join(rng.choices([f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], k=90)) for _ in range(2))
    near = " ".join([*twin.split()[:-1], "anders"])
    rows = [(7, alone, None, "s", 1), (7, twin, None, "s", 1), (3, near, None, None, None), (4, alone.replace(" ", "\n"), None, "s", 1), (5, None, None, "s", 1), (6, "12 34", None, "s", 1)]
    left, packed = staged(spark, rows)
    assert left == sorted([(4, alone.replace(" ", "\n"), None), (3, near, None)], key=str)
    assert {r.doc_id for r in packed.collect()} == {3, 4}


def test_empty_table(spark):
    left, packed = staged(spark, [])
    assert left == [] and packed.count() == 0
