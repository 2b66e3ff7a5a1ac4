"""Language ID, BPE, sharding and media against brute force."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sentrygrid.llm import bpe, language_id, media, sharding, word_ids
from sentrygrid.llm.queries import tokenizer

DE = "der Hund und die Katze gehen nicht in den Garten weil es regnet und sie schlafen lieber auf dem Sofa"
EN = "the dog and the cat do not go into the garden because it rains and they would rather sleep on the sofa"


def test_language(spark):
    rows = [(i, f"{t} {i} " * (1 + i % 3), lang, "s") for i, (t, lang) in enumerate([(DE, "de"), (EN, "en")] * 30)]
    odd = [(900, None, "en", "s"), (901, "123 !!", "de", "s"), (902, "", None, "s"), (903, "the cat sleeps", None, "s"), (None, "the dog", "en", "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    profiles = language_id.fit(docs)
    assert set(profiles) == {"de", "en"} and all(len(v) <= language_id.PROFILE for v in profiles.values())
    got = {r.doc_id: r for r in language_id.identify(spark, docs, profiles).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "en" and 0 <= got[903].score <= 1
    kept = language_id.keep_identified(spark, docs, profiles)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2
    empty = docs.limit(0)
    assert language_id.fit(empty) == {} and language_id.identify(spark, empty, {}).count() == 0
    assert language_id.identify(spark, docs, {}).where("lang_pred <> 'und'").count() == 0


def test_ngrams_by_hand():
    grams, counts = language_id.ngrams("Ab, ab1")
    code = lambda s: sum((language_id.BORDER if c == "_" else ord(c)) << (21 * (len(s) - 1 - i)) for i, c in enumerate(s))
    want = {"a": 2, "b": 2, "_a": 2, "ab": 2, "b_": 2, "_ab": 2, "ab_": 2}
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code(k): v for k, v in want.items()}


def test_held_out_share_is_not_learned_from(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:10]
    docs = spark.createDataFrame([(i, EN, "xx") for i in ids], "doc_id long, text string, lang string")
    assert language_id.fit(docs) == {}


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = ["", "Hello world", "  two  spaces\n\n end ", "don't I'LL we're", "<|endoftext|>a<|endoftext|>", "tab\t\x1c\x85\xa0x", "日本語 😀 é", "x" * 2000, "ab" * 1500, "12345 67", "unbelievably antidisestablishmentarianism", " \n", None, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for r in bpe.encode_documents(df, tokenizer("byte_bpe_50k.json")).collect():
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == tok.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")
    assert bpe.digest_documents(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_trie_equals_plain_merging():
    codec = bpe.codec(tokenizer("byte_bpe_50k.json"))
    rng = np.random.default_rng(7)
    words = {bytes(rng.choice(list(b"abcdeinrst th"), int(n))) for n in rng.integers(1, 14, 400)} | {rng.bytes(5) for _ in range(50)}
    got = codec.encode_words(words)
    assert got == {w: [codec.id[t] for t in codec.merges(w)] for w in words}
    assert codec.decode(np.array([i for i in got[next(iter(words))]], "<u4").tobytes()) == next(iter(words)).decode("utf-8", "replace")


def winner(key, weights):
    u = [(int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for j in range(len(weights))]
    return min((-math.log(x) / w, j) for j, (x, w) in enumerate(zip(u, weights, strict=True)))[1]


def test_rendezvous(spark):
    rows = [(i, "té" * (i % 7)) for i in range(2000)] + [(5, "té" * 5), (None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    weights = [1.0, 1.0, 2.0, 4.0]
    got = sharding.assign_shards(spark, df, weights).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (winner(key, weights), winner(key, [*weights, 1.0])) and r.grown_shard in (r.shard, 4)
    share = np.bincount([r.shard for r in got]) / len(got)
    assert np.abs(share - np.array(weights) / 8).max() < 0.04
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    one = next(r for r in got if r.doc_id == 6)
    assert one.size == len(("té" * 6).encode()) + 16 and one.text_crc32 == zlib.crc32(("té" * 6).encode())
    assert sharding.assign_shards(spark, df.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(df["doc_id"], [])


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(spark, df, [1.0] * 3, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("shard = 1").count() == sum(winner(str(i), [1.0] * 3) == 1 for i in range(50))


def test_png_round_trip(spark):
    texts = ["", None, "a", "é" * 500, "line\n" * 3000, "same", "same", "x" * 192, "x" * 193]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.media_columns(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = rows[i]
        assert media.decode_png(r.media).tobytes() == padded and r.n_bytes == len(raw) and r.payload_bytes == len(padded)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.feature) == 16
    assert rows[5][1:] == rows[6][1:] and rows[0].feature == rows[1].feature
    assert media.media_columns(df.limit(0)).count() == 0


def test_damaged_png_is_refused():
    blob = media.encode_png(b"q" * 384)
    for at in (3, 20, len(blob) // 2, len(blob) - 2):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(blob[:-8])


def test_all_filters_are_undone():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (40, 30), dtype=np.uint8)

    def paeth(a, b, c):
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

    kinds = rng.integers(0, 5, 40)
    coded = np.zeros((40, 31), np.uint8)
    for y in range(40):
        coded[y, 0] = kinds[y]
        for x in range(30):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            coded[y, x + 1] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth(a, b, c)][kinds[y]]) % 256
    assert (media.unfilter_rows(coded, 3) == rows).all()
    head = struct.pack(">IIBBBBB", 10, 40, 8, 2, 0, 0, 0)
    blob = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(coded.tobytes())) + media._chunk(b"IEND", b"")
    assert (media.decode_png(blob).reshape(40, 30) == rows).all()


def test_cosine_hash_survives_small_changes():
    base = ("The quick brown fox jumps over the lazy dog. " * 200).encode()
    other = bytearray(base)
    other[1000] = ord("X")
    a, b = (int(media.cosine_hash(media.decode_png(media.encode_png(media.pad_payload(bytes(x))))), 16) for x in (base, other))
    assert (a ^ b).bit_count() <= 6


def test_long_words_and_unknown_tokenizers(tmp_path):
    """Words of hundreds of thousands of bytes take time with their length, and tokenizers that join words are refused."""
    rng = random.Random(2)
    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    words = ["".join(rng.choices("abcdefgh", k=bpe.LONG + d)) for d in (-1, 0, 1, 5000)] + ["語" * 3000, "ab" * 20_000]
    texts = [*words, " ".join(words), words[2] + " " + words[2]]
    got = bpe.TrieBpe(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    began = time.monotonic()
    bpe.TrieBpe(path).encode(["".join(rng.choices("abcdefgh", k=500_000))])
    assert time.monotonic() - began < 60
    with pytest.raises(ValueError, match="one by one"):
        word_ids.WordEncoder(path)


def test_ngrams_of_long_texts_equal_short_counts(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(3000)) + "12, !x"
    whole = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "PART", 37)
    parts = language_id.ngrams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_predictions_equal_brute_force(spark):
    """Profiles, out-of-place distances and scores by plain loops."""
    rng = random.Random(7)
    letters = {"aa": "abcde fgh", "bb": "xyzde fgh", "cc": "klmno pqé"}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.randint(5, 300))), lang) for i, lang in enumerate(rng.choices(list(letters), k=120))] + [(500, None, "aa"), (501, "12 34", "bb"), (502, "", None)]

    def grams(t):
        marked = "\x01" + re.sub("\x01+", "\x01", "".join(c if c.isalpha() else "\x01" for c in t.lower())).strip("\x01") + "\x01"
        out = Counter(c for c in marked if c != "\x01")
        out.update(marked[i : i + 2] for i in range(len(marked) - 1))
        out.update(marked[i : i + 3] for i in range(len(marked) - 2) if marked[i + 1] != "\x01")
        return out

    def best(counts):
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.PROFILE]

    learned = {}
    for d, t, lang in rows:
        if t and lang and zlib.crc32(str(d).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(grams(t) if any(c.isalpha() for c in t) else {})
    profiles = {lang: {g: r for r, g in enumerate(best(c))} for lang, c in learned.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark, df, language_id.fit(df)).collect()}
    for d, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert got[d] == ("und", 0.0)
            continue
        mine = best(grams(t))
        away = {lang: sum(min(abs(p[g] - r), language_id.PROFILE) if g in p else language_id.PROFILE for r, g in enumerate(mine)) for lang, p in profiles.items()}
        lang = min(sorted(away), key=away.get)
        score = 1 / sum(math.exp(-language_id.SHARPNESS * (a - away[lang]) / (language_id.PROFILE * len(mine))) for a in away.values())
        assert got[d][0] == lang and got[d][1] == pytest.approx(score)


def hash_by_hand(image):
    """The cosine hash by sums over every sample: block means of a 32 x 32 grid, then one cosine sum a frequency."""
    import math

    height, width, channels = image.shape
    grey = [[256 * sum(int(image[y, x, c]) for c in range(channels)) for x in range(width)] for y in range(height)]

    def shrink(lines):
        n = len(lines)
        if n < 32:
            return [lines[i * n // 32] for i in range(32)]
        cuts = [i * n // 32 for i in range(33)]
        return [[sum(lines[y][x] for y in range(a, b)) // (b - a) for x in range(len(lines[0]))] for a, b in zip(cuts, cuts[1:], strict=False)]

    turned = lambda m: [list(r) for r in zip(*m, strict=True)]
    small = turned(shrink(turned(shrink(grey))))
    cosine = [[math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    freq = [sum(small[y][x] * cosine[u][y] * cosine[v][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(freq[1:])[31]
    bits = [int(i > 0 and f > middle) for i, f in enumerate(freq)]
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, 64, 8)).hex(), freq, middle


def test_cosine_hash_by_hand():
    rng = np.random.default_rng(10)
    for size in (192, 192 * 3, 192 * 31, 192 * 40, 192 * 100):
        image = media.decode_png(media.encode_png(bytes(rng.integers(32, 127, size, dtype=np.uint8))))
        want, freq, middle = hash_by_hand(image)
        got = media.cosine_hash(image)
        close = [abs(f - middle) < 1e-3 * max(map(abs, freq[1:])) for f in freq]
        bits = lambda h: [int(b) for b in f"{int(h, 16):064b}"]
        assert all(a == b or c for a, b, c in zip(bits(got), bits(want), close, strict=True))
