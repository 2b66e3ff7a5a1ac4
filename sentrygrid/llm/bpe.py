"""Byte-level BPE by depth-first traversal of a trie of distinct words (operator 3).

Texts are cut into the tokenizer's pre-tokens.  The distinct unseen ones of a batch go into a byte trie.  Walking
it depth first, every node (a prefix) gets the last token of its encoding from the states of its ancestors: token
``t`` ends the encoding of a prefix when the rest of the prefix is encoded, ends in ``u`` and merging never joins
across the border of ``u`` and ``t``.  A prefix that many words share is thus encoded once, and a word's ids are
read back along the chain of last tokens.  Words of more than ``LONG`` bytes, which hardly share prefixes, are walked
one by one without nodes; time and memory grow with their length.  Workers keep a bounded cache of pre-tokens.

Defined results: null text is the empty text with no ids; the special string in a text becomes its own id, as the
library does by default; decoding replaces invalid UTF-8 as the library does; repeated rows give repeated results;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sentrygrid.llm.common import id_text, slices

# The byte-level pre-tokenizer's pattern and the characters that Unicode calls white space.
SPACES = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Texts in which white space is single (and not at an end) split at blanks into pieces that never interact.
UNEVEN = regex.compile(rf"^[{SPACES}]|[{SPACES}]$|[{SPACES}][{SPACES}]")
#: Pieces that a worker keeps the ids of; distinct words that one trie holds.
CACHE_PIECES, TRIE_WORDS = 700_000, 20_000
#: Bytes beyond which a word has no part in the trie and the cache.
LONG = 1000


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand = byte_characters()
        to_bytes = lambda t: bytes(stand[c] for c in t)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in stand for c in t)}
        # Inside, tokens are numbered by merge rank: the 256 bytes, then the merges in order.
        self.token: list[bytes] = [bytes([b]) for b in range(256)]
        self.rank = {t: i for i, t in enumerate(self.token)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            both = a + b
            if both not in self.rank:
                self.rank[both] = len(self.token)
                self.token.append(both)
                self.parts.append((self.rank[a], self.rank[b]))
            self.merge[self.rank[a], self.rank[b]] = self.rank[both]
        self.id = [vocab[t] for t in self.token]
        self.longest = max(map(len, self.token))
        ending: list[set[int]] = [set() for _ in range(256)]
        for t in self.token:
            ending[t[-1]].add(len(t))
        #: The lengths of tokens that end in each byte, longest first.
        self.lengths = [sorted(n, reverse=True) for n in ending]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = dict(zip(self.id, self.token, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        self.alone: dict[int, bool] = {}
        self.joins: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merges(self, word: bytes) -> list[int]:
        """Plain BPE: join the pair of lowest rank, again and again.  Only single tokens are checked this way."""
        out = list(word)
        while len(out) > 1:
            best, at = min((self.merge.get(p, 1 << 30), i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if best == 1 << 30:
                break
            out[at : at + 2] = [best]
        return out

    def _stands_alone(self, t: int) -> bool:
        if t not in self.alone:
            self.alone[t] = t < 256 or self.merges(self.token[t]) == [t]
        return self.alone[t]

    def _apart(self, u: int, t: int) -> bool:
        """Whether merging keeps the border between neighbours u and t: no pair of edge parts across it has a merge that comes before both parts' own."""
        key = u << 32 | t
        known = self.joins.get(key)
        if known is None:
            known = self._compare(u, t)
            if len(self.joins) < 2_000_000:
                self.joins[key] = known
        return known

    def _compare(self, u: int, t: int) -> bool:
        # Undo the later of the two tokens' last merges, step by step; a merge across the border that would have come
        # before the merge just undone (on the left also at the same time) would have been made.
        merge, parts = self.merge, self.parts
        before = 1 << 30
        while True:
            if merge.get((u, t), 1 << 30) < before:
                return False
            if u > t:
                if u < 256:
                    return True
                before, u = u, parts[u][1]
            else:
                if t < 256:
                    return True
                before, t = t + 1, parts[t][0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The token ids of distinct non-empty byte words."""
        out: dict[bytes, list[int]] = {}
        short: list[bytes] = []
        for w in words:
            if len(w) > LONG:
                out[w] = self._walk(w)
            else:
                short.append(w)
        for i in range(0, len(short), TRIE_WORDS):
            self._traverse(short[i : i + TRIE_WORDS], out)
        return out

    def _last(self, tail: bytes, depth: int, last: list[int]) -> int:
        """The last token of a prefix of ``depth`` bytes that ends in ``tail``, from the last tokens of all shorter ones."""
        rank, alone, joins, m = self.rank, self.alone, self.joins, len(tail)
        for n in self.lengths[tail[-1]]:
            if n > m:
                continue
            t = rank.get(tail[m - n :])
            if t is None or not (alone[t] if t in alone else self._stands_alone(t)):
                continue
            if n < depth:
                before = last[depth - n]
                apart = joins.get(before << 32 | t)
                if not (self._apart(before, t) if apart is None else apart):
                    continue
            return t
        raise ValueError("a single byte is always a token")

    def _back(self, last: list[int], depth: int) -> list[int]:
        got = []
        while depth:
            got.append(self.id[last[depth]])
            depth -= len(self.token[last[depth]])
        return got[::-1]

    def _walk(self, word: bytes) -> list[int]:
        last = [-1]
        for depth in range(1, len(word) + 1):
            last.append(self._last(word[max(0, depth - self.longest) : depth], depth, last))
        return self._back(last, len(word))

    def _traverse(self, words: list[bytes], out: dict[bytes, list[int]]) -> None:
        child: dict[int, int] = {}
        below: list[list[int]] = [[]]  # the bytes that lead on from each node
        ends: dict[int, bytes] = {}
        for w in words:
            node = 0
            for b in w:
                key = node << 8 | b
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(below)
                    below.append([])
                    below[node].append(b)
                node = nxt
            ends[node] = w
        longest, find = self.longest, self._last
        path = bytearray()
        last: list[int] = [-1]  # the last token of each prefix on the path
        todo: list[tuple[int, int, int]] = [(0, b, 0) for b in below[0]]
        while todo:
            parent, b, depth = todo.pop()
            del path[depth:], last[depth + 1 :]
            path.append(b)
            depth += 1
            node = child[parent << 8 | b]
            last.append(find(bytes(path[-longest:]), depth, last))
            if node in ends:
                out[ends[node]] = self._back(last, depth)
            for b in below[node]:
                todo.append((node, b, depth))

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        cut = {p: PATTERN.findall(p) for p in pieces}
        held = self.words
        unseen = {w.encode(): w for ws in cut.values() for w in ws if w not in held}
        fresh = {unseen[w]: np.array(ids, "<u4").tobytes() for w, ids in self.encode_words(unseen).items()}
        if len(held) + len(fresh) <= CACHE_PIECES:
            held |= {w: ids for w, ids in fresh.items() if len(w) <= LONG}
        return {p: b"".join([fresh[w] if w in fresh else held[w] for w in ws]) for p, ws in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str]] = []
        for text in texts:
            pieces: list[str] = []
            for seg in self.split_special.split(text) if self.split_special else [text]:
                if seg in self.special:
                    pieces.append(seg)
                elif seg and UNEVEN.search(seg):
                    pieces += PATTERN.findall(seg)
                elif seg:
                    head, *rest = seg.split(" ")
                    pieces.append(head)
                    pieces += [" " + x for x in rest]
            split.append(pieces)
        unseen = set().union(*split) - self.cache.keys() - self.special.keys()
        fresh = self._learn(unseen) | {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        held = self.cache
        if len(held) + len(fresh) <= CACHE_PIECES:
            odd = {p: ids for p, ids in fresh.items() if len(p) > LONG}
            held |= {p: ids for p, ids in fresh.items() if len(p) <= LONG} if odd else fresh
            if not odd:
                get = held.__getitem__
                return [b"".join(map(get, ps)) for ps in split]
        return [b"".join([fresh[p] if p in fresh else held[p] for p in ps]) for ps in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


_codecs: dict[str, TrieBpe] = {}


def codec(path: str) -> TrieBpe:
    """One codec a worker and file; it outlives tasks where Spark reuses workers."""
    if path not in _codecs:
        _codecs[path] = TrieBpe(path)
    return _codecs[path]


def _run(path: str, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(part.column("text").to_pylist()), strict=True):
                    text = bpe.decode(ids)
                    rows.append((doc, len(ids) // 4, *([ids, text] if keep_ids else [hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()])))
                types = [pa.int64(), pa.int64(), *([pa.binary(), pa.string()] if keep_ids else [pa.string(), pa.string()])]
                names = ["doc_id", "n_tokens", *(["ids", "decoded"] if keep_ids else ["ids_sha256", "decoded_sha256"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text of every whole text."""
    return id_text(docs, text).mapInArrow(_run(tokenizer_path, True), "doc_id long, n_tokens long, ids binary, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text; the ids themselves stay in the task."""
    return id_text(docs, text).mapInArrow(_run(tokenizer_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
