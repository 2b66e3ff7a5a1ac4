"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of whitespace-separated words.

The tokenizer must drop white space and split there before merging, so that a text's ids are its words' ids in order;
its file says so, and other tokenizers are refused.  A worker keeps the ids of words it has met, up to
``CACHE_WORDS``; unseen words go to the library in batches.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Words whose ids a Python worker keeps (about 250 bytes each); later words are encoded batch by batch.
CACHE_WORDS = 450_000
#: Word stems that it keeps besides.
CACHE_PARTS = 250_000
#: A word that is letters with trailing marks splits into exactly those two parts; both go to the library joined by spaces.
_SIMPLE = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]*)([.,;:!?%$#*&|)\\]}]*)")

# Pre-tokenizers that drop white space, and the pattern whose pieces are kept by a split that removes the rest.
DROPS_SPACE = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = lambda node, inside: (node or {}).get(inside) or ([node] if node else [])
        first = (steps(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
        pieces = first.get("pattern", {}).get("Regex") if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") else None
        if pieces != PIECES and first.get("type") not in DROPS_SPACE:
            raise ValueError(f"{path}: words may not be encoded one by one")
        lowers = any(n["type"] == "Lowercase" for n in steps(spec.get("normalizer"), "normalizers"))
        #: Whether letters and the marks after them are separate pieces that end in a token of their own.
        self.by_parts = pieces == PIECES and lowers and spec["model"].get("end_of_word_suffix") == "</w>"
        ends = [t.endswith("</w>") for t, _ in sorted(self.tok.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])]
        self.ends = np.array([*ends, *[False] * 64])
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Each part is one pre-token, so cutting after every word-end token gives the parts back."""
        out: dict[str, bytes] = {}
        for i in range(0, len(parts), 4000):
            some = parts[i : i + 4000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), (ends * 4).tolist()
                out |= zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True)
            else:
                out |= zip(some, self._whole(some), strict=True)
        return out

    def learn(self, unseen: set[bytes]) -> dict[bytes, bytes]:
        simple, odd = [], []
        for w in unseen:
            t = w.decode()
            m = _SIMPLE.fullmatch(t)
            if m and t and self.by_parts:
                simple.append((w, m[1].lower(), m[2]))  # the tokenizer lower-cases; these letters keep their number and kind
            else:
                odd.append((w, t))
        need = {p for _, a, b in simple for p in (a, b) if p} - self.parts.keys()
        fresh = self._encode_parts(sorted(need))
        if len(self.parts) < CACHE_PARTS:
            self.parts |= fresh
            fresh = self.parts
        else:
            fresh = fresh | {p: self.parts[p] for _, a, b in simple for p in (a, b) if p in self.parts}
        out = {w: (fresh[a] if a else b"") + (fresh[b] if b else b"") for w, a, b in simple}
        if odd:
            out |= zip((w for w, _ in odd), self._whole([t for _, t in odd]), strict=True)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
        split = [t.split() for t in texts]  # bytes.split() cuts at the six ASCII white-space characters only
        unseen = set().union(*split) - self.words.keys()
        fresh = self.learn(unseen) if unseen else {}
        if not fresh:
            known = self.words
        elif len(self.words) + len(fresh) <= CACHE_WORDS:
            self.words |= fresh
            known = self.words
        else:
            held = self.words
            return [b"".join([fresh[w] if w in fresh else held[w] for w in ws]) for ws in split]
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and tokenizer file; it outlives tasks where Spark reuses workers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
