"""Binary media columns: PNG write and read, and low-frequency cosine hashes (operator 10).

Payload bytes become 8-bit RGB samples of an image 64 pixels (192 bytes) wide.  The writer picks the filter None, Sub
or Up per row by the least sum of absolute differences (the reader knows all five), deflates the rows and frames them as
length / type / data / CRC chunks.  The reader checks the signature and every CRC, inflates the IDAT chunks and
undoes the filters with numpy.  The hash takes the 8 x 8 lowest frequencies of an integer cosine transform of
the 32 x 32 grey image, so it is the same on every machine.

Defined results: null text is the empty text (a payload of 192 spaces); equal texts give equal values; a broken
chunk raises ``ValueError``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentrygrid.llm.common import id_text, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes a row of 64 RGB pixels.
ROW = 192
CHANNELS = 3
#: Bytes that an IDAT chunk holds at most.
CHUNK = 1 << 16
#: Integer cosine basis of the eight lowest frequencies over 32 samples.
BASIS = np.rint(4096 * np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)).astype(np.int64)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray) -> np.ndarray:
    """(h, width) bytes to (h, 1 + width): filter type and filtered bytes, None, Sub or Up by least absolute sum."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, CHANNELS:] = rows[:, :-CHANNELS]
    up[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = tried[kind, np.arange(rows.shape[0])]
    return out


def unfilter_rows(data: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five PNG filters.  Runs of rows of one kind go together where the kind allows it."""
    kinds, out = data[:, 0], data[:, 1:].copy()
    h, w = out.shape
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, h], strict=True):
        kind = int(kinds[a])
        if kind == 1:
            part = out[a:b].reshape(b - a, w // bpp, bpp)
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for r in range(a, b):
                above = (out[r - 1] if r else np.zeros(w, np.uint8)).astype(np.int32)
                row = out[r]
                for x in range(0, w, bpp):  # each pixel needs the one before it; its channels go together
                    here = slice(x, x + bpp)
                    prior = row[x - bpp : x].astype(np.int32) if x else np.zeros(bpp, np.int32)
                    if kind == 3:
                        guess = (prior + above[here]) >> 1
                    else:
                        corner = above[x - bpp : x] if x else np.zeros(bpp, np.int32)
                        p = prior + above[here] - corner
                        da, db, dc = np.abs(p - prior), np.abs(p - above[here]), np.abs(p - corner)
                        guess = np.where((da <= db) & (da <= dc), prior, np.where(db <= dc, above[here], corner))
                    row[here] = (row[here] + guess) & 255
        elif kind:
            raise ValueError(f"unknown filter {kind}")
    return out


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """Bytes (a positive multiple of 192) as an RGB image."""
    if not payload or len(payload) % ROW:
        raise ValueError("payload must be a positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    packed = zlib.compress(filter_rows(rows).tobytes(), level)
    head = struct.pack(">IIBBBBB", ROW // CHANNELS, len(rows), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def decode_png(blob: bytes) -> np.ndarray:
    """(height, width, channels) samples of an 8-bit grey, RGB, grey-alpha or RGBA image; checks every chunk."""
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while True:
        if at + 12 > len(blob):
            raise ValueError("truncated PNG")
        (n,) = struct.unpack_from(">I", blob, at)
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("only 8-bit images without palette or interlace")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != head[1] * (1 + head[0] * channels):
        raise ValueError("image data has the wrong size")
    return unfilter_rows(raw.reshape(head[1], 1 + head[0] * channels), channels).reshape(head[1], head[0], channels)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest frequencies lie above their median (the mean level aside)."""
    grey = image.astype(np.int64).sum(axis=2)

    def shrink(x: np.ndarray) -> np.ndarray:
        n = x.shape[0]
        if n < 32:
            return x[np.arange(32) * n // 32]
        cuts = np.arange(33) * n // 32
        return np.add.reduceat(x, cuts[:-1], axis=0) // np.diff(cuts)[:, None]

    small = shrink(shrink(grey * 256).T).T
    freq = (BASIS @ small @ BASIS.T).ravel()
    bits = freq > np.sort(freq[1:])[31]
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def pad_payload(raw: bytes) -> bytes:
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\x20")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(with_media: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    blob = encode_png(pad_payload(raw))
                    image = decode_png(blob)
                    back = image.tobytes()
                    rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(image), *([blob] if with_media else [])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if with_media else [])]
                names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * with_media
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def media_columns(docs: DataFrame, text: str = "text", with_media: bool = True) -> DataFrame:
    """Store every whole text as a PNG, read it back and describe it; ``media`` holds the stored bytes."""
    return id_text(docs, text).mapInArrow(_store(with_media), SCHEMA + (", media binary" if with_media else ""))
