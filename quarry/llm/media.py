"""Media columns: texts as PNG pictures in a binary column, read back and hashed.

A payload (UTF-8 bytes, filled up with spaces to a multiple of 192) becomes the
samples of an 8-bit RGB picture 64 pixels wide. The writer takes for each row
the filter (none, sub or up) with the smallest sum of signed differences; the reader checks the
signature, the checksum of every chunk and the sizes, inflates, and undoes
all five filters in numpy. The feature is a perceptual hash: the picture's grey
levels averaged to 32 x 32, their low-frequency cosine coefficients (8 x 8 without
the constant) compared with the median, as 16 hex digits.

Null text counts as empty and is stored as 192 spaces. Equal texts give equal pictures
and features. Repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import common

WIDTH, BYTES = 64, 3
ROW = WIDTH * BYTES
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1


def payload(text: bytes) -> bytes:
    """The text filled up with spaces to a positive multiple of a row."""
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: bytes) -> bytes:
    """A PNG whose samples, row by row, are ``samples``."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, BYTES:] -= rows[:, :-BYTES]
    up[1:] -= rows[:-1]
    forms = np.stack([rows, sub, up])
    best = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = forms[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """Kind and content of each chunk; ValueError where a checksum or size is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, out = 8, []
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"checksum of {kind!r}")
        out.append((kind, content))
        at += 12 + n
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND":
        raise ValueError("no header or end")
    return out


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filter of each line; lines are filter byte and filtered bytes, ``step`` the bytes of a pixel."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    if len(kinds) and kinds.max() > 2:
        return _by_waves(kinds, rows, step)
    subbed = np.flatnonzero(kinds == 1)
    if len(subbed):
        n = rows.shape[1]
        wide = rows[subbed].reshape(len(subbed), n // step, step)
        rows[subbed] = np.cumsum(wide, axis=1, dtype=np.uint8).reshape(len(subbed), n)
    for k in np.flatnonzero(kinds == 2).tolist():
        if k:
            rows[k] += rows[k - 1]
    return rows


def _by_waves(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """All five filters: pixels of one diagonal need earlier diagonals only, so each is undone at once."""
    high, wide = len(rows), rows.shape[1] // step
    given = rows.reshape(high, wide, step).astype(np.int16)
    out = np.zeros((high + 1, wide + 1, step), np.int16)
    for d in range(high + wide - 1):
        k = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - k
        left, above, corner = out[k + 1, x], out[k, x + 1], out[k, x]
        p = left + above - corner
        far = np.stack([np.abs(p - left), np.abs(p - above), np.abs(p - corner)])
        nearest = np.choose(far.argmin(axis=0), [left, above, corner])
        guess = np.choose(kinds[k].astype(np.int64)[:, None], [np.zeros_like(left), left, above, (left + above) >> 1, nearest])
        out[k + 1, x + 1] = (given[k, x] + guess) & 255
    return out[1:, 1:].reshape(high, -1).astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """The samples (height x bytes of a row) of an 8-bit RGB or grey PNG."""
    parts = chunks(data)
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or colour not in (0, 2) or interlace:
        raise ValueError("only 8-bit grey or RGB without interlace")
    step = 3 if colour == 2 else 1
    raw = zlib.decompress(b"".join(x for kind, x in parts if kind == b"IDAT"))
    if len(raw) != height * (width * step + 1):
        raise ValueError("wrong size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), step)


def _cosines(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(keep)[:, None] / (2 * n))


_DCT = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: low-frequency cosine coefficients against their median."""
    grey = samples.reshape(len(samples), -1, BYTES).mean(axis=2)
    edges = np.arange(32) * grey.shape[0] / 32
    low = edges.astype(int)
    high = np.maximum(np.ceil(edges + grey.shape[0] / 32).astype(int), low + 1)
    sums = np.vstack([np.zeros(grey.shape[1]), np.cumsum(grey, axis=0)])
    small = (sums[high] - sums[low]) / (high - low)[:, None]
    small = small.reshape(32, 32, -1).mean(axis=2)
    waves = (_DCT @ small @ _DCT.T).ravel()
    bits = waves > np.median(waves[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (a PNG) of each row's whole text."""
    common.prepare(docs.sparkSession)

    def make():
        def work(batch):
            texts = common.text_bytes(batch)
            media = pa.array([write_png(payload(t)) for t in texts], pa.binary())
            return {"doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": media}

        return work

    return common.map_steps(common.doc_texts(docs), make, "doc_id long, n_bytes long, media binary")


def featured(media: DataFrame) -> DataFrame:
    """What is read back from the pictures: sizes, digests and the feature of each."""
    common.prepare(media.sparkSession)

    def make():
        def work(batch):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in batch.column(2).to_pylist():
                samples = read_png(data)
                back = samples.tobytes()
                for k, v in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)), strict=True):
                    out[k].append(v)
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_steps(media.select("doc_id", "n_bytes", "media"), make, schema, "media")
