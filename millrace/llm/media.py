"""Bytes in media columns: PNG images, their checks, and cosine-transform hashes.

A payload becomes an 8-bit grey PNG, 64 samples wide. Reading checks the signature, every chunk's
CRC and the sizes, inflates the image data and undoes the row filters with numpy. Each row is written under
the one of the five filters that leaves the least sum of absolute differences. The hash is the sign pattern of the 8 x 8
lowest frequencies of the image's cosine transform against their median: 64 bits, kept as binary.

Defined results: a null or empty text is one row of zero samples; equal texts give equal values;
repeated rows are stored each; a text of any length is one image; an empty table gives no rows; a null doc_id is kept; other columns are ignored. A damaged
image raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import arrow_rows, ids_as_long, ids_as_text, materialise

WIDTH, LEVEL = 64, 6
#: The PNG signature.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Most bytes of image data in one chunk.
CHUNK = 1 << 20
#: Rows that are filtered, or undone, at once.
ROWS = 1 << 14
_GRID, _LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(_GRID) + 1)[None, :] * np.arange(_LOW)[:, None] / (2 * _GRID))


def padded(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes filled with zeros to a positive multiple of the width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % width if raw else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """PNG's fifth guess: of the three neighbours the one nearest to left + up - corner, in this order where equal."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray) -> np.ndarray:
    """The rows of a grey image, each under the filter whose differences, taken as signed, have the least sum of absolute
    values (of equal ones the first); the filter's number stands before the row."""
    now = rows.astype("int16")
    up = np.zeros_like(now)
    up[1:] = now[:-1]
    left, corner = np.zeros_like(now), np.zeros_like(now)
    left[:, 1:], corner[:, 1:] = now[:, :-1], up[:, :-1]
    guesses = [0 * now, left, up, (left + up) >> 1, _nearest(left, up, corner)]
    made = np.stack([(now - g).astype("u1") for g in guesses])
    kinds = np.abs(made.view("i1").astype("int16")).sum(2, dtype="int64").argmin(0)
    out = np.empty((len(rows), rows.shape[1] + 1), "u1")
    out[:, 0] = kinds
    out[:, 1:] = made[kinds, np.arange(len(rows))]
    return out


def write_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """The grey image whose rows are the payload's stretches of ``width`` bytes."""
    rows = np.frombuffer(payload, "u1").reshape(-1, width)
    packer = zlib.compressobj(level, zlib.DEFLATED, zlib.MAX_WBITS, 9)
    data = b"".join(packer.compress(part.tobytes()) for part in _filtered_parts(rows)) + packer.flush()
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _filtered_parts(rows: np.ndarray) -> Iterator[np.ndarray]:
    """``filtered``, for ``ROWS`` rows at a time."""
    for at in range(0, len(rows), ROWS):
        before = min(at, 1)
        yield filtered(rows[at - before : at + ROWS])[before:]


def unfilter(lines: np.ndarray, step: int = 1, first: np.ndarray | None = None) -> np.ndarray:
    """Samples of filtered rows; the first byte of a row names its filter, ``step`` is the number of bytes of
    a pixel, ``first`` marks the first row of each image (of one image, if it is not given).

    A row whose filter does not look up, or an image's first, begins a strip. A sample needs only its left,
    upper and upper left neighbours, so in all strips together the samples on one diagonal are undone at once.
    """
    kinds, width = lines[:, 0].astype("int64"), lines.shape[1] - 1
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG row filter")
    n, padding = len(lines), step
    if not n:
        return lines[:, 1:].copy()
    top = np.zeros(n, bool)
    top[0] = True
    if first is not None:
        top |= first
    begins = np.flatnonzero(top | (kinds < 2))
    depth = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    # a frame of zeros: row 0, and ``step`` columns on the left
    framed = np.zeros((n + 1, width + padding), "int16")
    framed[1:, padding:] = lines[:, 1:]
    if (kinds < 2).all() and step == 1:
        sub = 1 + np.flatnonzero(kinds == 1)
        framed[sub, 1:] = np.cumsum(framed[sub, 1:], axis=1, dtype="u1")
        return framed[1:, 1:].astype("u1")
    flat, wide = framed.ravel(), width + padding
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    here = (order + 1) * wide + padding
    above = np.where(top[order], 0, order) * wide + padding
    kind = kinds[order]
    groups = -(-width // step)  # pixels of a row
    for diagonal in range(int(depth.max()) + groups):
        rows = slice(ends[max(0, diagonal - groups + 1)], ends[min(diagonal, len(ends) - 2) + 1])
        column = (diagonal - depth[order[rows]]) * step
        for s in range(step):
            at, over = here[rows] + column + s, above[rows] + column + s
            left, up, corner = flat[at - step], flat[over], flat[over - step]
            guess = np.choose(kind[rows], [0 * left, left, up, (left + up) >> 1, _nearest(left, up, corner)])
            flat[at] = (flat[at] + guess) & 255
    return framed[1:, padding:].astype("u1")


def png_lines(data: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit grey image without interlace, each after its filter's number."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, size, ended = 8, [], None, False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"damaged PNG chunk {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit grey PNG")
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("incomplete PNG")
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), "u1")
    if len(lines) != height * (width + 1):
        raise ValueError("wrong amount of PNG samples")
    return lines.reshape(height, width + 1)


def read_png(data: bytes) -> np.ndarray:
    """Samples (rows x width) of an 8-bit grey image without interlace."""
    return unfilter(png_lines(data))


def read_pngs(images: list[bytes]) -> Iterator[np.ndarray]:
    """The samples of several images, undone together while they are of one width and have ``ROWS`` rows in all."""
    held: list[np.ndarray] = []

    def undone() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(x) for x in held])
        first = np.zeros(int(ends[-1]), bool)
        first[(ends - [len(x) for x in held])[[len(x) > 0 for x in held]]] = True
        yield from np.split(unfilter(np.concatenate(held), 1, first), ends[:-1])

    for data in images:
        lines = png_lines(bytes(data))
        if held and (lines.shape[1] != held[0].shape[1] or sum(map(len, held)) + len(lines) > ROWS):
            yield from undone()
            held = []
        held.append(lines)
    if held:
        yield from undone()


def _spread(a: np.ndarray) -> np.ndarray:
    """Means of the rows over a grid of fixed height."""
    n = len(a)
    if n < _GRID:
        return a[np.arange(_GRID) * n // _GRID].astype("float64")
    edges = np.arange(_GRID) * n // _GRID
    sums = np.add.reduceat(a, edges, axis=0, dtype="float64")
    return sums / np.diff(np.append(edges, n))[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the lowest frequencies are above their median."""
    small = _spread(_spread(samples).T).T
    low = (_COSINES @ small @ _COSINES.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media (PNG) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [padded(t, width) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for n, _ in made], "media": [write_png(p, width) for _, p in made]})

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "text").mapInPandas(run, "doc_id string, n_bytes long, media binary"))


def features(media: DataFrame) -> DataFrame:
    """Read images back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, hash (8 bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data, samples in zip(batch["media"], read_pngs(batch["media"]), strict=True):
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])
            yield pd.concat([batch[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)

    arrow_rows(media.sparkSession)
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"
    return ids_as_long(ids_as_text(media, "n_bytes", "media").mapInPandas(run, schema))


def stored_features(docs: DataFrame) -> DataFrame:
    """Write every text as an image to a table in the shared folder, read it back, compute features."""
    return features(materialise(store(docs), "media"))
