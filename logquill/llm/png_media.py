"""Media columns: payloads as 8-bit greyscale PNG images, and perceptual hashes of what is stored.

Writing: rows of 64 samples, a filter per row, one zlib stream in an IDAT chunk, a CRC for every
chunk. Reading: chunks are walked with their checksums tested, the stream is inflated, filters are
undone in numpy, and the low-frequency cosine-transform terms of a 32 by 32 reduction give a
64-bit hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logquill.llm.common import slices, stored
from logquill.llm.token_ids import sound

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """data and zeros up to a positive multiple of unit."""
    return data + b"\0" * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG of the payload, whose length is a positive multiple of width. Each row takes
    the filter, none or left neighbour, whose residuals have the smaller sum of absolute values by
    a margin; text mostly keeps none, smooth data the other."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (pixels, left)]
    rows = np.empty((len(pixels), width + 1), np.uint8)
    rows[:, 0] = np.where(cost[1] * 4 < cost[0], SUB, NONE)
    rows[:, 1:] = np.where(rows[:, :1] == SUB, left, pixels)
    header = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_chunks(png: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, data) of each chunk. Raises ValueError on a bad signature, checksum or end."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    out, at = [], 8
    while at + 12 <= len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(data) != size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        out.append((kind, data))
        at += 12 + size
        if kind == b"IEND":
            break
    if not out or out[-1][0] != b"IEND" or at != len(png):
        raise ValueError("the PNG doesn't end with IEND")
    return out


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (first column: filter; one byte a sample)."""
    kinds, pixels = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown filter")
    sub = kinds == SUB
    pixels[sub] = np.cumsum(pixels[sub], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds >= UP):
        above = pixels[y - 1].astype(int) if y else np.zeros(pixels.shape[1], int)
        if kinds[y] == UP:
            pixels[y] += above.astype(np.uint8)
            continue
        row, a, c = rows[y, 1:].astype(int), 0, 0
        for x, b in enumerate(above):
            if kinds[y] == AVERAGE:
                a = (row[x] + (a + b) // 2) & 255
            else:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                a, c = (row[x] + near) & 255, b
            pixels[y, x] = a
    return pixels


def decode_png(png: bytes) -> np.ndarray:
    """Samples, height by width, of an 8-bit greyscale PNG without interlacing."""
    chunks = read_chunks(png)
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if chunks[0][0] != b"IHDR" or (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    raw = zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT"))
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


_COSINES = np.cos(np.pi / 32 * np.outer(np.arange(8), np.arange(32) + 0.5))


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 8 by 8 lowest cosine terms of the image, reduced to 32 by 32 by
    means, are above the median of those without the constant term."""

    def bands(x: np.ndarray) -> np.ndarray:
        starts = np.arange(32) * len(x) // 32
        sizes = np.maximum(np.diff(np.append(starts, len(x))), 1)
        return np.add.reduceat(x, starts, axis=0) / sizes[:, None]

    terms = _COSINES @ bands(bands(pixels.astype(np.float64)).T).T @ _COSINES.T
    terms = np.round(terms.ravel(), 6)
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of docs (doc_id, text): the text's UTF-8 bytes, padded, as PNG. A null
    text is empty; null ids and repeated rows are kept; texts of any length are stored whole; an empty table gives an empty one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [sound(t or "").encode() for t in batch["text"].to_pylist()]
            media = [encode_png(padded(x)) for x in data]
            yield pa.record_batch([batch["doc_id"], pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, STORED)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the hash of each stored image, all from the stored bytes. A broken image fails
    the job."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for png in batch["media"].to_pylist():
                pixels = decode_png(png)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([batch["doc_id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, FEATURES)


def media_of_documents(docs: DataFrame) -> DataFrame:
    """docs stored as a table with an image column, read back, with features."""
    return media_features(stored(write_media(docs), "media", compression="uncompressed"))
