"""Texts as PNG images in binary columns, and perceptual hashes read back from them.

The encoder writes 8-bit greyscale images of 64 samples a row; the decoder walks the
chunks, tests every CRC-32, inflates the image data (whose Adler-32 zlib tests) and
undoes the row filters with numpy.  Both sides work on one value at a time inside Arrow
batches, so memory is bounded by the largest single image and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, utf8_list

WIDTH = 64
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the averaged image and of the kept low-frequency corner.
GRID, CORNER = 32, 8


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    """Zero-padded to a positive multiple of ``width`` bytes."""
    return text + b"\0" * (max(width, -(-len(text) // width) * width) - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """Greyscale PNG of ``width`` samples a row; each row is left as is or, where that
    leaves smaller residues, stored as the difference from the row above (filter 2)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    size = lambda x: np.minimum(x, 256 - x.astype(np.int16)).sum(axis=1)
    use = size(up) < np.minimum(rows, 96).sum(axis=1, dtype=np.int64) // 2
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = np.where(use, 2, 0)
    out[:, 1:] = np.where(use[:, None], up, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale, non-interlaced PNG; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("chunk cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            raise ValueError("chunk cut short")
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("missing chunk")
    width, height, depth, colour, _, _, interlace = head
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only 8-bit greyscale is supported")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"bad image data: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong amount of image data")
    raw = raw.reshape(height, width + 1)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    start = 0
    while start < height:  # runs of rows that share a filter are undone together
        kind, stop = kinds[start], start + 1
        while stop < height and kinds[stop] == kind:
            stop += 1
        run, above = out[start:stop], out[start - 1] if start else np.zeros(width, np.uint8)
        if kind == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=run)
        elif kind == 2:
            run[0] += above
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kind in (3, 4):
            for row in run:
                left = corner = 0
                for x in range(width):
                    top = int(above[x])
                    add = (left + top) // 2 if kind == 3 else _paeth(left, top, corner)
                    left, corner = (int(row[x]) + add) & 255, top
                    row[x] = left
                above = row
        elif kind != 0:
            raise ValueError(f"unknown filter {kind}")
        start = stop
    return out


def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_BASIS = _cosines(GRID, CORNER)


def _shrink(samples: np.ndarray, axis: int) -> np.ndarray:
    """Means over GRID equal stretches; short sides repeat their nearest samples."""
    n = samples.shape[axis]
    edge = np.arange(GRID + 1) * n // GRID
    if n < GRID:
        return np.take(samples, edge[:-1], axis=axis)
    return np.add.reduceat(samples, edge[:-1], axis=axis) / np.diff(edge).reshape(-1, *[1] * (samples.ndim - 1 - axis))


def perceptual_hash(samples: np.ndarray) -> str:
    """16 hex digits: signs of the 8 x 8 lowest cosine-transform terms about their median."""
    grid = _shrink(_shrink(samples.astype(np.float64), 0), 1)
    low = (_BASIS @ grid @ _BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's PNG as a binary column, one row per row of ``docs``.

    A null text is stored like an empty one: a single row of zero samples.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8_list(b.column("text"))
            media = pa.array((encode_png(payload_of(t)) for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(t) for t in texts], pa.int64()), media], ["id", "n_bytes", "media"]
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Decode ``media`` of :func:`to_media` and add what was read back.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last row), media_bytes,
    media_sha256 and feature.  A null or damaged image gives nulls and its reason in
    ``error`` instead of failing the job.
    """
    ship(media.sparkSession)
    extra = (
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, error string"
    )
    names = [x.split()[0] for x in extra.split(", ")]
    kinds = [pa.int64() if " long" in x else pa.string() for x in extra.split(", ")]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("no image",)
        own = len(data), hashlib.sha256(data).hexdigest()
        try:
            samples = decode_png(data)
        except ValueError as e:
            return None, None, None, *own, None, str(e)
        back = samples.tobytes()
        digest = hashlib.sha256(back).hexdigest()
        return len(back), digest, zlib.crc32(back[-WIDTH:]), *own, perceptual_hash(samples), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [one(x) for x in b.column("media").to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *columns], ["id", "n_bytes", *names])

    picked = media.select("id", "n_bytes", "media")
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, {extra}")
