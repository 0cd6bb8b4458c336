"""Texts as grey PNG images in a binary column, read back with checksum tests, and a low-frequency hash."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored

#: The eight bytes that begin every PNG file (fixed value).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 6
#: Side of the reduced image and of the low-frequency corner that is hashed.
REDUCED, CORNER = 32, 8


def payload_of(data: bytes | None) -> bytes:
    """The bytes and zeros up to a positive multiple of the width."""
    data = data or b""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of the payload in rows of the width; rows take the cheapest of None, Sub and Up."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = np.stack([np.minimum(x, 256 - x.astype(np.int16)).sum(axis=1) for x in (rows, sub, up)])
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = np.choose(best[:, None], (rows, sub, up))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, body) of each chunk; a wrong signature, length or checksum is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or struct.pack(">I", zlib.crc32(kind + body)) != png[at + 8 + size : at + 12 + size]:
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        if kind == b"IEND":
            if at + 12 + size != len(png):
                raise ValueError("bytes after the end")
            return
        at += 12 + size
    raise ValueError("no end chunk")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows from filtered rows of one-byte samples; runs of one filter are undone together where they can be."""
    out = np.empty_like(lines)
    edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)] if len(kinds) else [0]
    zero = np.zeros(lines.shape[1], np.uint8)
    for a, b in zip(edges, edges[1:], strict=False):
        kind, above = int(kinds[a]), out[a - 1] if a else zero
        if kind == 0:
            out[a:b] = lines[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(lines[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack((above[None], lines[a:b])), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(a, b):
                up, left, corner = above.astype(int), 0, 0
                row = lines[r].astype(int)
                for i in range(len(row)):
                    if kind == 3:
                        guess = (left + up[i]) // 2
                    else:
                        p = left + up[i] - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                    corner = up[i]
                    left = row[i] = (row[i] + guess) % 256
                out[r] = row
                above = out[r]
        else:
            raise ValueError(f"filter {kind}")
    return out


def decode(png: bytes) -> np.ndarray:
    """The image's rows; only 8-bit grey without interlacing is read."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != head[1] * (head[0] + 1):
        raise ValueError("the image data has the wrong size")
    lines = lines.reshape(head[1], head[0] + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_i = np.arange(REDUCED)
_COSINES = np.cos(np.pi * (2 * _i[None, :] + 1) * np.arange(CORNER + 1)[:, None] / (2 * REDUCED))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which low frequencies of the reduced image's cosine transform lie above their median."""
    rows = np.linspace(0, image.shape[0], REDUCED + 1).astype(int)
    sums = np.vstack((np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)))
    high = np.maximum(rows[1:], np.minimum(rows[:-1] + 1, image.shape[0]))
    low = np.minimum(rows[:-1], image.shape[0] - 1)
    tall = (sums[high] - sums[low]) / (high - low)[:, None]
    small = tall.reshape(REDUCED, REDUCED, -1).mean(axis=2)
    corner = (_COSINES @ small @ _COSINES.T)[1:, 1:]
    bits = np.packbits((corner > np.median(corner)).ravel())
    return bits.tobytes().hex()


def store_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, image (PNG): the texts' payloads, stored in the shared folder."""

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                    pa.array([encode(payload_of(x)) for x in texts], pa.binary()),
                ],
                ["doc_id", "n_bytes", "image"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(base.mapInArrow(run, "doc_id long, n_bytes long, image binary"), "images")


def read_images(images: DataFrame) -> DataFrame:
    """Digests and the hash of every stored image, from its decoded bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for png in batch.column("image").to_pylist():
                image = decode(png)
                raw = image.tobytes()
                rows.append(
                    (
                        len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png),
                        hashlib.sha256(png).hexdigest(), cosine_hash(image),
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_bytes"),
                    *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
                ],
                [f.split()[0] for f in _DIGEST.split(", ")],
            )

    return images.select("doc_id", "n_bytes", "image").mapInArrow(run, _DIGEST)


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)


def media_features(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): sizes and digests of its image as read back, and its hash.

    Null is the empty text (64 zero bytes). Equal texts have equal values; other columns are ignored.
    """
    return read_images(store_images(docs))
