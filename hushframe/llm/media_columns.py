"""Texts as pictures in binary columns: PNG files written and read back chunk by chunk, and hashes of their content."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import slices, table

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: A picture has rows of 64 RGB pixels.
WIDTH, PIXEL = 64, 3
ROW = WIDTH * PIXEL
#: The cosine transform reads a square of this side and keeps a square of that one.
SIDE, KEEP = 32, 8
_n, _k = np.meshgrid(np.arange(SIDE), np.arange(KEEP))
#: In whole numbers, so that a hash doesn't hang on the machine that computes it.
COSINE = np.round(np.cos((2 * _n + 1) * _k * np.pi / (2 * SIDE)) * (1 << 12)).astype(np.int64)


def pad(data: bytes, multiple: int = ROW) -> bytes:
    """data and spaces up to a positive multiple."""
    return data + b" " * (max(multiple, -(-len(data) // multiple) * multiple) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray, level: int = 3) -> bytes:
    """An 8-bit PNG of samples[row, column, channel]; each row has the filter (none, sub, up) of least absolute sum."""
    height, width, pixel = samples.shape
    kind = {v: k for k, v in CHANNELS.items()}[pixel]
    flat = samples.reshape(height, width * pixel)
    sub, up = flat.copy(), flat.copy()
    sub[:, pixel:] -= flat[:, :-pixel]
    up[1:] -= flat[:-1]
    three = np.stack([flat, sub, up])
    best = np.abs(three.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines = np.empty((height, width * pixel + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = three[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """samples[row, column, channel] of an 8-bit PNG without interlacing or palette. ValueError if a checksum, a length or the order of chunks is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(data):
        if ended or len(data) < at + 12:
            raise ValueError("bytes after the end" if ended else "cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError(f"checksum of {kind!r}")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("order of chunks")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown chunk {kind!r}")
        at += 12 + size
    if not ended or head is None:
        raise ValueError("cut off")
    width, height, depth, colour, method, filters, interlace = head
    if depth != 8 or colour not in CHANNELS or method or filters or interlace:
        raise ValueError("form of PNG")
    pixel = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if lines.size != height * (width * pixel + 1):
        raise ValueError("length of samples")
    lines = lines.reshape(height, width * pixel + 1)
    return unfilter(lines[:, 0], lines[:, 1:], pixel).reshape(height, width, pixel)


def unfilter(kinds: np.ndarray, lines: np.ndarray, pixel: int) -> np.ndarray:
    """Undoes the rows' filters. Runs of rows with filter none, sub or up are done at once, the others row by row."""
    out = lines.copy()
    height, width = lines.shape
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), height]):
        kind = int(kinds[b])
        if kind == 1:
            out[b:e] = np.add.accumulate(lines[b:e].reshape(e - b, -1, pixel), axis=1, dtype=np.uint8).reshape(e - b, width)
        elif kind == 2:
            if b:
                out[b] += out[b - 1]
            out[b:e] = np.add.accumulate(out[b:e], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(b, e):
                above = (out[y - 1] if y else np.zeros(width, np.uint8)).astype(np.int64)
                row = out[y]
                for x in range(0, width, pixel):
                    left = row[x - pixel : x].astype(np.int64) if x else np.zeros(pixel, np.int64)
                    top = above[x : x + pixel]
                    if kind == 3:
                        guess = (left + top) >> 1
                    else:
                        corner = above[x - pixel : x] if x else np.zeros(pixel, np.int64)
                        p = left + top - corner
                        pa_, pb, pc = abs(p - left), abs(p - top), abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, top, corner))
                    row[x : x + pixel] = (row[x : x + pixel] + guess) & 255
        elif kind:
            raise ValueError("filter")
    return out


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine terms of the grey picture, reduced to 32 x 32, exceed their median.

    The constant term gives 0. All steps are in whole numbers.
    """
    grey = samples.sum(axis=2, dtype=np.int64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= SIDE:
            cuts = np.arange(SIDE) * n // SIDE
            counts = np.diff([*cuts, n]).reshape((-1, 1) if axis == 0 else (1, -1))
            grey = np.add.reduceat(grey, cuts, axis=axis) * 256 // counts
        else:
            grey = np.take(grey, np.arange(SIDE) * n // SIDE, axis=axis) * 256
    low = (COSINE @ grey >> 12) @ COSINE.T
    terms = low.ravel()
    bits = terms > np.sort(terms[1:])[31]
    bits[0] = False
    return np.packbits(bits).tobytes()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with spaces to whole rows, as an RGB PNG 64 pixels wide.

    Null counts as the empty text, which gives one row of spaces. Rows are independent: ids may be null or repeat,
    equal texts give equal media, an empty table gives none, and other columns are not read. A picture has up to
    2**31 - 1 rows; memory holds a few times the text at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            rows = [x or b"" for x in batch.column("t").to_pylist()]
            made = [write_png(np.frombuffer(pad(x), np.uint8).reshape(-1, WIDTH, PIXEL)) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in rows], pa.int64()), pa.array(made, pa.binary())], names=["id", "n_bytes", "media"]
            )

    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return plain.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def decode_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, payload, hash) for a binary column of PNG files: their samples in order, and the cosine hash as 8 bytes.

    Null media give a null payload and hash; a damaged file raises ValueError with its fault.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            seen = [None if x is None else read_png(x) for x in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names if c != "media"],
                    pa.array([None if x is None else x.tobytes() for x in seen], pa.binary()),
                    pa.array([None if x is None else cosine_hash(x) for x in seen], pa.binary()),
                    batch.column("media"),
                ],
                names=[*[c for c in batch.schema.names if c != "media"], "payload", "hash", "media"],
            )

    rest = [f"`{c}` {t}" for c, t in media.dtypes if c != "media"]
    return media.mapInArrow(run, ", ".join([*rest, "payload binary", "hash binary", "media binary"]))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as PNG columns and read back; digests of both forms."""
    back = decode_media(encode_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
