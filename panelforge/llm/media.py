"""Media columns: payloads stored as PNG images in a binary column, read back with checks, and hashed by their look.

A payload is a row of bytes cut into lines of WIDTH grey samples. The file is written and read here: chunks with CRC-32
and one zlib stream. Each line is written under the filter None, Sub or Up that leaves the least sum of absolute
differences. Filters are undone in numpy: Sub by a running sum along the lines, Up by one down each run of such lines,
Average and Paeth (which other writers use) along anti-diagonals, whose samples depend on earlier ones only. The hash is
64 bits: the image is averaged to SIDE x SIDE cells, taken through a cosine transform, and the signs of its lowest
frequencies against their median are the bits.

Defined cases: a null or empty text is one line of padding; equal texts give equal files and hashes; rows are kept one for
one; other columns are ignored; no rows give no rows.
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

from . import common

WIDTH = 576
PAD = 255
SIDE, LOW = 32, 8
LEVEL = 6
#: Fixed value: the signature of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"

MEDIA = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded to a positive multiple of WIDTH."""
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(lines: np.ndarray) -> np.ndarray:
    """Lines under the filter (its number first) that leaves the least sum of absolute differences; ties go to the lower number."""
    tried = np.zeros((3, *lines.shape), np.uint8)
    tried[0] = tried[1] = tried[2] = lines
    tried[1, :, 1:] -= lines[:, :-1]
    tried[2, 1:] -= lines[:-1]
    cost = np.minimum(tried, -tried).sum(axis=2, dtype=np.int64)
    kind = np.argmin(cost, axis=0)
    raw = np.empty((len(lines), lines.shape[1] + 1), np.uint8)
    raw[:, 0] = kind
    raw[:, 1:] = tried[kind, np.arange(len(lines))]
    return raw


def write_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(lines).tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _summed(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of lines under None, Sub and Up; sums wrap at 256."""
    out = lines.copy()
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(lines[sub], axis=1, dtype=np.uint8)
    if kinds[0] == 2:
        out[0] += above
    if (kinds[1:] == 2).any():
        # down a run of Up lines the samples are sums from the line before the run on
        down = np.cumsum(out, axis=0, dtype=np.uint8)
        own = kinds != 2
        own[0] = True
        start = np.maximum.accumulate(np.where(own, np.arange(len(kinds)), 0))
        before = np.where((start > 0)[:, None], down[start - 1], 0).astype(np.uint8)
        out = down - before
    return out


def _diagonal(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of lines under Average and Paeth, an anti-diagonal at a time."""
    high, wide = lines.shape
    known = np.zeros((high + 1, wide + 1), np.int32)
    known[0, 1:] = above
    for d in range(high + wide - 1):
        i = np.arange(max(0, d - wide + 1), min(high, d + 1))
        j = d - i
        left, up, corner = known[i + 1, j], known[i, j + 1], known[i, j]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        known[i + 1, j + 1] = (lines[i, j] + np.where(kinds[i] == 3, (left + up) >> 1, nearest)) & 255
    return known[1:, 1:].astype(np.uint8)


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Samples of filtered lines (the filter's number first): one byte a sample, so the left neighbour is one byte back."""
    kinds, lines = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if not kinds.any():
        return lines.copy()
    out = np.empty(lines.shape, np.uint8)
    above = np.zeros(lines.shape[1], np.uint8)
    runs = np.flatnonzero(np.diff(kinds >= 3)) + 1
    for i, j in zip([0, *runs.tolist()], [*runs.tolist(), len(kinds)], strict=True):
        out[i:j] = (_diagonal if kinds[i] >= 3 else _summed)(kinds[i:j], lines[i:j], above)
        above = out[j - 1]
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit image; a wrong signature, checksum, length or type raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, stream, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("the file is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only plain 8-bit grey images are read")
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("the file is cut off")
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    if len(raw) != size[1] * (size[0] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(size[1], size[0] + 1))


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


COSINES = _cosines()


def cells(image: np.ndarray) -> np.ndarray:
    """The image averaged to SIDE x SIDE cells; lines are repeated where there are fewer than cells."""
    high, wide = image.shape
    columns = image.reshape(high, SIDE, wide // SIDE).mean(axis=2)
    if high < SIDE:
        return columns[np.arange(SIDE) * high // SIDE]
    starts = np.arange(SIDE) * high // SIDE
    return np.add.reduceat(columns, starts, axis=0) / np.diff(np.append(starts, high))[:, None]


def look(grid: np.ndarray) -> np.ndarray:
    """Hashes (8 bytes each) of stacked grids of cells: the constant is left out of the median, its bit is 0."""
    low = np.round(COSINES @ grid @ COSINES.T, 6).reshape(len(grid), -1)
    middle = np.median(low[:, 1:], axis=1)
    bits = low > middle[:, None]
    bits[:, 0] = False
    return np.packbits(bits, axis=1)


def write_media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): every text as an image file."""
    common.session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_png(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(common.each(run), MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests of what the files hold, and the hash of its look, read from the stored files."""
    common.session_setup(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sizes, digests, tails, lengths, files, grids = [], [], [], [], [], []
                for data in batch.column(2).to_pylist():
                    image = read_png(data)
                    payload = image.tobytes()
                    sizes.append(len(payload))
                    digests.append(hashlib.sha256(payload).hexdigest())
                    tails.append(zlib.crc32(payload[-32:]))
                    lengths.append(len(data))
                    files.append(hashlib.sha256(data).hexdigest())
                    grids.append(cells(image))
                hashes = [h.tobytes() for h in look(np.stack(grids))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(tails, pa.int64()), pa.array(lengths, pa.int64()), pa.array(files), pa.array([h.hex() for h in hashes]), pa.array(hashes, pa.binary())],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "phash"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(common.each(run), RESULT)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as an image in the shared folder, read the files back and describe them."""
    return media_features(common.stored(write_media(docs), "media"))
