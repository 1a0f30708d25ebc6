"""Documents in chunks of ascending doc_id: the unit in which fingerprint runs are built, merged and answered.

A chunk holds a range of ids (so chunk order is id order) and about CHUNK_BYTES of text. Chunks travel as a few rows of
compressed bytes. From each chunk a sorted run of distinct fingerprints is cut into buckets by value; a bucket's task
merges the runs of all chunks and answers each chunk with one bit or byte per entry. Because a chunk names a
fingerprint once, a passage shared by a third of all documents costs a bucket one entry per chunk, not per document.
Rows without doc_id come after all ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 8 << 20
#: Of a chunk's text, in one row.
PIECE_BYTES = 4 << 20
#: Compressed and unpacked run bytes that one bucket's task should get.
BUCKET_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max

SCHEMA = "chunk int, ids binary, known binary, lens binary, body binary"


def measure(docs: DataFrame, least: int = 1, chunk_bytes: int = CHUNK_BYTES) -> dict:
    """Rows, bytes of text and the id bounds of chunks (least at least): one pass over the table; bounds grow by one id per chunk."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    chunks = max(least, -(-int(size or 0) // chunk_bytes))
    bounds: list[int] = []
    if n and chunks > 1:
        at = [i / chunks for i in range(1, chunks)]
        bounds = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * chunks))).first()[0] or []
    return {"rows": n, "bytes": int(size or 0), "bounds": np.unique(np.array(bounds, np.int64))}


def pack(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows (chunk, ids, known, lens, body): pieces of chunks as compressed bytes. bounds are about 8 bytes per 8 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            chunk = np.searchsorted(bounds, ids, "right").astype(np.int32)
            text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            size = np.diff(common.binaries(text)[1])
            order = np.argsort(chunk, kind="stable")
            sums = np.cumsum(size[order])
            cut = np.flatnonzero((np.diff(chunk[order]) != 0) | (np.diff(sums // PIECE_BYTES) != 0)) + 1
            rows = []
            for part in np.split(order, cut):
                body, offsets = common.binaries(text.take(pa.array(part)))
                rows.append((int(chunk[part[0]]), ids[part].tobytes(), known[part].tobytes(), np.diff(offsets).astype(np.int64).tobytes(), common.squeeze(body.tobytes())))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["chunk", "ids", "known", "lens", "body"])

    return docs.select("doc_id", "text").mapInArrow(common.each(run), SCHEMA)


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A chunk's ids, which of them are known, and its texts, in ascending id order (ties by text)."""
    ids, known, texts = [], [], []
    for a, k, lens, body in zip(*(table.column(c).to_pylist() for c in ("ids", "known", "lens", "body")), strict=True):
        ids.append(np.frombuffer(a, np.int64))
        known.append(np.frombuffer(k, bool))
        at, body = 0, common.unsqueeze(body)
        for n in np.frombuffer(lens, np.int64).tolist():
            texts.append(body[at : at + n])
            at += n
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    all_known = np.concatenate(known) if known else np.zeros(0, bool)
    order = sorted(range(len(texts)), key=lambda i: (all_ids[i], texts[i]))
    return all_ids[order], all_known[order], [texts[i] for i in order]


class Chunk:
    """A chunk's documents in ascending id order (ties by text) and the hashes of their words; texts only if asked for."""

    def __init__(self, table: pa.Table, lower: bool = False, keep: bool = False):
        from .wordhash import word_bounds, word_hashes

        self.ids, self.known, texts = unpack(table)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.texts = texts if keep else None
        del texts
        starts, ends, self.doc = word_bounds(data, offsets)
        self.words = word_hashes(data, starts, ends, lower)
        #: Position of each document's first word.
        self.first = np.searchsorted(self.doc, np.arange(len(offsets), dtype=np.int32))

    def __len__(self) -> int:
        return len(self.ids)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's values begin in a sorted run: buckets + 1 positions."""
    edges = [((b << 64) + buckets - 1) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(sorted_hashes, np.array(edges, np.uint64)), [len(sorted_hashes)]])


def buckets_for(size: int) -> int:
    """So many buckets that one gets BUCKET_BYTES of runs, taking 1.3 bytes of run per byte of text."""
    return max(8, -(-size * 13 // 10 // BUCKET_BYTES))
