"""Substring deduplication with a log-structured index of window fingerprints.

Every window of WIDTH words has a 64-bit fingerprint and 16 checking bits from a second polynomial. Documents come in
batches of ascending doc_id, two at least. A batch's windows become sorted immutable runs (one per chunk, distinct
fingerprints only). A bucket of the value range merge-joins them with the runs of all earlier batches: an entry whose
fingerprint was met in an earlier chunk is verified by the checking bits, and its chunk is told so with one bit. Entries
that no earlier batch had become the batch's own run of the index, so no entry is in two runs. Runs that cover equally
many batches are compacted into one, so an entry is rewritten as often as the logarithm of the batches says, and a batch
meets that many runs. Buckets are made by the bytes of all batches, so one task's share doesn't grow with the history.

With a folder given as index, a call first meets the runs that earlier calls left there, as if their documents had smaller
ids, and adds its own.

80 bits must agree for a window to count as seen before. The words themselves aren't compared: among 1.5e13 windows
(100 TB) some 90 windows would be taken for another by chance.

Defined cases: a null text has no words; fewer than WIDTH words make no window; rows with equal doc_id do not remove each
other's words; rows without doc_id count as larger than every id and not as smaller than each other; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, common
from .wordhash import CHECK_BASE, gram_hashes, grams_within, planes, unplanes

WIDTH = 13
#: Text of one batch; a call takes two batches at least, so that history is met by a batch.
BATCH_BYTES = 256 << 30
#: Share of the table that the first of only two batches takes: later batches are the larger ones.
FIRST_SHARE = 0.2

RUN = "bucket int, chunk int, prints binary, checks binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _windows(chunk: chunks.Chunk, width: int):
    """Fingerprints and checks of all windows, their word positions, and the sorted order with its distinct entries."""
    at = np.flatnonzero(grams_within(chunk.doc, width))
    prints = gram_hashes(chunk.words, width)[at]
    checks = (gram_hashes(chunk.words, width, CHECK_BASE)[at] >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return at, checks, order, ordered, new


def _runs(packed: DataFrame, buckets: int, width: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        chunk = chunks.Chunk(table)
        _, checks, order, ordered, new = _windows(chunk, width)
        prints, first = ordered[new], checks[order[new]]
        cuts = chunks.bucket_cuts(prints, buckets)
        key = table.column("chunk")[0].as_py()
        rows = [(b, key, common.squeeze(planes(prints[i:j])), first[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return _table(rows, RUN)

    return packed.groupBy("chunk").applyInArrow(common.one(run), RUN)


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _merge(runs: DataFrame, history_wanted: bool) -> DataFrame:
    """Rows (kind, bucket, chunk, prints, checks): kind 0 answers a chunk with a bit per entry in checks, kind 1 is what the index lacked."""
    ddl = "kind int, " + RUN

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        bucket = table.column("bucket")[0].as_py()
        keys = table.column("chunk").to_pylist()
        parts = [unplanes(common.unsqueeze(x.as_buffer().to_pybytes())) for x in table.column("prints")]
        checks = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("checks")])
        sizes = [len(p) for p in parts]
        prints = np.concatenate(parts)
        del parts
        order = np.argsort(prints, kind="stable")  # earlier chunks first among equals
        ordered = prints[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        seen = np.zeros(len(order), bool)
        seen[order] = ~new & (checks[order] == checks[head])
        rows, at = [], 0
        for key, n in zip(keys, sizes, strict=True):
            if key >= 0 and seen[at : at + n].any():
                rows.append((0, bucket, key, b"", common.squeeze(np.packbits(seen[at : at + n]).tobytes())))
            at += n
        if history_wanted:
            source = np.repeat(np.array(keys) >= 0, sizes)
            fresh = order[new & source[order]]
            rows.append((1, bucket, -1, common.squeeze(planes(prints[fresh])), checks[fresh].tobytes()))
        return _table(rows, ddl)

    return runs.groupBy("bucket").applyInArrow(common.one(run), ddl)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The entries of run rows, sorted: fingerprints and checks."""
    prints = np.concatenate([unplanes(common.unsqueeze(x.as_buffer().to_pybytes())) for x in table.column("prints")])
    checks = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("checks")])
    order = np.argsort(prints, kind="stable")
    return prints[order], checks[order]


def _compacted(runs: DataFrame) -> DataFrame:
    """Runs without common entries as one run."""

    def run(table: pa.Table) -> pa.Table:
        prints, checks = _entries(table)
        return _table([(table.column("bucket")[0].as_py(), -1, common.squeeze(planes(prints)), checks.tobytes())], RUN)

    return common.stored(runs.groupBy("bucket").applyInArrow(common.one(run), RUN), "window-index")


def _rebucketed(runs: DataFrame, buckets: int) -> DataFrame:
    """Runs of any bucketing, cut at this call's buckets."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                prints, checks = _entries(pa.Table.from_batches([batch.slice(i, 1)]))
                cuts = chunks.bucket_cuts(prints, buckets)
                rows = [(b, -1, common.squeeze(planes(prints[i:j])), checks[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield from _table(rows, RUN).to_batches()

    return runs.select("bucket", "chunk", "prints", "checks").mapInArrow(common.each(run), RUN)


def _answer(packed: DataFrame, answers: DataFrame, buckets: int, width: int) -> DataFrame:
    """Each document's counts and the digest of its kept words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunks.Chunk(left, keep=True)
        at, _, order, ordered, new = _windows(chunk, width)
        entries = np.flatnonzero(new)
        cuts = chunks.bucket_cuts(ordered[new], buckets)
        seen = np.zeros(len(entries), bool)
        for b, bits in zip(right.column("bucket").to_pylist(), right.column("checks").to_pylist(), strict=True):
            n = cuts[b + 1] - cuts[b]
            seen[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(common.unsqueeze(bits), np.uint8), count=n).astype(bool)
        entry = np.cumsum(new) - 1
        owner = chunk.ids[chunk.doc[at]]
        head = order[entries]
        checks = _windows_checks(chunk, at, width)
        gone = np.zeros(len(at), bool)
        gone[order] = (seen[entry] | (owner[order] > owner[head][entry])) & (checks[order] == checks[head][entry])
        change = np.zeros(len(chunk.words) + 1, np.int32)
        np.add.at(change, at[gone], 1)
        np.add.at(change, at[gone] + width, -1)
        removed = np.cumsum(change[:-1]) > 0
        rows = []
        for i, text in enumerate(chunk.texts):
            lo, hi = int(chunk.first[i]), int(chunk.first[i + 1])
            words, drop = text.split(), removed[lo:hi]
            n = int(drop.sum())
            if n:
                words = compress(words, (~drop).tolist())
            rows.append((int(chunk.ids[i]) if chunk.known[i] else None, hi - lo, n, hashlib.sha256(b" ".join(words)).hexdigest()))
        return _table(rows, RESULT)

    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(common.two(run), RESULT)


def _windows_checks(chunk: chunks.Chunk, at: np.ndarray, width: int) -> np.ndarray:
    return (gram_hashes(chunk.words, width, CHECK_BASE)[at] >> np.uint64(48)).astype(np.uint16)


def substring_dedup(docs: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES, first_share: float = FIRST_SHARE, index: str | None = None) -> DataFrame:
    """Per document: words, words removed, and the digest of the rest; see the module's text.

    index: a folder that executors share, with the runs of earlier calls; it is read before and added to, and must not be
    written by two calls at once. It holds runs of one width.
    """
    spark = docs.sparkSession
    common.session_setup(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = chunks.measure(docs, least=2)
    bounds = size["bounds"]
    many = max(2, -(-size["bytes"] // batch_bytes))
    earlier = spark.read.schema("bytes long, " + RUN).parquet(index) if index and common.exists(spark, index) else None
    told = earlier.agg(F.max("bytes")).first()[0] if earlier is not None else 0
    buckets = chunks.buckets_for(size["bytes"] + (told or 0))
    shares = [first_share] if many == 2 else [i / many for i in range(1, many)]
    cuts = sorted({int(bounds[int(s * len(bounds))]) for s in shares}) if len(bounds) else []
    number = sum((F.coalesce(F.col("doc_id") >= c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    if many > 2:  # one pass deals the chunks to their batches
        packed = chunks.pack(docs, bounds)
        which = sum(((F.col("chunk") > int(np.searchsorted(bounds, c, "left"))).cast("int") for c in cuts), F.lit(0))
        dealt = common.stored(packed.withColumn("batch", which), "packed-batches", ["batch"])
    runs: list[tuple[int, DataFrame]] = [(1 << 30, _rebucketed(earlier, buckets))] if earlier is not None else []
    results, own = [], []
    for i in range(len(cuts) + 1):
        packed = dealt.filter(F.col("batch") == i).drop("batch") if many > 2 else chunks.pack(docs.filter(number == i), bounds)
        met = _runs(packed, buckets, width)
        for _, r in runs:
            met = met.unionByName(r)
        wanted = i < len(cuts) or index is not None
        merged = _merge(met, wanted)
        if wanted:
            merged = common.stored(merged, "window-index", ["kind"])
            fresh = merged.filter("kind = 1").select("bucket", "chunk", "prints", "checks")
            own.append(fresh)
            runs.append((1, fresh))
            while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
                (n, a), (_, b) = runs.pop(), runs.pop()
                runs.append((2 * n, _compacted(a.unionByName(b))))
        results.append(_answer(packed, merged.filter("kind = 0").select("bucket", "chunk", "checks"), buckets, width))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    if index is not None:
        out = common.stored(out, "deduplicated")  # before the index says that these documents were met
        left = own[0]
        for r in own[1:]:
            left = left.unionByName(r)
        left.select(F.lit(size["bytes"] + (told or 0)).alias("bytes"), "bucket", "chunk", "prints", "checks").write.mode("append").option("compression", "zstd").parquet(index)
    return out
