"""Token ids of whole texts in binary shard files of patched frame-of-reference blocks.

A shard holds the documents of a range of doc_id, in ascending order (ties by text). Its ids are cut into blocks of BLOCK.
A block subtracts its minimum and packs the differences at the width that the PERCENTILE-th of them needs; what is wider
leaves its high bits in an exception list. The file has an index of block starts, so any block is read alone.

File: magic, then little-endian u32 documents, ids, block size, blocks; u32 document ends; u64 block starts (one more than
blocks, from the first block's byte); blocks: u32 minimum, u16 exceptions, u8 width, packed bits, u16 places, u32 high bits.

The shards are rows of a table in the shared folder (Spark's committer makes each appear whole or not at all when
executors are lost); reading them back needs nothing else. Defined cases: a null text is empty and has only the end id;
rows without doc_id come last; equal ids are ordered by text; other columns are ignored; no rows give no files.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, common
from .bpe import byte_letters

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 98
END = 1
#: Distinct words a worker remembers.
WORDS = 400_000
#: Shards whose starts (12 bytes each) are broadcast, at most.
BROADCAST_ROWS = 2_000_000
#: Blocks packed at a time, and bytes of text encoded at a time (or one text).
BATCH, BATCH_BYTES = 256, 1 << 20

FILES = "chunk int, n_ids long, ids binary, known binary, file binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: ASCII letters, marks and white space among the bytes.
LETTER, MARK, BLANK = 1, 2, 3
KIND = np.zeros(256, np.uint8)
for _b in range(33, 127):
    KIND[_b] = LETTER if chr(_b).isalpha() else 0 if chr(_b).isdigit() else MARK
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
#: Stands for the end of a text among units; no UTF-8 has this byte.
STOP = b"\xff"


def parted(text: bytes) -> bytes:
    """text, which ends with white space, with a space before marks at a word's end that follow an ASCII letter: the tokenizer parts them."""
    data = np.frombuffer(text, np.uint8)
    kind = KIND[data]
    mark = kind == MARK
    at = np.flatnonzero(mark[1:] & (kind[:-1] == LETTER)) + 1
    ends = np.flatnonzero(mark[:-1] & ~mark[1:]) + 1
    return np.insert(data, at[kind[ends[np.searchsorted(ends, at, "right")]] == BLANK], 32).tobytes()


def units(texts: list[bytes]) -> list[bytes]:
    """Parts of texts that are encoded alone: words without the marks at their end, the marks, in small letters; STOP after each text.

    Texts with a special token's beginning are only split, those with combining marks (U+0300 on) aren't lower-cased here:
    a few of these marks join with small letters alone.
    """
    whole = b"".join([b"%b \xff " % t for t in texts])
    if not (b"<|" in whole or b"\xcc" in whole or b"\xcd" in whole or whole.count(STOP) > len(texts)):
        return parted(whole).lower().split()
    out = []
    for t in texts:
        if b"<|" not in t:
            t = parted(t + b" ")
            t = t if b"\xcc" in t or b"\xcd" in t else t.lower()
        out += [w if w != STOP else "\ufffd".encode() for w in t.split()]
        out.append(STOP)
    return out


#: Words that the normaliser leaves alone and the splitter leaves whole: the model alone gives their ids.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: The letters that stand for the bytes that aren't printable Latin-1.
BYTE_LETTERS = {b: c for b, c in enumerate(byte_letters()) if ord(c) != b}


class Entries(dict):
    """Numbers of words; a word that is asked for the first time gets the next one and is noted as new."""

    def __init__(self, known: dict[bytes, int]) -> None:
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of texts under a tokenizer that ignores letter case and whose splitter parts letters from marks.

    Each distinct unit is encoded by the library once: plain words by its model, others whole, many in one text with PART
    between them. A text is the concatenation of its units' ids.
    """

    #: A word of its own that no other word has inside (those that have are encoded alone).
    PART = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.part = self.ids(self.PART)
        self.clear()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.entry = Entries({STOP: 0})
        self.flat = np.zeros(1 << 16, np.uint32)
        self.flat[0] = END
        self.bounds = np.array([0, 1], np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Encode new words, in the order of their numbers."""
        found: list[list[int]] = [[]] * len(words)
        others = []
        tokenize = self.model.tokenize
        for i, w in enumerate(words):
            if w.isalpha() and w.islower():  # of bytes: ASCII letters only
                found[i] = [t.id for t in tokenize(w.decode())]
                continue
            text = w.decode("utf-8", "replace")
            if LETTERS.fullmatch(text):
                found[i] = [t.id for t in tokenize(w.decode("latin-1").translate(BYTE_LETTERS))]
            elif self.PART in text or len(self.part) != 1:
                found[i] = self.ids(text)
            else:
                others.append((i, text))
        for at in range(0, len(others), 1000):
            some = others[at : at + 1000]
            ids = np.array(self.ids(f" {self.PART} ".join([t for _, t in some])), np.uint32)
            for (i, _), part in zip(some, np.split(ids, np.flatnonzero(ids == self.part[0])), strict=True):
                found[i] = part[part != self.part[0]].tolist()
        if found:
            parts = [np.fromiter(chain.from_iterable(found), np.uint32)]
            sizes = [np.fromiter(map(len, found), np.int64, len(found))]
            ends = self.bounds[-1] + np.cumsum(np.concatenate(sizes))
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.bounds[-1] : ends[-1]] = np.concatenate(parts)
            self.bounds = np.concatenate([self.bounds, ends])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with END after each text, and where each text's ids end."""
        if len(self.entry) > WORDS:
            self.clear()
        words = units(texts)
        e = np.fromiter(map(self.entry.__getitem__, words), np.int64, len(words))
        del words
        self.learn(self.entry.new)
        self.entry.new = []
        n = np.diff(self.bounds)[e]
        to = np.cumsum(n)
        places = np.repeat(self.bounds[e] - to + n, n)
        places += np.arange(len(places))
        return self.flat[places], to[e == 0]


def widths_of(values: np.ndarray, percentile: int = PERCENTILE) -> np.ndarray:
    """Bits for the given percentile of each row of differences."""
    at = min(values.shape[1] - 1, values.shape[1] * percentile // 100)
    pivot = np.partition(values, at, axis=1)[:, at]
    return np.where(pivot > 0, np.floor(np.log2(np.maximum(pivot, 1))).astype(np.int64) + 1, 0)


def write_file(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard file of ids (u32) and document ends."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    body, sizes = [], []
    for at in range(0, blocks, BATCH):
        values = padded[at * BLOCK : (at + BATCH) * BLOCK].reshape(-1, BLOCK)
        low = values.min(axis=1)
        rest = values - low[:, None]
        width = widths_of(rest)
        packed: list[bytes] = [b""] * len(rest)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                bits = np.empty((len(rows), BLOCK, int(w)), np.uint8)
                for i in range(int(w)):
                    bits[:, :, i] = (rest[rows] >> np.uint32(i)) & np.uint32(1)
                lines = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
                for r, line in zip(rows.tolist(), lines, strict=True):
                    packed[r] = line.tobytes()
        high = rest >> np.minimum(width, 31).astype(np.uint32)[:, None]
        high[width > 31] = 0
        for r in range(len(rest)):
            places = np.flatnonzero(high[r])
            part = struct.pack("<IHB", int(low[r]), len(places), int(width[r])) + packed[r] + places.astype("<u2").tobytes() + high[r][places].astype("<u4").tobytes()
            body.append(part)
            sizes.append(len(part))
    starts = np.zeros(blocks + 1, "<u8")
    np.cumsum(sizes, out=starts[1:]) if sizes else None
    return b"".join([MAGIC, struct.pack("<IIII", len(ends), len(ids), BLOCK, blocks), ends.astype("<u4").tobytes(), starts.tobytes(), *body])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and document ends of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    docs, total, block, blocks = struct.unpack_from("<IIII", data, 4)
    at = 20
    ends = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    starts = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64) + at + 8 * (blocks + 1)
    out = np.empty((blocks, block), np.uint32)
    heads = [struct.unpack_from("<IHB", data, int(s)) for s in starts[:-1]]
    width = np.array([h[2] for h in heads], np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.split(rows, range(BATCH, len(rows), BATCH)):
            if not w:
                out[part] = 0
                continue
            size = block * int(w) // 8
            lines = np.frombuffer(b"".join(data[starts[r] + 7 : starts[r] + 7 + size] for r in part), np.uint8).reshape(len(part), size)
            bits = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(part), block, int(w))
            values = np.zeros((len(part), block), np.uint32)
            for i in range(int(w)):
                values |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
            out[part] = values
    for r, (low, n, w) in enumerate(heads):
        if n:
            lo = int(starts[r]) + 7 + block * w // 8
            places = np.frombuffer(data, "<u2", n, lo)
            out[r, places] |= np.frombuffer(data, "<u4", n, lo + 2 * n) << np.uint32(w)
        out[r] += np.uint32(low)
    return out.ravel()[:total], ends


def write_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode docs and write the shard files as a table of the shared folder; returns that table."""
    common.session_setup(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = chunks.pack(docs, chunks.measure(docs)["bounds"])

    def run(table: pa.Table) -> pa.Table:
        encoder = common.held(tokenizer, lambda: WordEncoder(tokenizer))
        ids, known, texts = chunks.unpack(table)
        out, ends, total = [], [], 0
        cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // BATCH_BYTES)) + 1
        for at, then in pairwise([0, *cuts.tolist(), len(texts)]):
            part, to = encoder.encode(texts[at:then])
            out.append(part)
            ends.append(to + total)
            total += len(part)
        return common.arrow_table([(table.column("chunk")[0].as_py(), total, ids.tobytes(), known.tobytes(), write_file(np.concatenate(out), np.concatenate(ends)))], FILES)

    return common.stored(packed.groupBy("chunk").applyInArrow(common.one(run, tokenizer), FILES), "token-files")


def read_shards(files: DataFrame) -> DataFrame:
    """Per document: where its ids start in the whole sequence, how many they are, and their checksum."""
    sizes = files.select("chunk", "n_ids").withColumn("before", F.sum("n_ids").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    starts = common.stored(sizes.select("chunk", F.coalesce("before", F.lit(0)).alias("before")), "token-starts")
    if starts.count() <= BROADCAST_ROWS:  # else the files are joined to their starts by a shuffle
        starts = F.broadcast(starts)
    placed = files.select("chunk", "ids", "known", "file").join(starts, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, file, before in zip(*(batch.column(i) for i in range(4)), strict=True):
                values, ends = read_file(file.as_buffer().to_pybytes())
                data = memoryview(values.astype("<u4").tobytes())
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc = pa.array(np.frombuffer(ids.as_buffer(), np.int64), mask=~np.frombuffer(known.as_buffer(), bool))
                yield pa.RecordBatch.from_arrays([doc, pa.array(starts + before.as_py()), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("ids", "known", "file", "before").mapInArrow(common.each(run), RESULT)
