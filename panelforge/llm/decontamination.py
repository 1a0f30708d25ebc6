"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased in A-Z. The benchmark is taken in blocks of BLOCK_BYTES of text; a
block's grams go to every task (that is the bound on what is broadcast), and further blocks are further passes. Every gram
of an item is a seed, since what an edit leaves of a copy may be the item's commonest grams. A pass finds seeds in documents,
gives each a window of the document where the item would lie, merges windows that meet, and aligns item and window word by
word. A pair is reported if its best window's score reaches LEAST of the item's own; it needs one run of N common words.

A window can hold as many matches as it shares words with the item, so windows that share too few are left out before
alignment; that loses nothing. Nothing is shuffled but pairs, so a passage in a third of all documents is no hot key.

Defined cases: a null text or an item without words matches nothing; items of fewer than N words have their whole text as
one gram; rows with equal doc_id are judged each and reported once with their best score; rows without doc_id are judged
and reported with a null doc_id; other columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import MARKS, gram_hashes, grams_within, mix, word_bounds, word_hashes

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
BLOCK_BYTES = 4 << 20
#: Bits of the table that is asked before the sorted grams.
TABLE_BITS = 20
#: Alignments made at once, and cells of one line of them.
LANES, CELLS = 64, 1 << 18

RESULT = "doc_id long, item_id long, score double, first_word long, last_word long, matched_words long"


@dataclass
class Items:
    """A block of the benchmark: each item's word hashes, and its grams (hash, item, offset) sorted by hash."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str], n: int) -> Items:
        words, grams, item, offset = [], [], [], []
        for i, t in enumerate(texts):
            data = np.frombuffer(t.encode(), np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]), MARKS)
            w = word_hashes(data, starts, ends, lower=True)
            words.append(w)
            g = gram_hashes(w, min(n, len(w))) if len(w) else w
            if 0 < len(w) < n:
                g = mix(g)
            grams.append(g)
            item.append(np.full(len(g), i))
            offset.append(np.arange(len(g)))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        return cls(ids, words, g[order], np.concatenate(item)[order] if item else np.zeros(0, np.int64), np.concatenate(offset)[order] if offset else np.zeros(0, np.int64))


class Finder:
    """Where the words of documents hold one of a sorted set of grams."""

    def __init__(self, grams: np.ndarray, lengths: list[int], n: int):
        self.grams, self.n = np.unique(grams), n
        self.short = sorted({k for k in lengths if 0 < k < n})
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and the grams there."""
        at, met = [], []
        for k in (self.n, *self.short):
            hashes = gram_hashes(words, k)
            if k < self.n:
                hashes = mix(hashes)
            near = np.flatnonzero(self.table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            near = near[grams_within(doc, k)[near]]
            place = np.minimum(np.searchsorted(self.grams, hashes[near]), max(0, len(self.grams) - 1))
            hit = near[self.grams[place] == hashes[near]] if len(self.grams) else near[:0]
            at.append(hit)
            met.append(hashes[hit])
        return np.concatenate(at), np.concatenate(met)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = common.binaries(batch.column(1))
    starts, ends, doc = word_bounds(data, offsets, MARKS)
    return word_hashes(data, starts, ends, lower=True), doc


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """For each pair the best local score, the window's first and last aligned word, and the number of matches."""
    out: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(items)
    todo = sorted(range(len(items)), key=lambda i: len(windows[i]))
    while todo:
        lanes = max(1, min(LANES, CELLS // max(1, len(windows[todo[-1]]))))
        todo, now = todo[:-lanes], todo[-lanes:]
        part, spans = [items[i] for i in now], [windows[i] for i in now]
        high, wide = max(map(len, part)), max(map(len, spans))
        text = np.zeros((len(part), wide), np.uint64)
        inside = np.zeros((len(part), wide), bool)
        for i, w in enumerate(spans):
            text[i, : len(w)], inside[i, : len(w)] = w, True
        ramp = np.arange(wide + 1) * -GAP
        score = np.zeros((len(part), wide + 1), np.int64)
        begin = np.tile(np.arange(wide + 1), (len(part), 1))
        hits = np.zeros_like(score)
        best = np.zeros((len(part), 4), np.int64)
        rows = np.arange(len(part))
        for r in range(high):
            live = np.array([r < len(p) for p in part])
            word = np.array([p[r] if r < len(p) else 0 for p in part], np.uint64)
            same = (text == word[:, None]) & inside & live[:, None]
            diagonal = score[:, :-1] + np.where(same, MATCH, MISMATCH)
            upper = score[:, 1:] + GAP
            take = diagonal >= upper
            step = np.where(take, diagonal, upper)
            from_, met = np.where(take, begin[:, :-1], begin[:, 1:]), np.where(take, hits[:, :-1] + same, hits[:, 1:])
            fresh = step <= 0
            step, from_, met = np.where(fresh, 0, step), np.where(fresh, np.arange(1, wide + 1), from_), np.where(fresh, 0, met)
            # a gap in the item: the best cell to the left, less its distance
            lifted = step + ramp[1:]
            top = np.maximum.accumulate(lifted, axis=1)
            source = np.maximum.accumulate(np.where(lifted == top, np.arange(wide), 0), axis=1)
            new = top - ramp[1:]
            score[:, 1:] = np.where(live[:, None], np.where(inside, new, 0), score[:, 1:])
            begin[:, 1:] = np.where(live[:, None], np.take_along_axis(from_, source, 1), begin[:, 1:])
            hits[:, 1:] = np.where(live[:, None], np.take_along_axis(met, source, 1), hits[:, 1:])
            end = np.argmax(score[:, 1:], axis=1)
            value = score[rows, end + 1]
            better = live & (value > best[:, 0])
            best[better] = np.stack([value, begin[rows, end + 1], end, hits[rows, end + 1]], 1)[better]
        for i, b in zip(now, best.tolist(), strict=True):
            out[i] = tuple(b)
    return out


def _pairs(docs: DataFrame, items: Items, n: int, least: float) -> DataFrame:
    lengths = [len(w) for w in items.words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items.grams, lengths, n)
        sorted_words = [np.sort(w) for w in items.words]
        for batch in batches:
            words, doc = _words(batch)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            at, met = finder.find(words, doc)
            lo, hi = np.searchsorted(items.grams, met, "left"), np.searchsorted(items.grams, met, "right")
            repeat = hi - lo
            entry = np.repeat(lo, repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            place, item = np.repeat(at, repeat), items.item[entry]
            size = np.array(lengths, np.int64)[item]
            slack = 2 + size // 4
            owner = doc[place]
            begin = np.maximum(first[owner], place - items.offset[entry] - slack)
            end = np.minimum(first[owner + 1], place - items.offset[entry] + size + slack)
            order = np.lexsort((begin, item, owner))
            windows: list[list[int]] = []
            for o, i, b, e in zip(owner[order].tolist(), item[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
                if windows and windows[-1][0] == o and windows[-1][1] == i and b <= windows[-1][3]:
                    windows[-1][3] = max(e, windows[-1][3])
                else:
                    windows.append([o, i, b, e])
            kept = []
            for o, i, b, e in windows:
                own = sorted_words[i]
                there = np.unique(words[b:e])
                if MATCH * np.isin(own, there).sum() >= least * MATCH * len(own):
                    kept.append((o, i, b, e))
            found = align([items.words[i] for _, i, _, _ in kept], [words[b:e] for _, _, b, e in kept])
            best: dict[tuple[int, int], tuple] = {}
            for (o, i, b, _), (value, start, stop, hits) in zip(kept, found, strict=True):
                score = value / (MATCH * len(items.words[i]))
                if score >= least and score > best.get((o, i), (0.0,))[0]:
                    best[o, i] = (score, int(b + start - first[o]), int(b + stop - first[o]), hits)
            ids = batch.column(0).to_pylist()
            yield common.arrow_table([(ids[o], items.ids[i], *rest) for (o, i), rest in best.items()], RESULT).to_batches(max_chunksize=None)[0] if best else pa.RecordBatch.from_pylist([], schema=common.arrow_table([], RESULT).schema)

    return docs.mapInArrow(common.each(run), RESULT)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of bounded text, in ascending item order; a longer item is a block of its own."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text")).filter("item_id IS NOT NULL").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if ids and size + len(r.text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id) with the alignment's score (1: the whole item, unchanged) and where it lies, in words."""
    common.session_setup(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    out = None
    for ids, texts in blocks_of(benchmark, block_bytes):
        items = Items.of(ids, texts, n)
        pairs = _pairs(docs, items, n, least)
        out = pairs if out is None else out.unionByName(pairs)
    best = F.max(F.struct("score", "first_word", "last_word", "matched_words")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.round("best.score", 6).alias("score"), "best.first_word", "best.last_word", "best.matched_words")
