"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The vocabulary and merges come from a public tokenizer file. Words that a worker hasn't met are merged together: their
symbols lie in one flat array beside the ranks of neighbouring pairs, which a binary search over the sorted pair keys
gives. Each round takes the lowest rank of every word, merges its occurrences from the left and searches anew only beside
the merged places. A word of more than LONG bytes would take a round for each of thousands of ranks; its pairs wait in a
heap by rank and place instead, which merges them in the same order. Encoded words are remembered (WORDS of them at most,
then the memory starts anew: a bound on memory alone), so a text costs a lookup per word.

Text is cut at single spaces between two characters other than white space before the file's own splitting pattern is
applied: no match of the pattern reaches over such a place, except that it begins with the space.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens written in a text get their
ids, as the library does by default; bytes that aren't UTF-8 after decoding become replacement characters; rows are kept
one for one, whatever doc_id; other columns are ignored (the stage function keeps them); no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside a space, or at an end: then a text is not cut at its spaces.
UNEVEN = regex.compile(r"\s \s?|^ | $| \s")
WORDS = 300_000
LONG = 4096
NONE = np.iinfo(np.int32).max

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: For each id its decimal digits, and its bytes.
        top = max(self.bytes_of) + 1
        self.digits = [str(i) for i in range(top)]
        self.bytes_at = [self.bytes_of.get(i, b"") for i in range(top)]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        #: Ids, as packed 32-bit numbers, of a piece that follows a cut.
        self.entry: dict[str, bytes] = {}

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE for those that never merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words, all merged together."""
        done = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG:
                done[k] = self.merge_long(w)
            elif w:
                short.append(k)
        sizes = np.array([len(words[k]) for k in short], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        word = np.repeat(np.array(short, np.int32), sizes)
        rank = np.full(len(flat), NONE, np.int32)
        if len(flat) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranked(flat[:-1], flat[1:]), NONE)
        while len(flat):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, heads)
            ended = low == NONE
            tails = np.append(heads[1:], len(flat))
            if ended.any():
                packed = flat.astype("<u4").tobytes()
                for w, i, j in zip(word[heads[ended]].tolist(), heads[ended].tolist(), tails[ended].tolist(), strict=True):
                    done[w] = packed[4 * i : 4 * j]
            spans = tails - heads
            place = np.flatnonzero((rank == np.repeat(low, spans)) & (rank != NONE))
            if not len(place):
                break
            # of occurrences that overlap, every other one from the left
            fresh = np.append(True, np.diff(place) != 1)
            start = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
            place = place[(place - start) % 2 == 0]
            flat[place] = self.merged[rank[place]]
            keep = np.repeat(~ended, spans)
            keep[place + 1] = False
            at = (np.cumsum(keep) - 1)[place]
            flat, word, rank = flat[keep], word[keep], rank[keep]
            # only pairs that hold a merged symbol have a new rank
            changed = np.zeros(len(flat), bool)
            changed[at], changed[at[at > 0] - 1] = True, True
            if changed[-1]:
                changed[-1], rank[-1] = False, NONE
            beside = np.flatnonzero(changed)
            rank[beside] = np.where(word[beside] == word[beside + 1], self.ranked(flat[beside], flat[beside + 1]), NONE)
        return done

    def merge_long(self, word: bytes) -> bytes:
        """The packed ids of one long word: the lowest rank first, of equal ranks the leftmost place."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        first = self.ranked(ids[:-1], ids[1:]).tolist()
        keys, ranks, merged = self.keys.tolist(), self.ranks, self.merged
        symbols: list[int | None] = ids.tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [*first, NONE]
        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def judge(i: int) -> None:
            j = after[i]
            now[i] = NONE
            if j < n:
                key = symbols[i] << 32 | symbols[j]
                at = bisect_left(keys, key)
                if at < len(keys) and keys[at] == key:
                    now[i] = int(ranks[at])
                    heapq.heappush(heap, (now[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank or symbols[i] is None:
                continue
            j = after[i]
            symbols[i], symbols[j] = int(merged[rank]), None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            judge(i)
            if before[i] >= 0:
                judge(before[i])
        return np.array([x for x in symbols if x is not None], "<u4").tobytes()

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of pieces of text without special tokens."""
        split = [PATTERN.findall(p) for p in pieces]
        new = list({w for ws in split for w in ws})
        known = dict(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        return [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in split]

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded alone; special tokens are parts of their own."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for p in parts:
            if p in self.special or not p:
                out += [p] if p else []
            elif UNEVEN.search(p):
                out.append(p)
            else:
                head, *rest = p.split(" ")
                out.append(head)
                out += [" " + r for r in rest]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        if len(self.entry) > WORDS:
            self.clear()
        split = [self.pieces(t) for t in texts]
        entry = self.entry
        new = list({p for ps in split for p in ps if p not in entry})
        plain = [p for p in new if p not in self.special]
        entry.update(zip(plain, self.ids_of_pieces(plain), strict=True))
        entry.update((p, np.array([self.special[p]], "<u4").tobytes()) for p in new if p in self.special)
        get = entry.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)), "<u4").tolist() for ps in split]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_at.__getitem__, ids))

    def encode_ids(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.encode([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def model(path: str) -> Bpe:
    """This process's model of a tokenizer file."""
    return common.held(path, lambda: Bpe(path))


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text that they decode to."""
    common.session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                n, ids, texts = [], [], []
                for found in bpe.encode(batch.column(1).to_pylist()):
                    n.append(len(found))
                    ids.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, found)).encode()).hexdigest())
                    texts.append(hashlib.sha256(bpe.decode(found).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(common.each(run, tokenizer), RESULT)
