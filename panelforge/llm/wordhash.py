"""Vectorised word and word-n-gram hashes over packed UTF-8 texts.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial in a fixed odd base modulo
2**64, read off a running sum, then mixed; an n-gram's hash is built the same way from its words' hashes. No Python
object is made for a word, so memory is a few arrays as long as the block.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters and digits only: ASCII punctuation parts words too.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the polynomials: bytes of a word, words of a gram, and the second, checking form.
BYTE_BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bytes hashed at a time; a longer word is hashed in parts.
BLOCK = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = x ^ (x >> np.uint64(shift))
        if odd > 1:
            x *= np.uint64(odd)
    return x


def word_bounds(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word; offsets (one more than documents) part the documents, and bytes marked in parts the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    word = ~parts[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:]
    ends = ends[ends > 0] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)


def _long_word(part: np.ndarray) -> np.uint64:
    """The polynomial of a word longer than BLOCK, part by part."""
    total = 0
    up, _ = powers(BYTE_BASE, BLOCK)
    for at in range(0, len(part), BLOCK):
        piece = part[at : at + BLOCK].astype(np.uint64)
        with np.errstate(over="ignore"):
            total += int(np.sum((piece + np.uint64(1)) * up[: len(piece)])) * pow(BYTE_BASE, at, 1 << 64)
    return np.uint64(total % (1 << 64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hash of each word, block by block; a block ends at the end of a word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        part = data[lo:hi]
        if lower:
            part = LOWER[part]
        if hi - lo > BLOCK:
            out[at] = _long_word(part)
            at = to
            continue
        up, down = powers(BYTE_BASE, BLOCK)
        with np.errstate(over="ignore"):
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            out[at:to] = (sums[ends[at:to] - lo] - sums[starts[at:to] - lo]) * down[starts[at:to] - lo]
        at = to
    return mix(out)


def gram_hashes(words: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of the n words from each position on; positions near the end give fewer entries."""
    many = len(words) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    out = words[n - 1 :].copy()
    for k in range(n - 2, -1, -1):
        out *= np.uint64(base)
        out += words[k : k + many]
    out += np.uint64(n)
    return mix(out)


def grams_within(docs: np.ndarray, n: int) -> np.ndarray:
    """Which gram positions lie in one document; docs holds each word's document number."""
    if len(docs) < n:
        return np.zeros(0, bool)
    return docs[: len(docs) - n + 1] == docs[n - 1 :]


def planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values by byte position, highest first: the high planes are long runs and compress well."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(np.uint64)
