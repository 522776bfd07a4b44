"""Vectorised words and shingles of Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. A word's hash is a polynomial over a random byte alphabet modulo
2**64, taken from prefix sums, so a batch needs no loop over words. Such
polynomials collide on some words of a thousand letters whatever the base and
alphabet, so words over LONG_WORD bytes are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one pass of the kernel holds; longer texts go alone.
SLICE_BYTES = 1 << 19
SHINGLE = 5
LONG_WORD = 64

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ALPHABET = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ALPHABET[65:91] = _ALPHABET[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_STEP = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; a worker keeps those that a slice needs, longer texts make their own."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= SLICE_BYTES + 1:
            _powers[kind] = have
    return have[:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (and the last ends); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of some texts: ``hash``, byte ``start`` and ``end``, row ``doc``; ``first`` and ``count`` by row."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _WHITE):
        buf, at = raw(texts)
        n = len(buf)
        self.buf, self.at = buf, at
        white = separators[buf]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        prev = np.ones(n, bool)
        prev[1:] = white[:-1]
        start = np.flatnonzero(~white & (prev | edge[:-1]))
        after = np.ones(n, bool)
        after[:-1] = white[1:]
        end = np.flatnonzero(~white & (after | edge[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_ALPHABET[buf] * power("up", BASE, n), out=total[1:])
        self.start, self.end, self.total = start, end, total
        self.hash = self.between(start, end)
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            word = buf[start[i] : end[i]].tobytes().lower()  # of bytes: A-Z alone
            self.hash[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.doc = np.searchsorted(at, start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(at) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes between, wherever they stand."""
        return mix((self.total[end] - self.total[start]) * power("down", INVERSE, len(self.total))[start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those that leave the text are to be ignored."""
        size = max(0, len(self.hash) - n + 1)
        out = np.zeros(size, np.uint64)
        for k in range(n):
            out += self.hash[k : k + size] * _STEP[k % 5] ** _U(1 + k // 5)
        return mix(out)

    def shingle_sets(self) -> Iterator[np.ndarray]:
        """By row: the sorted distinct shingle hashes; fewer words than a shingle make one of them all."""
        grams = self.grams(SHINGLE)
        for first, count in zip(self.first, self.count):
            if count >= SHINGLE:
                yield np.unique(grams[first : first + count - SHINGLE + 1])
            elif count:
                short = np.array([count], np.uint64)
                for k in range(count):
                    short = mix(short * _STEP[4] + self.hash[first + k])
                yield short
            else:
                yield np.zeros(0, np.uint64)
