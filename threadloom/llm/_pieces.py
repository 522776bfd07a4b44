"""Ids of whole texts from a byte-level tokenizer, each distinct piece encoded once.

A byte-level tokenizer cuts a text into pieces (letters, digits, marks or white
space, mostly with a space before) and encodes each alone. Numpy finds places
where it surely cuts, hashes what lies between and looks the hashes up in a
table of fixed size; only pieces that are not there go through the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadloom.llm._store import kept
from threadloom.llm._words import BASE, INVERSE, SLICE_BYTES, mix, power, raw

#: Places of the table, and ids that it holds: 27 MB and 16 MB in each Python worker.
PLACES_BITS, STORED_IDS = 21, 1 << 23
#: Pieces of more bytes are encoded each time.
LONGEST = 64

_U = np.uint64
_ALPHABET = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE, _LETTER, _DIGIT, _QUOTE, _MARK, _OTHER = range(6)
_KIND = np.array([_OTHER if i > 127 else _SPACE if i in (32, 9, 10, 11, 12, 13) else _LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _QUOTE if i == 39 else _MARK for i in range(256)], np.uint8)
#: [kind before, kind here]: a piece surely ends between. A quote may begin a contraction, other bytes may be anything.
_ENDS = np.zeros((6, 6), bool)
_ENDS[_LETTER, [_DIGIT, _QUOTE, _MARK]] = _ENDS[_DIGIT, [_LETTER, _QUOTE, _MARK]] = _ENDS[_MARK, [_LETTER, _DIGIT]] = True
_ENDS = _ENDS.reshape(-1)
#: White space of three bytes outside U+2000 to U+200A.
_WIDE_SPACES = [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]


def _white(buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = kind == _SPACE
    lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    if len(lead):
        x, y, z = (np.concatenate([buf, [0, 0]])[lead + k].astype(np.int32) for k in range(3))
        code = (x << 16) | (y << 8) | z
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        three = ((code >= 0xE28080) & (code <= 0xE2808A)) | np.isin(code, _WIDE_SPACES)
        for k, which in enumerate((two | three, two | three, three)):
            white[lead[which] + k] = True
    return white


def piece_starts(buf: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that begin ``at``; those of the rows ``whole`` stay uncut."""
    n = len(buf)
    kind = _KIND[buf]
    white = _white(buf, kind)
    first = np.zeros(n + 1, bool)
    first[at] = True
    cut = np.zeros(n, bool)
    if n:
        cut[1:] = _ENDS[kind[:-1] * np.uint8(6) + kind[1:]]
        cut[1:] |= white[1:] & ~white[:-1]
        # a single white character other than a space is a piece of its own
        lone = (kind == _SPACE) & (buf != 32)
        lone[1:] &= ~white[:-1] | first[1:n]
        cut[1:] |= lone[:-1] & ~white[1:]
        for i in np.flatnonzero(whole):
            cut[at[i] : at[i + 1]] = False
    return np.flatnonzero(cut | first[:n])


def _byte_letters() -> dict[int, str]:
    """The characters for which byte-level vocabularies write each byte: printable Latin-1 as it is, the others from 256 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """The tokenizer of a file, and the ids of pieces seen so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        pre = self.tokenizer.pre_tokenizer
        #: Whether texts may be cut as ``piece_starts`` does.
        self.cuts = self.tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        size = 1 << PLACES_BITS
        self.keys, self.start, self.size = np.zeros(size, _U), np.zeros(size, np.int32), np.zeros(size, np.uint8)
        self.ids, self.used = np.zeros(STORED_IDS, self.width), 0

    def _by_library(self, pieces: list[bytes]) -> list:
        """Ids of pieces; one of ASCII letters, which the tokenizer hands to its model whole, goes there directly."""
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if self.cuts and p.isascii() and len(p) <= LONGEST and p.lstrip(b" ").isalpha() and p[1:2] != b" ":
                out[i] = [t.id for t in self.model.tokenize(p.decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _section(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring pieces, and how many each has."""
        begin, n = int(start[0]), int(end[-1] - start[0])
        total = np.zeros(n + 1, _U)
        np.cumsum(_ALPHABET[buf[begin : begin + n]] * power("up", BASE, n), out=total[1:])
        a, b = start - begin, end - begin
        size = b - a
        h = mix((total[b] - total[a]) * power("down", INVERSE, n + 1)[a] + size.astype(_U)) | _U(1)
        short = size <= LONGEST
        one, two = ((h * _U(k)) >> _U(64 - PLACES_BITS) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        one, two = one.astype(np.int64), two.astype(np.int64)
        at = np.where(self.keys[one] == h, one, two)
        known = short & (self.keys[at] == h)
        starts, sizes = self.start[at].astype(np.int64), self.size[at].astype(np.int64)
        ids = self.ids
        miss = np.flatnonzero(~known)
        if len(miss):
            # equal short pieces once, each long one by itself
            name = np.where(short[miss], h[miss], _U(2) * np.arange(len(miss), dtype=_U))
            _, first, which = np.unique(name, return_index=True, return_inverse=True)
            rows = miss[first]
            found = self._by_library([buf[x:y].tobytes() for x, y in zip(start[rows].tolist(), end[rows].tolist())])
            m = np.array([len(x) for x in found], np.int64)
            flat = np.fromiter((i for x in found for i in x), self.width, int(m.sum()))
            if self.used + len(flat) > len(self.ids):  # forget all rather than grow; what this section knew stays valid in ``ids``
                ids = np.concatenate([self.ids[: self.used], flat])
                base, self.used = self.used, 0
                self.keys[:] = 0
            else:
                base = self.used
                self.ids[base : base + len(flat)] = flat
                self.used += len(flat)
                keep = np.flatnonzero(short[rows] & (m < 256))
                slot = np.where(self.keys[one[rows[keep]]] == 0, one[rows[keep]], two[rows[keep]])
                slot, k = np.unique(slot, return_index=True)
                keep = keep[k]
                self.keys[slot], self.start[slot], self.size[slot] = h[rows[keep]], (base + np.cumsum(m) - m)[keep], m[keep]
            starts[miss], sizes[miss] = (base + np.cumsum(m) - m)[which], m[which]
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))], sizes

    def encode(self, texts: pa.Array, added_tokens: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has; null is empty.

        ``added_tokens``: those of the tokenizer's file that stand in a text
        are tokens, as in the library's plain call; otherwise they are text.
        """
        self.tokenizer.encode_special_tokens = not added_tokens
        buf, at = raw(texts)
        whole = np.full(len(texts), not self.cuts)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        start = piece_starts(buf, at, whole)
        end = np.append(start[1:], len(buf))
        ids, sizes = [np.zeros(0, self.width)], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE_BYTES, "right")))
            part = self._section(buf, start[lo:hi], end[lo:hi])
            ids.append(part[0])
            sizes.append(part[1])
            lo = hi
        doc = np.searchsorted(at, start, "right") - 1
        return np.concatenate(ids), np.bincount(doc, np.concatenate(sizes), len(texts)).astype(np.int64)


def encoder(path: str) -> Encoder:
    """One for each tokenizer file in a Python worker."""
    memory = kept("tokens")
    if path not in memory:
        memory[path] = Encoder(path)
    return memory[path]
