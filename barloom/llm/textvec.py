"""Vectorised text kernels: numpy over the UTF-8 bytes of many whole documents at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which equals the code-point rule
``[^\\x20\\x09-\\x0D]+`` because those bytes never occur inside a multi-byte character.
Hashes are 64-bit; two different words or shingles are taken as equal only if their hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer document is still handled whole.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK = np.zeros(256, np.int64)
_MARK[[ord(c) for c in "!\"'),.:;?]}"]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(1 << log_size, _BASE, U64)
    down = np.full(1 << log_size, _BASE_INVERSE, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(batch_texts: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts of about ``limit`` bytes
    and at most ``most`` texts; null is empty."""
    if isinstance(batch_texts, pa.ChunkedArray):
        batch_texts = batch_texts.combine_chunks()
    arr = pc.fill_null(batch_texts.cast(pa.large_string()), "")
    if not len(arr):
        return
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(arr):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), first + most, len(arr))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of the texts of a slice: byte ``starts`` and ``ends``, the ``doc`` of each, 64-bit ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = data = _LOWER[data] if lower else data
        self.n_docs, n = len(offsets) - 1, len(data)
        self.per_doc = np.zeros(self.n_docs, np.int64)
        self.starts = self.ends = self.doc = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, U64)
        if not n:
            return
        word = ~_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | begins[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | begins[1:n]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        edges = np.searchsorted(self.starts, offsets)
        self.per_doc = np.diff(edges)
        self.doc = np.repeat(np.arange(self.n_docs), self.per_doc)
        up, down = _powers(max(20, int(n).bit_length()))
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[data] * up[:n], out=sums[1:])
        self._sums, self._down = sums, down
        self.hashes = self.span_hashes(self.ends)

    def span_hashes(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to ``ends``."""
        if not len(ends):
            return np.zeros(0, U64)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._down[self.starts] + (ends - self.starts).astype(U64))

    def stripped_ends(self) -> np.ndarray:
        """Ends of the words without up to three closing ASCII marks; a word of marks keeps one."""
        ends = self.ends.copy()
        for _ in range(3):
            ends -= _MARK[self.data[ends - 1]] & (ends - self.starts > 1)
        return ends

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word (and the end)."""
        return np.concatenate([[0], np.cumsum(self.per_doc)])


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, index of the first word) of every word shingle, repeats kept, in text order.
    A text of fewer than ``size`` words has its whole sequence as one; one without words has none."""
    h, n = words.hashes, len(words.hashes)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none
    out, doc, at = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >= size:
        m = n - size + 1
        acc = np.zeros(m, U64)
        for k in range(size):
            acc = acc * U64(0xD6E8FEB86659FD93) + h[k : k + m]
        at = np.flatnonzero(words.doc[:m] == words.doc[size - 1 :])
        out, doc = mix(acc[at]), words.doc[at]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < size))
    if len(short):
        first, extra = words.first, []
        for d in short:
            acc = int(words.per_doc[d])
            for x in h[first[d] : first[d + 1]]:
                acc = (acc * 0xD6E8FEB86659FD93 + int(x)) % 2**64
            extra.append(acc)
        out = np.concatenate([out, mix(np.array(extra, U64))])
        doc, at = np.concatenate([doc, short]), np.concatenate([at, first[short]])
        order = np.argsort(doc, kind="stable")
        out, doc, at = out[order], doc[order], at[order]
    return out, doc, at


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without a text's repeats; by text, in first-occurrence order."""
    if not len(hashes):
        return hashes, doc
    keep = np.unique(hashes ^ mix(doc.astype(U64) + U64(0x51)), return_index=True)[1]
    keep.sort()
    return hashes[keep], doc[keep]
