"""Vectorised word and window hashing over batches of whole texts.

Words are maximal runs of characters other than space and ``\\t\\n\\v\\f\\r``.
All functions work on one Arrow batch at a time: the texts' bytes lie in one
buffer, and words, windows and their hashes are numpy arrays over it, so no
Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, _BASE, np.uint64)]), dtype=np.uint64)
_BYTES = np.random.RandomState(7).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads all bits of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts: ``hashes``, and for text i its words ``first[i]:first[i + 1]``.

    ``begin`` and ``end`` are the words' byte offsets in ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.offsets, self.data = offsets - offsets[0], data
        if lower:
            data = _LOWER[data]
        inside = ~_SEPARATOR[data]
        # a word also begins where a text begins
        breaks = np.zeros(len(data) + 1, bool)
        breaks[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.begin = np.flatnonzero(inside & (~before | breaks[:-1]))
        self.end = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        self.first = np.searchsorted(self.begin, self.offsets)
        self.bytes = data
        self.hashes = self.hashed()

    def hashed(self) -> np.ndarray:
        """Hashes of what stands from ``begin`` to ``end``, in small letters if so asked."""
        data, n = self.bytes, len(self.begin)
        if not n:
            return np.zeros(0, np.uint64)
        size = self.end - self.begin
        out = np.zeros(n, np.uint64)
        # Horner's rule over the k-th byte of all words that have one
        order = np.argsort(-size, kind="stable")
        begin, size = self.begin[order], size[order]
        k, acc = 0, np.zeros(n, np.uint64)
        alive = n
        while True:
            alive = int(np.searchsorted(-size[:alive], -k, side="left"))  # sizes over k come first
            if not alive:
                break
            acc[:alive] = acc[:alive] * _BASE + _BYTES[data[begin[:alive] + k]]
            k += 1
            if k >= 64 and alive < 64:
                for i in range(alive):  # a few very long words: one reduction each
                    acc[i] = _long(acc[i], data[begin[i] + k : begin[i] + size[i]])
                break
        out[order] = acc
        return mix(out)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _long(acc: np.uint64, tail: np.ndarray) -> np.uint64:
    powers = np.cumprod(np.full(len(tail), _BASE, np.uint64), dtype=np.uint64)
    terms = _BYTES[tail] * np.concatenate([[np.uint64(1)], powers[:-1]])[::-1]
    with np.errstate(over="ignore"):
        return np.uint64(acc * powers[-1] + terms.sum(dtype=np.uint64)) if len(tail) else acc


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive words, by doubling.

    H(2k)[i] combines H(k)[i] and H(k)[i + k]; a length between two powers takes
    two overlapping windows.  The result is shorter than the input by length - 1;
    windows that cross texts are the caller's to leave out.
    """
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    have, cur = 1, hashes
    while have * 2 <= length:
        cur = mix(cur[:-have] * _BASE + cur[have:])
        have *= 2
    if have < length:
        step = length - have
        cur = mix(cur[: len(cur) - step] * _POWERS[3] + cur[step:] + np.uint64(length))
    return cur
