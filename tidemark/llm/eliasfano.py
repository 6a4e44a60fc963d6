"""Monotone sequences in Elias-Fano form, over arrays that may be memory-mapped."""

from __future__ import annotations

from pathlib import Path

import numpy as np


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, one after another in 64-bit words; a spare word ends them."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if not width or not len(values):
        return out
    bit = np.arange(len(values)) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift > 64 - width)  # at most one value of each word goes on in the next
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A non-decreasing sequence below 2**top: the low bits of each value, and the counts of the rest in unary."""

    def __init__(self, values: np.ndarray, top: int):
        n = len(values)
        self.n, self.top = n, top
        self.width = max(0, top - max(1, int(n).bit_length()))
        self.low = pack(values & np.uint64((1 << self.width) - 1), self.width) if n else np.zeros(2, np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        bits = np.zeros((n + (1 << (top - self.width)) + 64) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))]).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))]).astype(np.int64)

    def map_to(self, folder: Path, name: str) -> EliasFano:
        """The same sequence with its arrays in files that are mapped into memory."""
        for part in ("low", "high", "zeros", "ones"):
            np.save(folder / f"{name}-{part}.npy", getattr(self, part))
            setattr(self, part, np.load(folder / f"{name}-{part}.npy", mmap_mode="r"))
        return self

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th bit of this kind, from 0."""
        ranks = self.ones if bit else self.zeros
        out = np.zeros(len(k), np.int64)
        for lo in range(0, len(k), 1 << 15):
            part = k[lo : lo + (1 << 15)]
            word = np.searchsorted(ranks, part, "right") - 1
            bits = np.unpackbits(np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            seen = np.cumsum(bits if bit else 1 - bits, axis=1, dtype=np.uint8)
            out[lo : lo + (1 << 15)] = (word << 6) + (seen > (part - ranks[word])[:, None]).argmax(axis=1)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at.astype(np.int64), 1) - at
        return high.astype(np.uint64) << np.uint64(self.width) | unpack(self.low, self.width, at)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        at = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n] - at
        return high.astype(np.uint64) << np.uint64(self.width) | unpack(self.low, self.width, at)

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """First place from lo on, hi at most, whose value is x or more; values from lo to hi must not decrease."""
        h = (x >> np.uint64(self.width)).astype(np.int64)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - np.maximum(h - 1, 0), 0)
        end = self._select(h, 0) - h
        hi = np.full(len(x), self.n) if hi is None else hi
        start, end = np.clip(start, lo, hi), np.clip(end, lo, hi)
        low = x & np.uint64((1 << self.width) - 1)
        while (go := np.flatnonzero(start < end)).size:
            mid = (start[go] + end[go]) >> 1
            less = unpack(self.low, self.width, mid) < low[go]
            start[go] = np.where(less, mid + 1, start[go])
            end[go] = np.where(less, end[go], mid)
        return start
