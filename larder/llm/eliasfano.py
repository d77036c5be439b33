"""Elias-Fano sequences and the two-level n-gram trie on them, as numpy arrays in one file."""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

WORD = 64


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, in 64-bit words."""
    if width == 0 or not len(values):
        return np.zeros(1, dtype=np.uint64)
    bit = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, shift = (bit // WORD).astype(np.int64), bit % np.uint64(WORD)
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    np.bitwise_or.at(out, word, values << shift)
    over = shift + np.uint64(width) > WORD
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(WORD) - shift[over]))
    return out


def _unpacked(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), dtype=np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit // WORD).astype(np.int64), bit % np.uint64(WORD)
    out = words[word] >> shift
    over = shift + np.uint64(width) > WORD
    out[over] |= words[word[over] + 1] << (np.uint64(WORD) - shift[over])
    return out & np.uint64((1 << width) - 1)


class EliasFano:
    """A sorted sequence of n values below 2**64: low bits packed, high bits in unary.

    The unary bits are a one for each value after a zero for each step of the high part; a
    directory of ones and zeros before each 64-bit word serves rank and select.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * WORD - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        steps = (values >> np.uint64(width)).astype(np.int64) if width < WORD else np.zeros(n, np.int64)
        bits = steps + np.arange(n)
        high = np.zeros((int(bits[-1]) if n else 0) // WORD + 2, dtype=np.uint64)
        np.bitwise_or.at(high, bits // WORD, np.uint64(1) << (bits % WORD).astype(np.uint64))
        low = _packed(values & np.uint64((1 << width) - 1), width)
        return cls(n, width, low, high)

    def _select(self, directory: np.ndarray, bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Position of the one (or zero, with the bits turned) of each rank, counted from 0."""
        word = np.searchsorted(directory, rank, side="right") - 1
        left = rank - directory[word]
        value, at = bits[word], np.zeros(len(rank), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            part = value >> at & np.uint64((1 << half) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            go = left >= count
            left = np.where(go, left - count, left)
            at = np.where(go, at + np.uint64(half), at)
        return word * WORD + at.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._select(self.ones, self.high, i) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | _unpacked(self.low, i, self.width)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x (n if there is none)."""
        if not self.n or not len(x):
            return np.zeros(len(x), dtype=np.int64)
        step = (x >> np.uint64(self.width)).astype(np.int64)
        last = int(self.zeros[-1])
        beyond = step >= last  # more steps than the unary bits have zeros
        step = np.minimum(step, last - 1)
        # values with this high part stand between the zeros number step - 1 and step
        end = self._select(self.zeros, ~self.high, step) - step
        begin = np.where(step > 0, self._select(self.zeros, ~self.high, np.maximum(step - 1, 0)) - step + 1, 0)
        begin, end = np.minimum(begin, self.n), np.minimum(end, self.n)
        low = x & np.uint64((1 << self.width) - 1) if self.width else np.zeros(len(x), np.uint64)
        while True:  # binary search among the low bits, all queries at once
            live = np.flatnonzero(begin < end)
            if not len(live):
                break
            mid = (begin[live] + end[live]) // 2
            less = _unpacked(self.low, mid, self.width) < low[live]
            begin[live] = np.where(less, mid + 1, begin[live])
            end[live] = np.where(less, end[live], mid)
        return np.where(beyond, self.n, begin)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, or -1."""
        at = self.successor(x)
        there = at < self.n
        there[there] = self.get(at[there]) == x[there]
        return np.where(there, at, -1)


class Mapped:
    """Named arrays in one memory-mapped file of the task's own folder. The file has no name any
    more once it is mapped: nothing is left behind, however the task ends."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            at, self.places = 0, {}
            with os.fdopen(handle, "w+b") as f:
                for name, a in arrays.items():
                    data = np.ascontiguousarray(a).tobytes()
                    self.places[name] = (at, a.dtype, len(a))
                    f.write(data)
                    f.write(b"\0" * (-len(data) % 8))
                    at += len(data) + -len(data) % 8
                f.write(b"\0" * 8)
                f.flush()
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)

    def __getitem__(self, name: str) -> np.ndarray:
        at, kind, n = self.places[name]
        return np.frombuffer(self.map, dtype=kind, count=n, offset=at)


class Trie:
    """Words and, below each, the words seen before it, with quantised log10 probabilities.

    Level 1: the sorted word keys (64-bit hashes) as an Elias-Fano sequence, with exact counts.
    Pointers: where the children of each word begin, a monotone Elias-Fano sequence.
    Level 2: the keys of the words before, as their rank among all of the shard's (an Elias-Fano
    sequence too); with the parent's number times the number of ranks added, all children together
    are one sorted sequence, so a child is found by the successor of that sum: relative to its
    context, in one search, and it must lie between the parent's pointers.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, parent: np.ndarray, before: np.ndarray,
                 logs: np.ndarray, levels: int = 256):
        """words: sorted distinct keys, counts: of each; parent, before: index of the word and key of
        the word before it, sorted by both; logs: log10 of each child's probability mass."""
        ranks = np.unique(before)
        self.ranks = len(ranks)
        child = parent.astype(np.uint64) * np.uint64(max(self.ranks, 1)) + np.searchsorted(ranks, before).astype(
            np.uint64)
        self.low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        self.bin = (high - self.low) / (levels - 1) or 1.0
        codes = np.rint((logs - self.low) / self.bin).astype(np.uint8)
        pointers = np.searchsorted(parent, np.arange(len(words) + 1))
        sequences = {"words": EliasFano.of(words), "before": EliasFano.of(ranks), "child": EliasFano.of(child),
                     "pointers": EliasFano.of(pointers)}
        arrays = {"counts": counts.astype(np.int64), "codes": codes}
        for name, s in sequences.items():
            arrays |= {f"{name}.low": s.low, f"{name}.high": s.high}
        self.file = Mapped(arrays)  # from here on the levels are read from the file
        for name, s in sequences.items():
            setattr(self, name, EliasFano(s.n, s.width, self.file[f"{name}.low"], self.file[f"{name}.high"]))
        self.counts, self.codes = self.file["counts"], self.file["codes"]

    def word(self, keys: np.ndarray) -> np.ndarray:
        return self.words.find(keys)

    def mass(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 mass stored for (word index, key of the word before), nan if the pair is not there."""
        out = np.full(len(word), np.nan)
        rank = self.before.find(before)
        ask = np.flatnonzero((word >= 0) & (rank >= 0))
        sums = word[ask].astype(np.uint64) * np.uint64(max(self.ranks, 1)) + rank[ask].astype(np.uint64)
        at = self.child.successor(sums)
        begin, end = (self.pointers.get(word[ask] + k).astype(np.int64) for k in (0, 1))
        there = (at >= begin) & (at < end)
        there[there] = self.child.get(at[there]) == sums[there]
        out[ask[there]] = self.low + self.codes[at[there]] * self.bin
        return out
