"""Monotone sequences in Elias-Fano form, and an n-gram trie built from them, in numpy.

A sequence of n values below u keeps the low log2(u / n) bits of each value packed, and the high
bits as a unary bit vector with a rank directory. All questions are asked for many values at once.
"""

from __future__ import annotations

import os

import numpy as np

_CHUNK = 1 << 16
_LOW_BITS_MOST = 56


def _ones(words: np.ndarray) -> np.ndarray:
    """Bits of little-endian 64-bit words as rows of 0 and 1."""
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class EliasFano:
    """Values in non-decreasing order. Parts are plain arrays, so they can be memory-mapped."""

    PARTS = ("shape", "low", "high", "rank")

    def __init__(self, shape, low, high, rank):
        self.shape, self.low, self.high, self.rank = shape, low, high, rank
        self.n, self.bits = int(shape[0]), int(shape[1])

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values``: unsigned 64-bit, each below ``universe``."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = min(_LOW_BITS_MOST, max(0, (universe // max(n, 1)).bit_length() - 1))
        high_part = (values >> np.uint64(bits)).astype(np.int64)
        low_part = values & np.uint64((1 << bits) - 1)
        low = np.zeros((n * bits + 7) // 8 + 8, dtype=np.uint8)
        for at in range(0, n, _CHUNK):  # chunks of a multiple of eight values end on a byte
            part = low_part[at : at + _CHUNK]
            packed = np.packbits(
                ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"
            )
            low[at * bits // 8 : at * bits // 8 + len(packed)] = packed
        size = n + (int(high_part[-1]) if n else 0) + 1
        flags = np.zeros((size + 63) // 64 * 64 + 64, dtype=np.uint8)
        flags[high_part + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8").copy()
        counts = flags.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return cls(np.array([n, bits, size], dtype=np.int64), low, high, rank)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        view = np.ndarray((len(self.low) - 7,), dtype="<u8", buffer=self.low, strides=(1,))
        return (view[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of bit number ``k`` (from 0) among the ones, or the zeros."""
        directory = np.arange(len(self.rank)) * 64 - self.rank if zeros else self.rank
        out = np.empty(len(k), dtype=np.int64)
        for begin in range(0, len(k), _CHUNK):
            part = k[begin : begin + _CHUNK]
            word = np.searchsorted(directory, part, side="right") - 1
            bits = _ones(self.high[word])
            if zeros:
                bits = 1 - bits
            place = (np.cumsum(bits, axis=1, dtype=np.uint8) > (part - directory[word])[:, None]).argmax(axis=1)
            out[begin : begin + _CHUNK] = word * 64 + place
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, dtype=np.int64)
        high = (self._select(i, zeros=False) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value not below each of ``values`` (the successor), and whether it is
        equal. Among the values that share the high bits the low bits are searched in halves."""
        values = values.astype(np.uint64)
        if not self.n:
            return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.shape[2]) - self.n - 1  # the largest high part
        beyond = high > last
        high = np.minimum(high, last)
        begin = np.zeros(len(values), dtype=np.int64)
        inner = high > 0
        begin[inner] = self._select(high[inner] - 1, zeros=True) - (high[inner] - 1)
        end = np.minimum(self._select(high, zeros=True) - high, self.n)
        wanted = values & np.uint64((1 << self.bits) - 1)
        low, top = begin.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(low < top)
            if not len(open_):
                break
            middle = (low[open_] + top[open_]) // 2
            less = self._low(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            top[open_[~less]] = middle[~less]
        equal = np.zeros(len(values), dtype=bool)
        inside = np.flatnonzero((low < end) & ~beyond)
        equal[inside] = self._low(low[inside]) == wanted[inside]
        return np.where(beyond, self.n, low), equal


class Quantised:
    """Positive numbers as one byte each: cells of the sorted logarithms, read as their means."""

    def __init__(self, codes: np.ndarray, book: np.ndarray):
        self.codes, self.book = codes, book

    @classmethod
    def build(cls, numbers: np.ndarray) -> Quantised:
        logs = np.log10(np.maximum(numbers, 1e-300))
        distinct, place, count = np.unique(logs, return_inverse=True, return_counts=True)
        if len(distinct) <= 256:
            return cls(place.astype(np.uint8), distinct.copy())
        # Half of the cells by number of entries, half by range, so that no cell is wide.
        share = (np.cumsum(count) - count) / count.sum()
        span = (distinct - distinct[0]) / (distinct[-1] - distinct[0])
        cell = np.unique(np.floor(share * 128).astype(np.int64) + np.floor(span * 127).astype(np.int64), return_inverse=True)[1]
        weight = np.bincount(cell, count)
        return cls(cell[place].astype(np.uint8), np.bincount(cell, count * distinct) / weight)

    def read(self, i: np.ndarray) -> np.ndarray:
        return 10.0 ** self.book[self.codes[i]]


class Trie:
    """Two levels of n-grams. Level 1: contexts, a quantised back-off weight for each and a
    monotone pointer to its successors. Level 2: successors relative to their context, made
    monotone by the number of the context, with a quantised smoothed probability for each."""

    def __init__(self, alphabet: int, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, weight: Quantised, probability: Quantised):
        self.alphabet, self.contexts, self.pointers, self.successors = alphabet, contexts, pointers, successors
        self.weight, self.probability = weight, probability

    @classmethod
    def build(cls, alphabet: int, contexts: np.ndarray, weights: np.ndarray, first: np.ndarray, successors: np.ndarray, probabilities: np.ndarray) -> Trie:
        """Sorted distinct ``contexts`` (unsigned 64-bit) with ``weights``; ``first`` is the place
        of the first successor of each; ``successors`` (below ``alphabet``) sorted in each."""
        owner = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(successors))))
        combined = owner.astype(np.uint64) * np.uint64(alphabet) + successors.astype(np.uint64)
        return cls(
            alphabet,
            EliasFano.build(contexts, 1 << 64),
            EliasFano.build(np.append(first, len(successors)), len(successors) + 1),
            EliasFano.build(combined, max(1, len(contexts) * alphabet)),
            Quantised.build(weights),
            Quantised.build(probabilities),
        )

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(smoothed probability, 0 without an entry; back-off weight, 1 without a context; whether
        the context is known) of each pair."""
        place, known = self.contexts.find(contexts)
        weight, probability = np.ones(len(contexts)), np.zeros(len(contexts))
        rows = np.flatnonzero(known)
        weight[rows] = self.weight.read(place[rows])
        begin, end = self.pointers.access(place[rows]), self.pointers.access(place[rows] + 1)
        base = place[rows].astype(np.uint64) * np.uint64(self.alphabet)
        at, equal = self.successors.find(base + successors[rows].astype(np.uint64))
        equal &= (at >= begin.astype(np.int64)) & (at < end.astype(np.int64))
        probability[rows[equal]] = self.probability.read(at[equal])
        return probability, weight, known

    def _arrays(self) -> dict[str, np.ndarray]:
        out = {f"{level}.{part}": getattr(getattr(self, level), part) for level in ("contexts", "pointers", "successors") for part in EliasFano.PARTS}
        for name in ("weight", "probability"):
            out |= {f"{name}.codes": getattr(self, name).codes, f"{name}.book": getattr(self, name).book}
        return out

    def save(self, folder: str) -> None:
        """One file per array."""
        for name, array in self._arrays().items():
            np.save(os.path.join(folder, name + ".npy"), array)

    @classmethod
    def open(cls, folder: str, alphabet: int) -> Trie:
        """The trie in ``folder``, its arrays memory-mapped: pages are read when they are asked for."""
        load = lambda name: np.load(os.path.join(folder, name + ".npy"), mmap_mode="r")
        levels = [EliasFano(*[load(f"{level}.{part}") for part in EliasFano.PARTS]) for level in ("contexts", "pointers", "successors")]
        quantised = [Quantised(load(f"{name}.codes"), load(f"{name}.book")) for name in ("weight", "probability")]
        return cls(alphabet, *levels, *quantised)
