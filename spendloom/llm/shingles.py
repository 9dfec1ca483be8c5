"""Word-shingle sets of texts as 54-bit hashes, computed on bytes."""

from __future__ import annotations

import numpy as np

from spendloom.llm.columns import is_blank, word_bounds

#: Texts of a block are told apart in the ten leading bits while their shingles are sorted.
TEXT_BITS = 10
HASH_BITS = 64 - TEXT_BITS
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class WordHasher:
    """64-bit hashes of words, A-Z lower-cased: a random multilinear function of the bytes."""

    def __init__(self, seed: int = 1):
        self.blank = is_blank()
        value = np.arange(1, 257, dtype=np.uint64)
        value[ord("A") : ord("Z") + 1] += np.uint64(32)
        value[self.blank] = 0
        self.value = value
        self.factor = odd_numbers(1 << 12, seed)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of all words, and the index of each text's first word."""
        starts, ends, first = word_bounds(data, offsets, self.blank)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends, first
        size = ends - starts
        longest = int(size.max())
        if longest > len(self.factor):
            self.factor = odd_numbers(1 << longest.bit_length(), 1)
        base = np.zeros(len(data), np.int32)
        base[starts] = np.diff(starts, prepend=0)
        place = np.arange(len(data), dtype=np.int32) - np.cumsum(base, dtype=np.int32)
        place[self.blank[data]] = 0
        np.clip(place, 0, len(self.factor) - 1, out=place)
        return mix(np.add.reduceat(self.value[data] * self.factor[place], starts)), starts, ends, first


class ShingleHasher:
    """Hashes of all runs of five words; a text with fewer words is one run."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.hasher = WordHasher()
        self.factor = odd_numbers(words + 1, 2)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs in order, and the index of each text's first run."""
        word, _, _, first = self.hasher(data, offsets)
        return self.runs_of(word, first)

    def runs_of(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.words
        count = np.diff(first)
        n_runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        bounds = np.concatenate([[0], np.cumsum(n_runs)])
        padded = np.concatenate([word, np.zeros(k, np.uint64)])
        at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n_runs)
        total = np.zeros(len(at), np.uint64)
        size = np.repeat(np.minimum(count, k), n_runs)
        short = size < k
        for j in range(k):
            part = padded[at + j] * self.factor[j]
            if short.any():
                part[short & (size <= j)] = 0
            total += part
        return mix(total + size.astype(np.uint64) * self.factor[k]), bounds

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of each text, and their bounds. Works on up to 2 ** TEXT_BITS texts at a time."""
        hashes, bounds = self.runs(data, offsets)
        return distinct(hashes, bounds)


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values (their leading HASH_BITS) of each segment, and the bounds of the segments in them."""
    step = 1 << TEXT_BITS
    values, ends = [], [np.zeros(1, np.int64)]
    at = 0
    for low in range(0, len(bounds) - 1, step):
        own = bounds[low : low + step + 1]
        n = np.diff(own)
        text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        key = np.sort(text << np.uint64(HASH_BITS) | hashes[own[0] : own[-1]] >> np.uint64(TEXT_BITS))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        per_text = np.searchsorted(key, np.arange(1, len(n), dtype=np.uint64) << np.uint64(HASH_BITS))
        ends.append(at + np.concatenate([per_text, [len(key)]]) if len(n) else np.zeros(0, np.int64))
        values.append(key & np.uint64((1 << HASH_BITS) - 1))
        at += len(key)
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(ends).astype(np.int64)


def segment_min(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum of each segment, none of which is empty."""
    return np.minimum.reduceat(values, bounds[:-1])
