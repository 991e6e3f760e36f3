"""Hashes of the words of many texts at once, in numpy.

A word's hash is the sum of a number for each byte times a power of an odd number for its place, so differences of one
prefix sum over all bytes give all words, and differences of another over the words give all runs of words. Sums are
modulo 2^64; the results are mixed. The hashes of different words or runs are equal as seldom as random 64-bit numbers.
"""

from __future__ import annotations

import numpy as np

#: An odd number whose powers tell places apart, its inverse modulo 2^64, and multipliers that mix.
PLACE = 0x9E3779B97F4A7C15
PLACE_INVERSE, MIX_A, MIX_B = pow(PLACE, -1, 1 << 64), 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(32))


def letters(separators: bytes) -> np.ndarray:
    """A number for each byte: 0 for separators, the same one for A-Z and a-z."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(PLACE))
    out[65:91] = out[97:123]
    out[list(separators)] = 0
    return out


WHITE_SPACE = letters(b" \t\n\r\x0b\x0c")


class _Powers:
    """Powers of PLACE and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.back = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.back = (np.append(np.uint64(1), np.cumprod(np.full(n, x, np.uint64))) for x in (PLACE, PLACE_INVERSE))
        return self.up[: n + 1], self.back[: n + 1]


_POWERS = _Powers()


class Sums:
    """Hashes of runs of numbers."""

    def __init__(self, numbers: np.ndarray):
        up, self.back = _POWERS.upto(len(numbers))
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * up[:-1], out=self.sums[1:])

    def hashes(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return mixed((self.sums[after] - self.sums[first]) * self.back[first])


def places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Runs:
    """The words of several texts, and hashes of runs of them."""

    def __init__(self, texts: list[bytes], table: np.ndarray = WHITE_SPACE):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        numbers = table[raw]
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = numbers != 0
        turns = np.diff(inside)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        self.words = Sums(numbers).hashes(starts, ends)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        before = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        #: How many words each text has, and where they begin.
        self.sizes, self.begins = np.diff(np.append(before, len(starts))), before
        #: Where each word's bytes begin and end in the texts joined by spaces.
        self.first, self.after = starts, ends
        self.sums = Sums(self.words)

    def hashes(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.sums.hashes(first, after)

    def shingles(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, how many of each text) of all runs of `words` words; a shorter text is one run, one without words none."""
        counts = np.where(self.sizes > words, self.sizes - words + 1, np.minimum(self.sizes, 1))
        first = np.repeat(self.begins, counts) + places(counts)
        return self.hashes(first, np.minimum(first + words, np.repeat(self.begins + self.sizes, counts))), counts

    def wholes(self) -> np.ndarray:
        return self.hashes(self.begins, self.begins + self.sizes)

    def pieces(self, every: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, texts) of the pieces between words that their own hash marks as ends, one in `every`, so that equal passages are cut alike."""
        end = self.words % np.uint64(every) == 0
        end[(self.begins + self.sizes)[self.sizes > 0] - 1] = True
        after = np.flatnonzero(end) + 1
        text_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return self.hashes(np.append(0, after)[:-1], after), text_of[after - 1]


def by_text(order: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """`order` brought into the order of texts, otherwise as it is."""
    of = text_of[order]
    return order[np.argsort(of.astype(np.uint16) if len(of) and int(text_of.max()) < 1 << 16 else of, kind="stable")]


def distinct(hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) without repeats in a text, by text, then hash."""
    order = by_text(np.argsort(hashes), text_of)
    h, t = hashes[order], text_of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    return h[new], t[new]
