"""Which of many words, or of many texts, are contained in which texts.

`WordTable` finds words in Arrow's own buffers: each place's next bytes, up to eight, are one number, and a bitmap and a
sorted table tell which words begin so. Words of up to eight bytes are thereby found; longer ones are looked up by a
rolling hash over their whole length and then compared. The work for a place doesn't depend on the number of words.

`WordFilter` is for words of any number, which no worker holds: a bitmap over hashes of the words tells which runs of a text
may be words. These runs are then joined with the words.

`contained_pairs` has no table to hold: each text sought is known by the one of its grams that is rarest in the texts
searched, and an equi-join on that gram gives the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that tell where a word may begin, and bits of the largest bitmap over them.
PREFIX, MOST_BITS = 8, 24
#: As powers of two, the bits of a filter that a group makes and of the largest filter; bits for each word, places that it sets, bytes of text looked at together.
SHARE, MOST_FILTER, WORD_BITS, PROBES, SLICE = 15, 28, 32, 4, 1 << 18
#: Code points of a gram.
GRAM = 6
_ODD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of any runs of bytes: sums of a number for each byte times a power for its place, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(data)), out=self.sums[1:])
        self.back = _powers(_ODD_INVERSE, len(data) + 1)

    def hashes(self, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[first + lengths] - self.sums[first]) * self.back[first] + lengths.astype(np.uint64) * np.uint64(_MIX))


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Beginnings:
    """The different beginnings of one width, behind a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - min(max(len(self.keys).bit_length() + 4, 10), MOST_BITS))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[_mixed(self.keys) >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose key is there, and which one it is."""
        at = np.nonzero(self.bitmap[_mixed(keys) >> self.shift])[0]
        which = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[which] == keys[at]
        return at[same], which[same]


class WordTable:
    """Finds different words, none of them empty, in texts; both as UTF-8."""

    def __init__(self, words: list[str]):
        self.words = [w.encode() for w in words]
        lengths = np.array([len(w) for w in self.words], np.int64)
        beginnings = np.array([int.from_bytes(w[:PREFIX], "little") for w in self.words], np.uint64)
        self.short: dict[int, tuple[_Beginnings, np.ndarray]] = {}
        for n in range(1, PREFIX + 1):
            if len(mine := np.nonzero(lengths == n)[0]):
                table = _Beginnings(beginnings[mine])
                self.short[n] = table, mine[np.argsort(beginnings[mine])]
        self.long = np.nonzero(lengths > PREFIX)[0]
        if len(self.long):
            self.start = _Beginnings(beginnings[self.long])
            which = np.searchsorted(self.start.keys, beginnings[self.long])
            pairs = np.unique(np.stack([which, lengths[self.long]]), axis=1)  # the lengths that words of one beginning have
            self.first = np.searchsorted(pairs[0], np.arange(len(self.start.keys) + 1))
            self.lengths = pairs[1]
            whole = np.frombuffer(b"".join(self.words[k] for k in self.long), np.uint8)
            ends = np.cumsum(lengths[self.long])
            hashes = _Rolling(whole).hashes(ends - lengths[self.long], lengths[self.long])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.long = hashes[order], self.long[order]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) for every different word that each text contains: texts lie side by side, from offsets[k] to offsets[k + 1]."""
        base = int(offsets[0])
        data, offsets = data[base : offsets[-1]], offsets - base
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        keys = data.astype(np.uint64)
        for n in range(1, PREFIX + 1):
            if n > 1:
                keys = keys[: max(len(data) - n + 1, 0)] | (data[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1)))
            if n in self.short:
                table, words = self.short[n]
                at, which = table.find(keys)
                places.append(at)
                found.append(words[which])
        if len(self.long):
            for at, word in self._longer(data, keys):
                places.append(at)
                found.append(word)
        at, word = np.concatenate(places), np.concatenate(found)
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + np.array([len(w) for w in self.words], np.int64)[word] <= offsets[text + 1]
        pairs = np.unique(text[inside] * len(self.words) + word[inside])
        return pairs // len(self.words), pairs % len(self.words)

    def _longer(self, data: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, which = self.start.find(keys)
        if not len(at):
            return
        n = self.first[which + 1] - self.first[which]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, lengths = np.repeat(at, n), self.lengths[np.repeat(self.first[which], n) + step]
        fits = at + lengths <= len(data)
        at, lengths = at[fits], lengths[fits]
        hashes = _Rolling(data).hashes(at, lengths)
        place = np.searchsorted(self.hashes, hashes)
        while len(at):  # once, but for words of one hash
            alike = place < len(self.hashes)
            alike[alike] = self.hashes[place[alike]] == hashes[alike]
            at, lengths, hashes, place = at[alike], lengths[alike], hashes[alike], place[alike]
            words = self.long[place]
            same = np.fromiter((data[a : a + n].tobytes() == self.words[w] for a, n, w in zip(at.tolist(), lengths.tolist(), words.tolist(), strict=True)), bool, len(at))
            yield at[same], words[same]
            at, lengths, hashes, place = at[~same], lengths[~same], hashes[~same], place[~same] + 1


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array, null ones without any, and where each text begins and ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)


def find_words(texts: pa.Array, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) for each text of an Arrow array, null ones without any."""
    return table.find(*_bytes(texts))


def _sized(keys: np.ndarray, n: int) -> np.ndarray:
    """Hashes of beginnings of n bytes; PREFIX + 1 stands for those of longer words."""
    return _mixed(keys + np.uint64(n * _ODD & (1 << 64) - 1))


def filter_bits(words: int) -> int:
    """Of a bitmap for so many words, as a power of two."""
    return min(max((2 * words * WORD_BITS).bit_length() - 1, SHARE), MOST_FILTER)


def _place(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(pow(_ODD, probe, 1 << 64))) >> np.uint64(64 - bits)


def word_places(words: pa.Array, bits: int) -> np.ndarray:
    """The places in a bitmap of 2^bits that different words set."""
    data, offsets = _bytes(words)
    first, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    data = np.append(data[offsets[0] : offsets[-1]], np.zeros(PREFIX, np.uint8))
    keys = np.zeros(len(first), np.uint64)
    for k in range(PREFIX):
        keys |= np.where(k < lengths, data[first + k], 0).astype(np.uint64) << np.uint64(8 * k)
    hashes = [_sized(keys[lengths == n], n) for n in range(1, PREFIX + 1)]
    if (long := lengths > PREFIX).any():
        hashes += [_sized(keys[long], PREFIX + 1), _Rolling(data).hashes(first[long], lengths[long])]
    every = np.concatenate(hashes)
    return np.concatenate([_place(every, k, bits) for k in range(PROBES)]).astype(np.int64)


class WordFilter:
    """Tells which runs of texts may be words of these lengths in bytes, by a bitmap of 2^bits in which word_places() are set."""

    def __init__(self, lengths: list[int], bits: int, bitmap: bytes):
        self.short, self.long = {n for n in lengths if n <= PREFIX}, sorted(n for n in lengths if n > PREFIX)
        self.bits, self.bitmap = bits, np.frombuffer(bitmap, np.uint8)

    def _passing(self, hashes: np.ndarray) -> np.ndarray:
        at = None
        for k in range(PROBES):
            place = _place(hashes, k, self.bits)
            hit = np.nonzero((self.bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))[0]
            at, hashes = hit if at is None else at[hit], hashes[hit]
        return at

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first byte, bytes) of the different runs that may be words, by text: texts lie side by side, as in WordTable.find()."""
        base = int(offsets[0])
        data, offsets = data[base : offsets[-1]], offsets - base
        sign = np.append((data & 0xC0) != 0x80, True)  # where a code point begins, or all ends
        found = [np.zeros((3, 0), np.int64)]

        def whole(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            at = at[at + n <= len(data)]
            at = at[sign[at] & sign[at + n]]
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + n <= offsets[text + 1]
            return text[inside], at[inside]

        keys = data.astype(np.uint64)
        for n in range(1, PREFIX + 1):
            if n > 1:
                keys = keys[: max(len(data) - n + 1, 0)] | (data[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1)))
            if n in self.short:
                text, at = whole(self._passing(_sized(keys, n)), n)
                order = np.lexsort((keys[at], text))
                text, at = text[order], at[order]
                new = np.append(True, (np.diff(text) != 0) | (keys[at][1:] != keys[at][:-1]))[: len(at)]
                found.append(np.stack([text[new], at[new], np.full(new.sum(), n)]))
        if self.long and len(begins := self._passing(_sized(keys, PREFIX + 1))):
            rolling = _Rolling(data)
            for n in self.long:
                text, at = whole(begins, n)
                hit = self._passing(rolling.hashes(at, np.full(len(at), n)))
                first = {(t, data[a : a + n].tobytes()): a for t, a in zip(text[hit].tolist(), at[hit].tolist(), strict=True)}
                found.append(np.array([[t, a, n] for (t, _), a in first.items()], np.int64).reshape(-1, 3).T)
        text, at, n = np.concatenate(found, axis=1)
        order = np.argsort(text, kind="stable")
        return text[order], at[order] + base, n[order]


def possible_words(texts: pa.Array, words: WordFilter) -> pa.Array:
    """For each text of an Arrow array the list of different runs that may be words; real words are all among them."""
    data, offsets = _bytes(texts)
    counts, runs, first = np.zeros(len(texts), np.int64), [pa.array([], pa.string())], 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1, first + 1)
        text, at, n = words.find(data, offsets[first : last + 1])
        counts[first:last] = np.bincount(text, minlength=last - first)
        ends = np.cumsum(n)
        signs = data[np.repeat(at - ends + n, n) + np.arange(n.sum())]
        runs.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(signs)).cast(pa.string()))
        first = last
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.concat_arrays(runs))


def grams(text: Column, sizes: list[int]) -> Column:
    """The different runs of each number of code points; a size of 0 gives the empty one."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(signs)

    def runs(k: int) -> Column:
        if k == 0:
            return F.array(F.lit(""))
        every = F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.array_join(F.slice(signs, at, k), ""))
        return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(k) for k in sizes]))


def contained_pairs(needles: DataFrame, texts: DataFrame, keys: list[str], gram: int = GRAM) -> DataFrame:
    """(…keys, needle, text) for different (…keys, needle) and (…keys, text) of equal keys where the text contains the needle.

    Nulls never match. An empty needle is contained in every text of its keys.
    """
    sought = needles.select(*keys, "needle").dropna().distinct()
    searched = texts.select(*keys, "text").dropna().distinct()
    size = F.least(F.length("needle"), F.lit(gram))
    sizes = sorted(r[0] for r in sought.select(size).distinct().collect()) or [gram]  # at most gram + 1 rows
    by_needle = sought.withColumn("_size", size)
    own = None
    for k in sizes:
        part = by_needle.filter(F.col("_size") == k).select(*keys, "needle", F.explode(grams(F.col("needle"), [k])).alias("_gram"))
        own = part if own is None else own.unionByName(part)
    place = searched.select(*keys, "text", F.explode(grams(F.col("text"), sizes)).alias("_gram"))
    wanted = own.select(*keys, "_gram").distinct()
    common = place.join(wanted, [*keys, "_gram"], "left_semi").groupBy(*keys, "_gram").agg(F.count("*").alias("_n"))
    rated = own.join(common, [*keys, "_gram"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy(*keys, "needle").agg(F.min(F.struct("_n", "_gram")).alias("_r")).filter("_r._n > 0").select(*keys, "needle", F.col("_r._gram").alias("_gram"))
    return rarest.join(place, [*keys, "_gram"]).filter(F.contains("text", F.col("needle"))).select(*keys, "needle", "text")
