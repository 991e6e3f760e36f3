"""Grouping of spelling variants by blocked Gram matrices.

Words one edit apart have letter counts whose squared distance is at most two, and lengths at most one apart. The
alphabet is dealt into a few parts; an edit touches two letters at most, so the counts in all but two parts agree. Words
meet under each choice of agreeing parts, sorted by length and cut into blocks. For each block with itself and the blocks
of adjacent lengths, one NumPy product of letter counts gives all squared distances; pairs at most two apart are then
verified as edits. A pair is taken under the first choice in which it agrees, so it comes out once.

Choices that very many words share are dealt into tiles, and each two tiles meet in a task of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, checkpoint, map_arrow, table, written
from .words import mixed

#: Runs of letters once A-Z are lower case, and a place where no run goes on.
RUN, _BREAK, SLICE = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]"), 1 << 20
LEAST_CHARS, LEAST_COUNT, SLIPS = 5, 3, 97
#: Different words that a task holds before it hands out their sums.
HELD = 200_000
#: Rows of a block, and words of one choice that meet in one task.
BLOCK, TILE_WORDS = 512, 20_000
#: Letters of words that are compared side by side in an array; longer words are compared one by one.
WIDE = 32
#: Letters with counts of their own; rarer ones share columns, which can only make distances smaller.
COLUMNS = 96
#: Words up to which the alphabet is dealt into so many parts; parts beyond the last.
PARTS, MOST_PARTS = ((20_000, 3), (3_000_000, 4), (100_000_000, 5)), 6
WORDS = "word string, n bigint"
PAIRS = "word string, near string, near_n bigint"


def slipped(doc_id: int | None, runs: Counter, slips: int) -> Iterator[tuple[str, int]]:
    """Each word of a document and how often; one in `slips` has lost a letter, by the checksum of '<doc_id>:<run>' (no id: ':<run>')."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before) if slips else 1
        if slips and h % slips == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def runs_of(text: str | None) -> Counter:
    """Runs of letters, A-Z in lower case. Long texts are searched in slices."""
    text = (text or "").encode().lower().decode()
    out: Counter = Counter()
    begin = 0
    while len(text) - begin > SLICE and (at := _BREAK.search(text, begin + SLICE)):
        out.update(RUN.findall(text, begin, at.start()))
        begin = at.start()
    out.update(RUN.findall(text, begin))
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts: words of at least `least_chars` letters that occur at least `least_count` times. `slips` 0 leaves all words as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                for word, n in slipped(i.as_py(), runs_of(t.as_py()), slips):
                    if len(word) >= least_chars:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield batch(WORDS, [list(held), list(held.values())])
                    held.clear()
        yield batch(WORDS, [list(held), list(held.values())])

    counted = map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, WORDS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Alphabet:
    """Letters by falling frequency, dealt into parts of about the same weight."""

    def __init__(self, letters: list[tuple[str, int]], parts: int):
        self.rank = np.zeros(0x110000, np.int32)
        self.parts = parts
        self.part = np.zeros(max(len(letters), 1), np.int8)
        weights = [0] * parts
        for k, (letter, n) in enumerate(letters):
            self.rank[ord(letter)] = k
            self.part[k] = least = weights.index(min(weights))
            weights[least] += n
        self.number = mixed(np.arange(1, len(self.part) + 1, dtype=np.uint64))
        #: The choices of agreeing parts, and for each set of agreeing parts, as bits, the first choice within it.
        self.choices = list(combinations(range(parts), parts - 2))
        inside = lambda bits, choice: all(bits >> p & 1 for p in choice)
        self.first_choice = np.array([next((c for c, choice in enumerate(self.choices) if inside(bits, choice)), -1) for bits in range(1 << parts)])

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of all letters in a row, and where each word begins."""
        lengths = np.array([len(w) for w in words], np.int64)
        return self.rank[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)], np.cumsum(lengths) - lengths

    def codes(self, ranks: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A number for the letter counts of each word (row) in each part (column)."""
        numbers, part = self.number[ranks], self.part[ranks]
        return np.stack([np.add.reduceat(np.where(part == p, numbers, np.uint64(0)), begins) for p in range(self.parts)], axis=1)

    def keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each choice, a number for the counts in its parts."""
        return [mixed(sum(mixed(codes[:, p] + np.uint64(p + 1)) * np.uint64(2 * p + 3) for p in choice) + np.uint64(c)) for c, choice in enumerate(self.choices)]


class Block:
    """Neighbouring rows of (cell, tile, choice, word, n), with their letter counts."""

    def __init__(self, cells: np.ndarray, sides: np.ndarray, choices: np.ndarray, words: list[str], n: np.ndarray, alphabet: Alphabet):
        self.cells, self.sides, self.choices, self.words, self.n = cells, sides, choices, words, n
        ranks, begins = alphabet.letters(words)
        self.codes = alphabet.codes(ranks, begins)
        self.lengths = np.array([len(w) for w in words], np.int64)
        columns = min(COLUMNS, len(alphabet.part))
        at = np.repeat(np.arange(len(words)), self.lengths) * columns + ranks % columns
        exact = np.float32 if self.lengths.max() < 4000 else np.float64
        self.counts = np.bincount(at, minlength=len(words) * columns).reshape(len(words), columns).astype(exact)
        self.norms = (self.counts * self.counts).sum(axis=1)
        #: The code points of words, as far as they are no longer than WIDE.
        self.signs = np.array([w if len(w) <= WIDE else "" for w in words], f"<U{WIDE + 1}").view(np.uint32).reshape(len(words), WIDE + 1)

    def adjacent(self, later: Block) -> bool:
        """Whether a later block may hold partners: it goes on with this one's last cell, at a length that is adjacent."""
        return self.cells[-1] == later.cells[0] and self.lengths[-1] >= later.lengths[0] - 1


def near_pairs(a: Block, b: Block, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b that are one edit apart, each pair under its first choice and in one of its cells."""
    squared = a.norms[:, None] + b.norms[None, :] - 2 * (a.counts @ b.counts.T)
    i, j = np.nonzero(squared < 2.5)
    keep = (a.cells[i] == b.cells[j]) & (np.abs(a.lengths[i] - b.lengths[j]) <= 1)
    keep &= (i < j) if a is b else True
    i, j = i[keep], j[keep]
    keep = (a.sides[i] < 0) | (a.sides[i] != b.sides[j])
    i, j = i[keep], j[keep]
    agree = ((a.codes[i] == b.codes[j]) << np.arange(alphabet.parts)).sum(axis=1)
    keep = (alphabet.first_choice[agree] == a.choices[i]) & (a.choices[i] == b.choices[j])
    i, j = i[keep], j[keep]
    edits = one_edit_each(a, b, i, j)
    return i[edits], j[edits]


def one_edit_each(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """one_edit() of rows of a and b, whose lengths are at most one apart."""
    out = np.zeros(len(i), bool)
    short = np.maximum(a.lengths[i], b.lengths[j]) <= WIDE
    for k in np.nonzero(~short)[0]:
        out[k] = one_edit(a.words[i[k]], b.words[j[k]])
    at = np.nonzero(short)[0]
    first, second = a.signs[i[at]], b.signs[j[at]]
    swap = a.lengths[i[at]] > b.lengths[j[at]]
    first[swap], second[swap] = second[swap], first[swap]
    differ = first != second
    shifted = first[:, :-1] != second[:, 1:]  # as if the longer word had a letter less from where they differ
    shifted &= np.maximum.accumulate(differ, axis=1)[:, :-1]
    out[at] = np.where(a.lengths[i[at]] == b.lengths[j[at]], differ.sum(axis=1) == 1, ~shifted.any(axis=1))
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one word into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _alphabet(words: DataFrame, n_words: int) -> Alphabet:
    """From the letters of all words, of which there are no more than Unicode has."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    found = sorted(((r.letter, r.n) for r in letters.collect()), key=lambda x: (-x[1], x[0]))
    return Alphabet(found, next((p for most, p in PARTS if n_words <= most), MOST_PARTS))


def _placed(words: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Each word under the key of each choice."""
    schema = "key bigint, choice int, word string, n bigint"
    sent = words.sparkSession.sparkContext.broadcast(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = sent.value
        for b in batches:
            if b.num_rows:
                keys = letters.keys(letters.codes(*letters.letters(b.column(0).to_pylist())))
                for c, key in enumerate(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), c, np.int32)), b.column(0), b.column(1)], names=["key", "choice", "word", "n"])

    return map_arrow(words.select("word", "n"), run, schema)


def _dealt(placed: DataFrame, tile_words: int) -> DataFrame:
    """Adds cell and side: keys of many words are dealt into tiles, and a word goes to the cells of its tile with each other tile."""
    crowds = checkpoint(placed.groupBy("key").agg(F.count("*").alias("_words")).filter(F.col("_words") > tile_words))
    if crowds.isEmpty():
        return placed.withColumns({"cell": F.col("key"), "side": F.lit(-1)})
    tiles = F.ceil(F.col("_words") / tile_words).cast("int")
    out = placed.join(crowds, "key", "left").withColumn("_tiles", F.coalesce(tiles, F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("word"), F.col("_tiles")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    cell = F.when(F.col("_tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    side = F.when(F.col("_own") == F.col("_other"), F.lit(-1)).otherwise(F.col("_own"))
    return out.withColumns({"cell": cell, "side": side}).drop("_words", "_tiles", "_own", "_other")


def near_words(words: DataFrame, tile_words: int = TILE_WORDS, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for each word and word one edit apart, of different `words` (word, n), a table or checkpoint."""
    alphabet = _alphabet(words, words.count())
    sent = words.sparkSession.sparkContext.broadcast(alphabet)
    cells = _dealt(_placed(words, alphabet), tile_words).repartition("cell").sortWithinPartitions("cell", F.length("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = sent.value
        open_blocks: list[Block] = []
        for b in batches:
            for k in range(0, b.num_rows, block):
                part = b.slice(k, block)
                new = Block(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).to_pylist(), part.column(4).to_numpy(), letters)
                open_blocks = [x for x in open_blocks if x.adjacent(new)] + [new]
                for x in open_blocks:
                    i, j = near_pairs(x, new, letters)
                    if len(i):
                        first, second = [x.words[k] for k in i.tolist()], [new.words[k] for k in j.tolist()]
                        yield batch(PAIRS, [first + second, second + first, np.concatenate([new.n[j], x.n[i]])])

    return map_arrow(cells.select("cell", "side", "choice", "word", "n"), run, PAIRS)


def follow(up: DataFrame) -> DataFrame:
    """(word, root) of `up` (word, form): the last form that following forms leads to. Each round doubles what a step spans."""
    out = checkpoint(up.select("word", F.col("form").alias("root")))
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = checkpoint(out.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        out = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return out


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of different words (word, n).

    A word's form is the most frequent word one edit apart (ties: the first in code-point order) if it is at least `ratio`
    times as frequent, which must be above 1. Its root is the last form that following forms leads to, or the word itself.
    Words without a near word have n_near 0. No words give no rows.
    """
    words = written(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = (-F.col("best.less")) >= ratio * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    out = written(out)
    roots = follow(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """spelling_variants() of all words in whole texts.

    A null text has no words; rows that repeat count each time; a document without an id counts as if its id were an
    empty text. Other columns are ignored. An empty table gives no rows.
    """
    return spelling_variants(count_words(docs, id_col, text_col, slips, least_chars, least_count))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


def _nibbles() -> str:
    """What the checksum's polynomial makes of each half byte."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(f"{c}::UBIGINT")
    return ", ".join(out)


_BYTES = "flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
SQL = f"""
WITH RECURSIVE r AS (
  SELECT id, run, count(*) AS k FROM (SELECT coalesce(cast(doc_id AS string), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(flatten(list_transform({_BYTES}, lambda b: [b % 16, b // 16]))::UBIGINT[], lambda a, x: xor(a >> 4, [{_nibbles()}][((xor(a, x) & 15) + 1)::BIGINT]), 4294967295::UBIGINT)) AS h FROM r
), s AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h
), w AS (
  SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), g AS (
  SELECT word, n, i, substring(word, 1, i::BIGINT) || substring(word, i::BIGINT + 2) AS rest FROM w, unnest(range(length(word))) AS u(i)
), p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM g a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM g a JOIN w b ON a.rest = b.word
), o AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND place = 1
), c(word, root, form) AS (
  SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.form = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL
"""
