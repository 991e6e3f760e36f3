"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words, as 64-bit hashes. For each window length a shift table over blocks of two words (one for single
words) tells how far the search may jump; where the shift is zero the block selects a bucket of windows with that
suffix, the hash of the whole window picks those to test in it, and comparing the words themselves decides. Many texts
and stretches of them are searched side by side, each at its own place. Windows shorter than the standard length come from short items and
have tables of their own, so they don't shorten the jumps of the others.

The benchmark travels to the tasks in blocks of at most `block_bytes` of normalised text; a worker builds the tables of
a block once, about six bytes for each byte of it. One block is one map over the documents, without a shuffle. More
blocks are as many maps side by side, of which only texts with hits come back.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batch, checkpoint, groups_of, map_arrow, small_batches, table
from .words import Runs, Sums, letters, places

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Bytes between words become spaces and A-Z become a-z; digits, a-z and all bytes of other characters stay.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
NUMBERS = letters(bytes(b for b in range(256) if WORD_BYTES[b] == 0x20))
#: A text is searched in lanes of so many places side by side.
LANE = 32
#: Texts with hits up to which their results are broadcast to all documents, where there are several blocks.
BROADCAST_HITS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Search:
    """Shift table and buckets for the windows of one length in `words` that begin at `starts`."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray):
        self.length, self.block = length, min(2, length)
        far = length - self.block + 1
        if far > 255:
            raise ValueError("a window has at most 256 words")
        sums = Sums(words)
        size = 1 << max(10, int(2 * len(starts)).bit_length())
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, far, np.uint8)
        for end in range(self.block, length + 1):  # so that the least of each entry stays
            self.shift[sums.hashes(starts + end - self.block, starts + end) & self.mask] = length - end
        suffix, whole = sums.hashes(starts + length - self.block, starts + length), sums.hashes(starts, starts + length)
        order = np.lexsort((whole, suffix))
        self.suffix, self.whole, self.starts = suffix[order], whole[order], starts[order].astype(np.int32)

    def candidates(self, sums: Sums, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, place of the window in the tables) of what has a window's suffix and hash, in texts of the words from begins to ends."""
        n_ends = np.maximum(ends - begins - self.length + 1, 0)  # where windows can end
        lanes = -(-n_ends // LANE)
        text = np.repeat(np.arange(len(begins)), lanes)
        at = begins[text] + self.length + LANE * places(lanes)
        last = np.minimum(at + LANE - 1, ends[text])
        found, first, place = [], [], []
        while len(at):
            block = sums.hashes(at - self.block, at)
            jump = self.shift[block & self.mask]
            stop = np.flatnonzero(jump == 0)
            if len(stop):
                low, high = np.searchsorted(self.suffix, block[stop]), np.searchsorted(self.suffix, block[stop], side="right")
                some = np.flatnonzero(low < high)
                if len(some):
                    begin = at[stop[some]] - self.length
                    n, which = self._equal(sums.hashes(begin, begin + self.length), low[some], high[some])
                    found.append(np.repeat(text[stop[some]], n))
                    first.append(np.repeat(begin, n))
                    place.append(which)
            at = at + np.maximum(jump, 1)
            if len(inside := np.flatnonzero(at <= last)) < len(at):
                text, at, last = text[inside], at[inside], last[inside]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (found, first, place))

    def _equal(self, whole: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many, places) of the windows with these hashes in buckets from low to high, by halving."""
        a, b = low.copy(), high.copy()
        while (a < b).any():
            middle = (a + b) // 2
            less = (self.whole[np.minimum(middle, len(self.whole) - 1)] < whole) & (a < b)
            a, b = np.where(less, middle + 1, a), np.where(less | (a >= b), b, middle)
        n = np.zeros(len(a), np.int64)
        while len(more := np.flatnonzero((a + n < high) & (self.whole[np.minimum(a + n, len(self.whole) - 1)] == whole))):
            n[more] += 1
        return n, np.repeat(a, n) + places(n)


class Tables:
    """The searches for a list of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_text: dict[bytes, list[str]] = defaultdict(list)
        for item, text in items:
            if words := words_of(text):
                by_text[b" ".join(words)].append(item)
        self.texts, self.items = list(by_text), [sorted(set(x)) for x in by_text.values()]
        self.raw = b" ".join(self.texts)
        self.searches = []
        if self.texts:
            runs = Runs(self.texts, NUMBERS)
            self.begins, self.first, self.after = runs.begins, runs.first.astype(np.int32), runs.after.astype(np.int32)
            lengths = np.minimum(runs.sizes, window)
            for n in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == n)
                counts = runs.sizes[of] - n + 1
                self.searches.append(Search(n, runs.words, np.repeat(runs.begins[of], counts) + places(counts)))

    def find(self, texts: list[bytes]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Of each text with hits the runs of words (start, end), and the items."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.searches:
            return out
        runs = Runs(texts, NUMBERS)
        raw = None
        for search in self.searches:
            n = search.length
            for text, first, place in zip(*(x.tolist() for x in search.candidates(runs.sums, runs.begins, runs.begins + runs.sizes)), strict=True):
                raw = raw or b" ".join(texts)
                at = int(search.starts[place])
                if words_of(raw[runs.first[first] : runs.after[first + n - 1]]) == self.raw[self.first[at] : self.after[at + n - 1]].split():
                    spans, items = out.setdefault(text, ([], set()))
                    spans.append((first - int(runs.begins[text]), first - int(runs.begins[text]) + n))
                    items.update(self.items[int(np.searchsorted(self.begins, at, side="right")) - 1])
        return {k: (merged(spans), items) for k, (spans, items) in out.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The tables that a worker built last, by digest of their block.
_BUILT: dict[tuple, Tables] = {}


def _tables(key: tuple, block: list[tuple[str, bytes]]) -> Tables:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Tables(block, key[1])
    return _BUILT[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items with words in lists of bounded size. A row at a time comes to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), as_bytes(F.col(text_col)).alias("t")).filter(F.length("t") > 0).toLocalIterator():
        block.append((r.i or "", bytes(r.t)))
        size += len(r.t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with leak_spans array<int> (starts and ends of word runs, in turn) and leak_items array<string>, which replace others of their names.

    Both are empty arrays where nothing is found. A null or empty text has no words; an item without words is never
    found; items with one text are all named; an item without an id is named ''. Rows that repeat have the same results;
    an empty table gives no rows, an empty benchmark no hits.
    """
    small_batches(docs.sparkSession)
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    empty = docs.withColumns({"leak_spans": none("int"), "leak_items": none("string")})
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return empty
    if second is None:
        return _search_block(empty, text_col, first, window)
    # What is found in a text depends on the text alone, so hits come back by it.
    text = as_bytes(F.col(text_col))
    key = F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"), F.length(text).alias("n"))
    keyed = docs.select(key.alias("k"), F.col(text_col).alias("text"), none("int").alias("leak_spans"), none("string").alias("leak_items"))
    hits = None
    for block in _again(first, second, blocks):
        part = _search_block(keyed, "text", block, window).filter(F.size("leak_spans") > 0).groupBy("k").agg(F.first("leak_spans").alias("s"), F.first("leak_items").alias("i"))
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy("k").agg(F.flatten(F.collect_list("s")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("_items"))
    hits = checkpoint(hits.withColumnRenamed("k", "_k"))
    packed = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    joined = packed.join(F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits, F.col("_key") == F.col("_k"), "left")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("leak_spans", "leak_items")]
    return joined.select(*kept, F.coalesce("_spans", none("int")).alias("leak_spans"), F.coalesce("_items", none("string")).alias("leak_items"))


def _again(*parts) -> Iterator[list[tuple[str, bytes]]]:
    yield from parts[:-1]
    yield from parts[-1]


def _search_block(docs: DataFrame, text_col: str, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_bytes and one item
    digest = hashlib.sha256()
    for item, text in block:
        digest.update(f"{len(item)} {len(text)} {item}".encode() + text)
    key = (digest.hexdigest(), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, sent.value)
        for b in batches:
            spans, items, at = [[]] * b.num_rows, [[]] * b.num_rows, 0
            texts = [x.as_py() or b"" for x in b.column(text_col).cast(pa.binary())]
            for group in groups_of(texts):
                for k, (found, named) in tables.find(group).items():
                    spans[at + k], items[at + k] = [x for span in found for x in span], sorted(named)
                at += len(group)
            new = {"leak_spans": pa.array(spans, pa.list_(pa.int32())), "leak_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return map_arrow(docs, run, T.StructType(docs.schema.fields))


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def leak_report(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts for each row of find_leaks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = [len(words_of(x.as_py())) for x in b.column(1)]
            hit = [_covered(x) for x in b.column(2).to_pylist()]
            items = b.column(3).to_pylist()
            yield batch(REPORT, [b.column(0), n_words, hit, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [h > 0 for h in hit]])

    return map_arrow(found.select(F.col(id_col).cast("bigint"), as_bytes(F.col(text_col)), "leak_spans", "leak_items"), run, REPORT)


def _covered(spans: list[int]) -> int:
    return sum(b - a for a, b in merged(list(zip(spans[::2], spans[1::2], strict=True))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, with their own columns, whatever their names."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return find_leaks(packed, benchmark, **options).filter(F.size("leak_spans") == 0).select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leak_report(find_leaks(docs, table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), item_words AS (
  SELECT r, item, CAST(least(10, len(words)) AS INTEGER) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS pos, len(words) AS all_words FROM b
), windows AS (
  SELECT DISTINCT item, n, win FROM (
    SELECT item, n, all_words, pos, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS win FROM item_words
  ) WHERE pos + n - 1 <= all_words
), doc_words AS (
  SELECT r, n, len(words) AS all_words, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d CROSS JOIN (SELECT DISTINCT n FROM windows)
), doc_windows AS (
  SELECT r, n, pos, win FROM (
    SELECT r, n, all_words, pos, string_agg(w, ' ') OVER (PARTITION BY r, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS win FROM doc_words
  ) WHERE pos + n - 1 <= all_words
), hits AS (
  SELECT DISTINCT r, n, pos, item FROM doc_windows JOIN windows USING (n, win)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
