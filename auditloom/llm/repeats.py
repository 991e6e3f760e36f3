"""Removal of repeated passages by maximal repeats of enhanced suffix arrays.

A byte goes if a string of `length` bytes over it also starts anywhere else. Sorting every suffix of a corpus in one
order would move each byte many times, so the suffixes are first dealt out such that equal strings meet:

1. Equal texts count once; copies of a text long enough go whole.
2. Each window of `length` bytes has an anchor, the `GRAM`-byte run of least hash in it. Equal windows have equal
   anchors, so a window whose anchor occurs nowhere else is unique. Only windows of repeated anchors go on, as contexts:
   the bytes of neighbouring windows with one anchor.
3. Contexts meet by anchor; equal ones are counted, not gathered. For a run of anchors one task builds the suffix array
   with common-prefix lengths, scans it with a stack for the common-prefix intervals of at least `length`, and takes
   those whose left extensions differ: the maximal repeats, each with all its occurrences.
4. An anchor with very many different contexts doesn't go to one task; its windows are counted by a grouped aggregate.

Spans return to their texts by a join, and what they cover is cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpoint, map_arrow, table, written

LENGTH, GRAM = 200, 32
#: Window starts that are looked at together in a long text.
BLOCK = 1 << 17
#: Bytes of contexts in one suffix array, and different contexts of one anchor above which their windows are counted instead.
ARRAY_BYTES, MOST_CONTEXTS = 1 << 20, 20_000

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window start, last window start) of each anchor, in order."""
    out = [(np.zeros(0, np.int64),) * 3]
    for begin in range(0, len(text) - length + 1, BLOCK):
        h = np.frombuffer(text, np.uint8, min(len(text) - begin, BLOCK + length - 1), begin).astype(np.uint64)
        step = 1
        while step < GRAM:
            h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
            step *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
        low = np.uint64((BLOCK << 1) - 1)
        least, width, wide = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - GRAM + 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[: width - wide], least[wide - width :])
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append((h[at[first]].view(np.int64), begin + first, begin + np.append(first[1:], len(at)) - 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ANCHORS = "h bigint, tid bigint, lo bigint, hi bigint"


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """A row for each anchor of each text (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, lo, hi = anchors(text.as_py(), length)
                if len(h):
                    yield batch(ANCHORS, [h, np.full(len(h), tid), lo, hi])

    return map_arrow(texts, run, ANCHORS)


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class SuffixArray:
    """Suffixes of several short texts that start at least `length` bytes before their text's end, in order, with the lengths of common prefixes.

    `s` is the text as byte + 1 with a zero after each part (UTF-8 has no byte 255). Ranks of 8, 16, ... 128 bytes come
    by doubling; the suffixes themselves are sorted by the ranks of their successive 128-byte pieces.
    """

    def __init__(self, parts: list[bytes], length: int):
        sizes = np.array([len(p) for p in parts])
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum() + len(parts))
        self.s = np.zeros(n + 512, np.uint8)
        self.end = np.repeat(self.begins + sizes, sizes + 1)
        raw = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
        self.s[:n] = raw + np.uint8(1)
        words = np.lib.stride_tricks.sliding_window_view(self.s, 8)[: n + 384]
        self.rank = {8: _ranks(np.ascontiguousarray(words).view(">u8").ravel())}
        size = 8
        while size < 128:
            r = self.rank[size]
            after = np.append(r[size:], np.zeros(size, np.int64))
            size *= 2
            self.rank[size] = _ranks(r * (len(r) + 1) + after)
        room = self.end - np.arange(n)
        starts = np.flatnonzero(room >= length)
        r, pieces = self.rank[128], -(-int(sizes.max()) // 128)
        keys = [r[np.minimum(starts + 128 * k, len(r) - 1)] for k in range(pieces)]
        self.order = starts[np.lexsort(keys[::-1])]
        self.lcp = np.zeros(len(self.order) + 1, np.int64)
        if len(self.order) > 1:
            a, b = self.order[:-1], self.order[1:]
            most = np.minimum(room[a], room[b])
            got = np.zeros(len(a), np.int64)
            for size in [128] * pieces + [64, 32, 16, 8]:
                r, last = self.rank[size], len(self.rank[size]) - 1
                got += size * ((got < most) & (r[np.minimum(a + got, last)] == r[np.minimum(b + got, last)]))
            for _ in range(8):
                same = (got < most) & (self.s[np.minimum(a + got, n)] == self.s[np.minimum(b + got, n)])
                got += same
            self.lcp[1:-1] = np.minimum(got, most)
        #: What stands before each suffix; a text's start differs from all else.
        self.left = np.where(self.s[self.order - 1] == 0, 256 + self.order, self.s[self.order - 1].astype(np.int64))
        self.left[self.order == 0] = 256

    def maximal_repeats(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(common length, first rank, rank after the last) of each common-prefix interval of at least `length` with differing left extensions."""
        inside = self.lcp >= length
        first = np.flatnonzero(~inside[:-1] & inside[1:])  # the rank before a run of long common prefixes
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        varied = np.append(0, np.cumsum(self.left[1:] != self.left[:-1])) if len(self.left) else self.left
        some = varied[last] > varied[first]  # else no interval in the run has differing left extensions
        for lo, hi in zip(first[some].tolist(), last[some].tolist(), strict=True):
            if hi == lo + 1:
                yield int(self.lcp[hi]), lo, hi + 1
                continue
            stack: list[tuple[int, int]] = []  # (common length, first rank) of open intervals
            lcps = self.lcp[lo : hi + 2].tolist()
            lcps[0] = lcps[-1] = 0
            for k in range(1, len(lcps)):
                begin = k - 1
                while stack and stack[-1][0] > lcps[k]:
                    common, begin = stack.pop()
                    if varied[lo + k - 1] > varied[lo + begin]:
                        yield common, lo + begin, lo + k
                if lcps[k] >= length and (not stack or stack[-1][0] < lcps[k]):
                    stack.append((lcps[k], begin))

    def covered(self, length: int) -> list[list[int]]:
        """For each part, starts and ends in turn of what its maximal repeats cover."""
        longest = np.zeros(len(self.order), np.int64)
        for common, lo, hi in self.maximal_repeats(length):
            np.maximum(longest[lo:hi], common, out=longest[lo:hi])
        at = np.flatnonzero(longest)
        steps = np.zeros(len(self.s) + 1, np.int32)
        np.add.at(steps, self.order[at], 1)
        np.add.at(steps, self.order[at] + longest[at], -1)
        on = np.append(0, np.cumsum(steps) > 0).astype(np.int8)
        turns = np.diff(on)
        begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        out: list[list[int]] = [[] for _ in self.begins]
        for p, b, e in zip((np.searchsorted(self.begins, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
            out[p] += [b - int(self.begins[p]), e - int(self.begins[p])]
        return out


SPANS = "h bigint, c binary, spans array<int>"


def repeated_in_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of each different context (h, c, ctx, n) that repeats cover. A context that occurs n > 1 times is covered whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # contexts of anchors that have several
        alone: list[tuple] = []  # anchors of one context, which repeats only as a whole
        size = 0
        for rows in _by_anchor(batches):
            if len(rows) == 1:
                h, c, ctx, n = rows[0]
                alone += [(h, c, [0, len(ctx)])] * (n > 1)
                if len(alone) == 2000:
                    yield batch(SPANS, list(zip(*alone, strict=True)))
                    alone = []
                continue
            held += rows
            size += sum(len(r[2]) for r in rows)
            if size >= ARRAY_BYTES:
                yield from _spans_of(held, length)
                held, size = [], 0
        if alone:
            yield batch(SPANS, list(zip(*alone, strict=True)))
        yield from _spans_of(held, length)

    return map_arrow(contexts.repartition("h").sortWithinPartitions("h").select("h", "c", "ctx", "n"), run, SPANS)


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each anchor in turn; they come sorted."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _spans_of(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    if rows:
        spans = SuffixArray([r[2] for r in rows], length).covered(length)
        found = [(r[0], r[1], [0, len(r[2])] if r[3] > 1 else s) for r, s in zip(rows, spans, strict=True) if s or r[3] > 1]
        if found:
            yield batch(SPANS, list(zip(*found, strict=True)))


def repeated_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: their windows are counted by what they say."""
    each = F.explode(F.sequence(F.lit(0), F.length("ctx") - length))
    windows = contexts.select("h", "c", "n", "ctx", each.alias("at")).select("h", "c", "n", "at", F.unhex(F.sha2(F.expr(f"substring(ctx, at + 1, {length})"), 256)).alias("w"))
    counts = windows.groupBy("h", "w").agg(F.sum("n").alias("all")).filter("all > 1")
    spans = windows.join(counts, ["h", "w"]).groupBy("h", "c").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return spans.select("h", "c", F.flatten(F.transform("ats", lambda x: F.array(x, x + length))).alias("spans"))


CUT = "tid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def cut_out(texts: DataFrame) -> DataFrame:
    """(tid, text, spans) with the spans' bytes cut out: counts, digest and the bytes kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tid, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, removed, n, end = [], 0, 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    n += s > end or not n
                    kept.append(text[end:s])
                    removed += max(0, e - max(s, end))
                    end = max(e, end)
                kept = b"".join([*kept, text[end:]])
                out.append((tid, removed, n, hashlib.sha256(kept).hexdigest(), kept))
            yield batch(CUT, list(zip(*out, strict=True)) or [[]] * 5)

    return map_arrow(texts.select("tid", "text", "spans"), run, CUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, and the bytes kept if asked for.

    Null counts as empty; texts under `length` bytes lose nothing. Rows that repeat, id included, are copies of each
    other. Rows without an id take part and are reported.
    """
    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    known = raw.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").cast("bigint").alias("n_bytes"))
    equal = known.groupBy("sha").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    # The text's id is its least doc_id, or a hash where that is missing or names another text as well.
    shared = equal.groupBy("low").agg(F.count("*").alias("texts"))
    equal = equal.join(shared, equal["low"].eqNullSafe(shared["low"])).drop(shared["low"])
    tid = F.when((F.col("texts") == 1) & F.col("low").isNotNull(), F.col("low")).otherwise(F.xxhash64("sha"))
    equal = checkpoint(equal.select("sha", "low", "copies", "n_bytes", tid.alias("tid"), (F.col("texts") > 1).alias("odd")))
    long = raw.filter(F.length("text") >= length)

    # Anchors run over all rows, by doc_id; copies leave once few rows are left.
    plain = equal.filter(~F.col("odd") & F.col("low").isNotNull()).select("tid")
    odd = equal.filter((F.col("odd") | F.col("low").isNull()) & (F.col("n_bytes") >= length)).select("sha", "tid")
    texts = long.withColumnRenamed("doc_id", "tid")
    if not odd.isEmpty():
        strange = long.withColumn("sha", F.unhex(F.sha2("text", 256))).join(odd, "sha").dropDuplicates(["tid"]).select("tid", "text")
        texts = texts.join(plain, "tid", "left_semi").unionByName(strange)
        plain = plain.unionByName(odd.select("tid"))
    found = written(anchor_rows(texts, length))
    # Counts are cut off from the joins that use them: so both sides of a join are shuffles, and a hot anchor can be split.
    more = lambda x: checkpoint(x.groupBy("h").count().filter("count > 1").select("h"))
    found = written(found.join(more(found), "h", "left_semi").join(plain, "tid", "left_semi"))
    found = found.join(more(found), "h", "left_semi")
    ranges = found.groupBy("tid").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("ranges"))
    subject = written(texts.join(ranges, "tid"))

    at = subject.select("tid", "text", F.explode("ranges").alias("r"))
    ctx = F.expr("substring(text, int(r.lo) + 1, int(r.hi - r.lo) + %d)" % length)
    contexts = at.select("tid", "r.h", "r.lo", ctx.alias("ctx")).withColumn("c", F.unhex(F.md5("ctx")))
    different = written(contexts.groupBy("h", "c", "ctx").agg(F.count("*").alias("n")))
    many = checkpoint(different.groupBy("h").count().filter(F.col("count") > MOST_CONTEXTS).select("h"))
    if many.isEmpty():
        spans = repeated_in_contexts(different, length)
    else:
        spans = repeated_in_contexts(different.join(many, "h", "left_anti"), length).unionByName(repeated_windows(different.join(many, "h", "left_semi"), length))
    placed = contexts.select("tid", "h", "lo", "c").join(spans, ["h", "c"])
    pair = F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> struct(lo + spans[2 * i] as s, lo + spans[2 * i + 1] as e))")
    by_text = placed.select("tid", F.explode(pair).alias("x")).groupBy("tid").agg(F.collect_list("x").alias("spans"))
    cut = cut_out(subject.select("tid", "text").join(by_text, "tid"))
    if not with_kept:
        cut = cut.drop("kept")

    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda whole, part, none: F.when(gone, whole).otherwise(F.coalesce(part, none))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = known.join(equal.drop("n_bytes", "low", "odd"), "sha").join(cut, "tid", "left")
    out = out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("bigint")).alias("n_removed"), pick(F.lit(1).cast("bigint"), F.col("n_spans"), F.lit(0).cast("bigint")).alias("n_spans"),
        pick(nothing, F.col("kept_sha256"), F.lower(F.hex("sha"))).alias("kept_sha256"), *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
    return out


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits; windows are cut from pieces, so that no long text is passed over for each of them.
SQL = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) / 2 AS BIGINT) AS n FROM documents
), pieces AS (
  SELECT r, n, c, substr(h, 2 * c + 1, 798) AS piece FROM (SELECT *, unnest(range(0, n - 199, 200)) AS c FROM t)
), windows AS (
  SELECT r, c + k AS s, md5(substr(piece, 2 * k + 1, 400)) AS w FROM (SELECT *, unnest(range(0, least(200, n - 199 - c))) AS k FROM pieces)
), repeated AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), starts AS (
  SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before, lead(s) OVER (PARTITION BY r ORDER BY s) AS after FROM windows WHERE w IN (SELECT w FROM repeated)
), counted AS (
  SELECT r, CAST(sum(CASE WHEN after < s + 200 THEN after - s ELSE 200 END) AS BIGINT) AS n_removed, count(*) FILTER (before IS NULL OR s > before + 200) AS n_spans, max(s) + 200 AS last FROM starts GROUP BY r
), kept AS (
  SELECT r, string_agg(CASE WHEN before IS NULL THEN substr(h, 1, 2 * s) WHEN s > before + 200 THEN substr(h, 2 * (before + 200) + 1, 2 * (s - before - 200)) ELSE '' END, '' ORDER BY s) AS pieces FROM starts JOIN t USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN pieces IS NULL THEN h ELSE pieces || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN counted USING (r) LEFT JOIN kept USING (r)
"""
