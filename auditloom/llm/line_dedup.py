"""Line deduplication by a segment-partition edit join.

Lines are equal, or near: at most `edits` single-character edits apart, for lines of `least_chars` on. Equal and near
lines form classes (connected over links); of a class only the first line in the corpus stays.

Edit join: a line is cut into `edits` + 1 segments of even length. Two lines within the threshold share one segment of
the shorter, at a place that the lengths and the segment's number narrow down: the longer probes, for each shorter
length and each segment, the few substrings that can be its match (multi-match-aware selection). Keys are hashes of
(length, segment number, substring). In the join condition signatures of character counts
must differ in at most two bits an edit; so a common segment gives few candidates. Candidates are verified on their texts by a
banded bit-parallel edit distance: one small integer holds the band of a column.

Only ids and hashes are shuffled for the join. Each task sends a line's keys once, however often the line is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpoint, map_arrow, release, table
from .components import components, spanning_forest

EDITS, LEAST_CHARS = 2, 24
#: Lines whose keys make one batch.
LINES_AT_ONCE = 5000
#: Lines that a task remembers having sent, and candidate lines up to which their ids are broadcast to fetch the texts.
SEEN_LINES, BROADCAST_IDS = 200_000, 500_000

#: ASCII bytes fall into 31 classes by hash, others into one that isn't counted.
CLASSES = 31
CLASS_OF = np.array([(b * 2654435761 >> 7) % CLASSES if b < 128 else CLASSES for b in range(256)], np.int64)


def signatures(raw: bytes, lengths: list[int]) -> np.ndarray:
    """For each line of a text the count of each class modulo 4, in Gray code: bits that differ are the least steps between the counts.

    An edit moves at most two counts by one, so lines within e edits differ in at most 2e bits.
    """
    line_of = np.repeat(np.arange(len(lengths)), np.array(lengths) + 1)[: len(raw)]
    counts = np.bincount(line_of * (CLASSES + 1) + CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(lengths) * (CLASSES + 1))
    left = counts.reshape(len(lengths), CLASSES + 1)[:, :CLASSES] % 4
    left[:-1, CLASS_OF[10]] = (left[:-1, CLASS_OF[10]] + 3) % 4  # the line break behind a line isn't its own
    return ((left ^ (left >> 1)) << np.arange(0, 2 * CLASSES, 2)).sum(axis=1)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a line; the last ones are longer by one where it doesn't come out even."""
    n, out, at = edits + 1, [], 0
    for k in range(n):
        size = (length + k) // n
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int) -> Iterator[tuple[int, int, int, int]]:
    """(shorter length, segment number, start, size) of the substrings that a line probes."""
    for less in range(edits + 1):
        if length - less > edits:
            for k, (at, size) in enumerate(segments(length - less, edits)):
                low = max(at - k, at + less - (edits - k), 0)
                high = min(at + k, at + less + (edits - k), length - size)
                for start in range(low, high + 1):
                    yield length - less, k, start, size


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: bit-parallel along a band of 2 * edits + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    n = len(b)
    begin = next((i for i in range(n) if a[i] != b[i]), n) if a[:n] != b else n
    a, b = a[begin:], b[begin:]
    while b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not b:
        return len(a) <= edits
    width = 2 * edits + 1
    full, m = (1 << width) - 1, len(a)
    up, down, score = full >> edits << edits, 0, edits  # vertical steps of +1 and -1, top row of the band in bit 0
    rows_left = m - edits  # columns while the band's lowest row is inside
    mark = 1 << (width - 1)
    at_row = mark >> 1
    for j, c in enumerate(b):
        match = 0
        for k in range(width):
            i = j - edits + k
            if 0 <= i < m and a[i] == c:
                match |= 1 << k
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = (down | ~(diagonal | up)) & full, diagonal & up
        if j < rows_left:
            score += not diagonal & mark
        else:
            score += bool(right_up & at_row) - bool(right_down & at_row)
            at_row >>= 1
        if score > edits + (len(b) - 1 - j if j >= rows_left else edits * 2):
            return False
        shifted = diagonal >> 1
        up, down = (right_down | ~(shifted | right_up)) & full, shifted & right_up
    return score <= edits


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, line, check, text) of the lines that are not blank, of (doc_id, text)."""
    each = docs.select("doc_id", _row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(_lines(F.col("text"))).alias("at", "text"))
    return each.filter(F.col("text").rlike("\\S")).select("doc_id", "row", "at", F.xxhash64("text").alias("line"), F.xxhash64(F.lit(1), "text").alias("check"), "text")


KEYS = "key bigint, line bigint, sign bigint, same boolean"


def _keys(docs: DataFrame, edits: int, least: int, probing: bool) -> DataFrame:
    """Segment hashes of the lines, or those of the substrings they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        plans: dict[int, list[tuple[int, int, int, bool]]] = {}

        def plan(length: int) -> list[tuple[int, int, int, bool]]:
            """(seed, start, end, same length) of each key; the seed tells the shorter length and the segment."""
            found = [(shorter, k, s, size) for shorter, k, s, size in probes(length, edits)] if probing else [(length, k, s, size) for k, (s, size) in enumerate(segments(length, edits))]
            return [(shorter * (edits + 1) + k, s, s + size, shorter == length) for shorter, k, s, size in found]

        for b in batches:
            # Which document a line is from doesn't matter here, so the lines of a batch go together.
            lines = [x for text in b.column(0) for x in text.as_py().split(b"\n") if len(x) >= least]
            for at in range(0, len(lines), LINES_AT_ONCE):
                keys, ids, signs, same = [], [], [], []
                part = lines[at : at + LINES_AT_ONCE]
                sign_of = signatures(b"\n".join(part), [len(x) for x in part]).tolist()
                for line, sign in zip(part, sign_of, strict=True):
                    if (known := xxh64_intdigest(line, 42)) in seen:
                        continue
                    chars = line if line.isascii() else line.decode("utf-8", "replace")
                    if len(chars) < least:
                        continue
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen.add(known)
                    steps = plans.get(len(chars))
                    if steps is None:
                        steps = plans[len(chars)] = plan(len(chars))
                    keys += [xxh64_intdigest(chars[s:e], seed) for seed, s, e, _ in steps]
                    ids += [known] * len(steps)
                    signs += [sign] * len(steps)
                    same += [x[3] for x in steps]
                yield _key_batch(keys, ids, signs, same)

    return map_arrow(docs.select(as_bytes(F.col("text"))), run, KEYS)


def _key_batch(keys: list, ids: list, signs: list, same: list) -> pa.RecordBatch:
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    return batch(KEYS, [signed(keys), signed(ids), np.array(signs, np.int64), same])


def candidates(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Different pairs of lines (a, b) that may be within `edits`."""
    q = _keys(docs, edits, least, True).alias("q")
    s = _keys(docs, edits, least, False).drop("same").alias("s")
    once = F.when(F.col("q.same"), F.col("q.line") < F.col("s.line")).otherwise(F.col("q.line") != F.col("s.line"))
    near = F.bit_count(F.col("q.sign").bitwiseXOR(F.col("s.sign"))) <= 2 * edits
    pairs = q.join(s, (F.col("q.key") == F.col("s.key")) & once & near)
    return pairs.select(F.least("q.line", "s.line").alias("a"), F.greatest("q.line", "s.line").alias("b")).distinct()


def near_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Links (a, b) of lines within `edits`, verified on their texts."""
    pairs = checkpoint(candidates(docs, edits, least))
    release(docs.sparkSession)
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct())
    small = ids.count() <= BROADCAST_IDS
    wanted = occurrences(docs).join(F.broadcast(ids) if small else ids, "line", "left_semi")
    texts = wanted.groupBy("line", "text").count().select("line", "text")
    both = pairs.join(texts.toDF("a", "a_text"), "a").join(texts.toDF("b", "b_text"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            near = pa.array([within(s, t, edits) for s, t in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)], pa.bool_())
            yield x.select(["a", "b"]).filter(near)

    return map_arrow(both.select("a", "b", "a_text", "b_text"), run, "a bigint, b bigint")


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row, gone, links) of the rows with lines that aren't alone in their class.

    gone: (line number from 0, doc_id and line number of the line that stays for it) of those that repeat an earlier line
    of the corpus, by doc_id, then place. links: near lines of other text that the row's lines have, counted by line.
    """
    links = checkpoint(near_lines(docs, edits, least))
    near = checkpoint(components(spanning_forest(links)))
    release(docs.sparkSession)
    degrees = links.select(F.explode(F.array("a", "b")).alias("line")).groupBy("line").agg(F.count("*").alias("links"))
    places = occurrences(docs).drop("text")
    first = places.groupBy("line").agg(F.min(F.struct("doc_id", "row", "at")).alias("first"), F.count("*").alias("n"), F.min("check").alias("_low"), F.max("check").alias("_high"))
    first = first.filter("_low = _high")  # different lines of one id all stay
    classed = first.join(near, first["line"] == near["node"], "left").select("line", "first", "n", "root")
    of_class = classed.filter("root is not null").groupBy("root").agg(F.min("first").alias("class_first"))
    repeated = classed.filter("n > 1 or root is not null").join(of_class, "root", "left").join(degrees, "line", "left")
    repeated = repeated.select("line", F.coalesce("class_first", "first").alias("keep"), F.coalesce("links", F.lit(0)).alias("links"))
    repeated = checkpoint(repeated)  # so that the join below shuffles both sides, and a hot line can be split
    found = places.join(repeated, "line")
    repeats = ~F.struct("doc_id", "row", "at").eqNullSafe(F.col("keep"))
    gone = F.when(repeats, F.struct("at", F.col("keep.doc_id").alias("doc_id"), F.col("keep.at").alias("line")))
    return found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(gone)).alias("gone"), F.sum("links").alias("links"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` with repeated lines taken out of the text, and four more columns, which replace others of their names.

    gone_lines array<int>: the lines taken out; kept_lines array<string>: for each, 'doc_id:line' of the one that stays for
    its class; near_links bigint: near lines of other text that the row's lines have; text_before.

    Lines are equal by two 64-bit hashes. Blank lines always stay and a null text stays null. Shorter lines than `least_chars` only go if equal. Rows are never
    dropped: a text all of whose lines repeat becomes empty. Rows that repeat with id and text count as one place. Of
    rows without an id the lines come first.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeated_lines(plain, edits, least_chars).toDF("_id", "_row", "_gone", "_links")
    new = ("gone_lines", "kept_lines", "near_links", "text_before")
    others = [c for c in docs.columns if c not in (text_col, *new)]
    keyed = docs.select(F.struct(*others).alias("r"), F.col(id_col).cast("bigint").alias("_i"), F.col(text_col).alias("_t"), _row_key(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))).alias("_k"))
    joined = keyed.join(found, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_row")), "left")
    gone = F.transform("_gone", lambda x: x["at"])
    # The one-element array binds the lines, so that they are cut once for all their places.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.transform(F.array(_lines(F.col("_t"))), lambda lines: F.array_join(F.transform(stay(lines), lambda k: lines[k]), "\n"))[0]
    kept = F.when(F.size("_gone") > 0, left).otherwise(F.col("_t"))
    made = {
        "gone_lines": F.coalesce(gone, F.expr("cast(array() as array<int>)")),
        "kept_lines": F.coalesce(F.transform("_gone", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["line"].cast("string"))), F.expr("cast(array() as array<string>)")),
        "near_links": F.coalesce("_links", F.lit(0)),
        "text_before": F.col("_t"),
    }
    return joined.select(*[F.col("r")[c].alias(c) for c in others], kept.alias(text_col), *[made[n].alias(n) for n in new])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.size(_lines(F.coalesce("text_before", F.lit("")))).cast("bigint")
    return out.select("doc_id", n_lines.alias("n_lines"), F.size("gone_lines").cast("bigint").alias("n_removed"), F.array_join("gone_lines", ",").alias("removed_lines"), F.array_join("kept_lines", ",").alias("kept_by"), "near_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
