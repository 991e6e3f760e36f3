"""Packing documents that are too long for one task.

Lines or blocks come as rows. Those of a long document are dealt into segments of bounded size. What packing does to a
segment depends only on how many characters are held when it begins, so each segment becomes a table of what is held at
its end for every number at its start. Such tables compose: groups of FAN neighbours become one, level by level, and on
the way back down every segment learns what is really held where it begins. It then knows the first place where a chunk
begins anew, and between these places the pieces of a document are packed apart from each other, by the same folds as
short documents are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..folders import saved
from ..functions.text import strip
from . import chunking

#: Places of a segment, which holds as many items at most, and tables that one task composes.
SEGMENT_PLACES, FAN = 4096, 256
#: Items after which equal states are looked for.
SETTLE_ITEMS = 16
#: Rows of keys, cuts and counts up to which they are broadcast to the texts.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Packing:
    """A way of packing: what an item does to the characters held, and the fold over items (content, header) that makes chunks."""

    strategy: str
    step: Callable
    most_held: Callable[[int], int]
    fold: Callable[[list[tuple[str, str | None]], int], list[tuple[str, str | None]]]


def _paragraph_step(used, length: int, size: int):
    """(characters held after a line, whether a chunk begins with it)."""
    fits = used + length + 1 <= size
    alone = 0 if length > size else min(length + 1, size)
    return np.where(fits, used + length + 1, alone), ~fits | (used == 0)


def _block_step(used, length: int, size: int):
    """The same for a block: one that must be split takes a short rest in front of it and leaves nothing held."""
    goes_on = (used + length <= size) | (used < size * chunking.SHORT_SHARE)
    after = np.where(goes_on, used + length + 1, length + 1)
    return after * (length <= size), ~goes_on | (used == 0)


PARAGRAPHS = Packing(chunking.FIXED, _paragraph_step, lambda size: size, lambda items, size: [(c, None) for c in chunking.pack_paragraphs("\n".join(x for x, _ in items), size)])
BLOCKS = Packing(chunking.ADAPTIVE, _block_step, lambda size: int(size * (1 + chunking.SHORT_SHARE)) + 1, chunking.pack_blocks)


def held_after(lengths: list[int], size: int, packing: Packing) -> np.ndarray:
    """What is held behind the items, for each number held in front of them. Soon many starts lead to the same state; these go on as one."""
    state = np.arange(packing.most_held(size) + 1)
    start = np.arange(len(state))
    for k, n in enumerate(lengths):
        state, _ = packing.step(state, n, size)
        if k % SETTLE_ITEMS == 0 and len(state) > 1:
            state, same = np.unique(state, return_inverse=True)
            start = same[start]
    return state[start]


def first_beginning(lengths: list[int], used: int, size: int, packing: Packing) -> int:
    """The place of the first item that begins a chunk, or -1."""
    state = np.int64(used)
    for k, n in enumerate(lengths):
        state, begins = packing.step(state, n, size)
        if begins:
            return k
    return -1


def _sent(df: DataFrame) -> DataFrame:
    """A table of few columns, saved; to be broadcast if it has few rows."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tables(segments: DataFrame, size: int, packing: Packing) -> DataFrame:
    """(_key, _g, lengths, fn) of the segments of long documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(fn=[held_after([int(n) for n in x], size, packing).astype(np.int32) for x in f["lengths"]])

    rows = segments.select("_key", F.col("_segment").alias("_g"), F.transform("items", lambda x: F.length(x["content"])).alias("lengths"))
    return rows.mapInPandas(run, f"_key {dict(rows.dtypes)['_key']}, _g bigint, lengths array<int>, fn array<int>")


def _composed(tables: DataFrame) -> DataFrame:
    """One table for each FAN neighbours."""

    def compose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_g")
        fn = f["fn"].iloc[0]
        for g in f["fn"].iloc[1:]:
            fn = np.asarray(g)[np.asarray(fn)]
        return pd.DataFrame({"_key": f["_key"].iloc[:1], "_g": [f["_g"].iloc[0] // FAN], "fn": [fn]})

    rows = tables.select("_key", "_g", "fn")
    return rows.groupBy("_key", F.expr(f"_g div {FAN}").alias("_up")).applyInPandas(compose, f"_key {dict(rows.dtypes)['_key']}, _g bigint, fn array<int>")


def _held_before(tables: DataFrame, above: DataFrame) -> DataFrame:
    """(_key, _g, used) of tables, given that of the groups above them."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_g")
        used, out = int(f["used"].iloc[0]), []
        for fn in f["fn"]:
            out.append(used)
            used = int(fn[used])
        return pd.DataFrame({"_key": f["_key"], "_g": f["_g"], "used": out})

    up = above.select(F.col("_key").alias("_k"), F.col("_g").alias("_up"), "used")
    rows = tables.select("_key", "_g", "fn", F.expr(f"_g div {FAN}").alias("_own"))
    rows = rows.join(up, rows["_key"].eqNullSafe(up["_k"]) & (rows["_own"] == up["_up"])).select("_key", "_g", "fn", "used", "_own")
    return rows.groupBy("_key", "_own").applyInPandas(walk, f"_key {dict(rows.dtypes)['_key']}, _g bigint, used int")


def _cuts(segments: DataFrame, size: int, packing: Packing) -> DataFrame:
    """(_key, _g, cut, owner): where the first chunk of a segment begins, and the segment whose piece takes what stands in front of it."""
    levels = [saved(_tables(segments, size, packing))]
    while (levels[-1].agg(F.max("_g")).first()[0] or 0) > 0:  # one round for each factor of FAN in the longest document
        levels.append(saved(_composed(levels[-1])))
    held = levels[-1].select("_key", "_g", F.lit(0).alias("used"))
    for tables in reversed(levels[:-1]):
        held = saved(_held_before(tables, held))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [first_beginning([int(n) for n in x], int(u), size, packing) for x, u in zip(f["lengths"], f["used"], strict=True)]
            yield pd.DataFrame({"_key": f["_key"], "_g": f["_g"], "cut": cut})

    of_key = held.select(F.col("_key").alias("_k"), F.col("_g").alias("_h"), "used")
    rows = levels[0].select("_key", "_g", "lengths")
    rows = rows.join(of_key, rows["_key"].eqNullSafe(of_key["_k"]) & (rows["_g"] == of_key["_h"])).select("_key", "_g", "lengths", "used")
    cuts = rows.mapInPandas(run, f"_key {dict(rows.dtypes)['_key']}, _g bigint, cut int")
    before = Window.partitionBy("_key").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.withColumn("owner", F.last(F.when(F.col("cut") >= 0, F.col("_g")), ignorenulls=True).over(before))


def _pieces(items: DataFrame, size: int, packing: Packing) -> DataFrame:
    """(_key, _piece, items): documents in pieces that are packed apart; short documents are one."""
    long = _sent(items.groupBy("_key").agg(F.max("_segment").alias("_last")).filter("_last > 0").select(F.col("_key").alias("_k"), F.lit(True).alias("_long")))
    flagged = items.join(long, items["_key"].eqNullSafe(F.col("_k")), "left").drop("_k")
    ordered = F.sort_array(F.collect_list(F.struct("_at", "content", "header"))).alias("items")
    segments = saved(flagged.groupBy("_key", "_segment", F.coalesce("_long", F.lit(False)).alias("_long")).agg(ordered))
    short = segments.filter("not _long").select("_key", F.col("_segment").alias("_piece"), "items")
    if long.isEmpty():
        return short
    cuts = _cuts(segments.filter("_long"), size, packing)
    cuts = _sent(cuts.select(F.col("_key").alias("_k"), "_g", "cut", "owner"))
    met = segments.filter("_long").join(cuts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_segment") == F.col("_g")))
    n = F.size("items")
    head = F.struct(F.col("owner").alias("_piece"), F.when(F.col("cut") < 0, F.col("items")).otherwise(F.slice("items", F.lit(1), F.col("cut"))).alias("items"))
    rest = F.struct(F.col("_segment").alias("_piece"), F.slice("items", F.col("cut") + 1, n - F.col("cut")).alias("items"))
    parts = F.when(F.col("cut") < 0, F.array(head)).when(F.col("cut") == 0, F.array(rest)).otherwise(F.array(head, rest))
    apart = met.select("_key", F.explode(parts).alias("x")).select("_key", "x._piece", "x.items")
    joined = apart.groupBy("_key", "_piece").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))
    return short.unionByName(joined)


def pack_rows(items: DataFrame, packing: Packing, size: int = catalog.CHUNK_SIZE, places: int = SEGMENT_PLACES) -> DataFrame:
    """(doc_id, chunk_idx, chunk, length, strategy, note) of (doc_id, at, content, header), in order of `at`, a number from 0 that may have gaps.

    The chunks are those that the fold over the whole document gives. A task holds the items of `places` places and of a
    chunk at most. A null doc_id is a document of its own; items that share a place are ordered by content. Empty and null contents go.
    """
    rows = items.filter("content is not null and content <> ''")
    rows = rows.select(F.col("doc_id").alias("_key"), F.col("at").cast("bigint").alias("_at"), "content", F.coalesce("header", F.lit("")).alias("header")).withColumn("_segment", F.expr(f"_at div {places}"))
    pieces = _pieces(rows, size, packing)
    schema = f"_key {dict(pieces.dtypes)['_key']}, _piece bigint, _local int, chunk string, note string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(key, piece, k, chunk, note) for key, piece, given in zip(f["_key"], f["_piece"], f["items"], strict=True) for k, (chunk, note) in enumerate(packing.fold([(x["content"], x["header"]) for x in given], size))]
            yield pd.DataFrame(out, columns=["_key", "_piece", "_local", "chunk", "note"])

    chunks = saved(pieces.mapInPandas(run, schema))
    counts = chunks.groupBy("_key", "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = _sent(counts.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    out = chunks.join(counts, chunks["_key"].eqNullSafe(counts["_k"]) & (chunks["_piece"] == counts["_p"]))
    return out.select(F.col("_key").alias("doc_id"), (F.col("_before") + F.col("_local")).cast("int").alias("chunk_idx"), "chunk", F.length("chunk").alias("length"), F.lit(packing.strategy).alias("strategy"), "note")


def chunk_lines(lines: DataFrame, size: int = catalog.CHUNK_SIZE, places: int = SEGMENT_PLACES) -> DataFrame:
    """chunk_paragraphs() of documents whose lines (doc_id, at, line) are rows."""
    items = lines.select("doc_id", "at", strip(F.col("line")).alias("content"), F.lit("").alias("header"))
    return pack_rows(items, PARAGRAPHS, size, places)


def chunk_block_rows(blocks: DataFrame, size: int = catalog.CHUNK_SIZE, places: int = SEGMENT_PLACES) -> DataFrame:
    """chunk_markdown() of blocks (doc_id, block_idx, content, header_text) of documents of any length."""
    return pack_rows(blocks.select("doc_id", F.col("block_idx").alias("at"), "content", F.col("header_text").alias("header")), BLOCKS, size, places)
