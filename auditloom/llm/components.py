"""Connected components of a link table, with DataFrame joins and checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpoint, map_arrow

LINKS, ROOTS = "a bigint, b bigint", "node bigint, root bigint"
#: More rounds than any link table needs: each halves the longest path at least.
MOST_ROUNDS = 60
#: Links that one task connects.
ONE_TASK_LINKS = 100_000


def spanning_forest(links: DataFrame) -> DataFrame:
    """Links (a, b) without those that others of their batch imply. Connects what `links` connects; memory is one batch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield forest_of(x.column(0).to_pylist(), x.column(1).to_pylist())

    return map_arrow(links.select("a", "b"), run, LINKS)


def forest_of(first: list[int], second: list[int]) -> pa.RecordBatch:
    """The links of a batch that join what the ones before leave apart."""
    root: dict[int, int] = {}
    kept: tuple[list[int], list[int]] = ([], [])
    for a, b in zip(first, second, strict=True):
        ra, rb = _find(root, a), _find(root, b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept[0].append(a)
            kept[1].append(b)
    return batch(LINKS, list(kept))


def _find(root: dict[int, int], x: int) -> int:
    top = x
    while (up := root.get(top, top)) != top:
        top = up
    while (up := root.get(x, x)) != top:
        root[x], x = top, up
    return top


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b): root is the least node it is connected with.

    Alternates two steps on links that point from the larger to the smaller node: each node hands its larger neighbours
    to its least one, then its smaller ones. A node's links are never gathered in one row; a node with very many links is
    a skewed join key, which adaptive execution splits. Up to ONE_TASK_LINKS links, which need a bounded memory, are
    connected by one task instead of by dozens of small shuffles.
    """
    links = checkpoint(links.select("a", "b").filter("a <> b"))
    if links.count() <= ONE_TASK_LINKS:
        return checkpoint(_in_one_task(links))
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down = checkpoint(down)
    seen = None
    for _ in range(MOST_ROUNDS):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        down = checkpoint(small.filter("u <> v").distinct())
        state = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        nodes: set[int] = set()
        for x in batches:
            for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                nodes |= {a, b}
                a, b = _find(root, a), _find(root, b)
                root[max(a, b)] = min(a, b)
        found = list(nodes)
        yield batch(ROOTS, [found, [_find(root, n) for n in found]])

    return map_arrow(links.coalesce(1), run, ROOTS)
