"""Hard negatives by cover trees over norm-augmented candidates.

With one more coordinate, sqrt(M^2 - |x|^2), all vectors of a shard have the length M, so that the distance d of an
anchor q to a vector x says q.x = (|q|^2 + M^2 - d^2) / 2. Each shard is a cover tree: a node's children are a net of its
vectors, chosen farthest first until half the node's radius is covered, and each keeps its exact covering radius. A
node at distance d with radius r holds inner products from (|q|^2 + M^2 - (d + r)^2) / 2 to (|q|^2 + M^2 - (d - r)^2) / 2
only. An anchor goes down through the nodes that may hold something between the ends of its windows, takes leaves by
falling bound, verifies their vectors by exact integer products, and stops once no leaf can improve what it holds.

Rows are dealt into shards by ranges of label, so a hot label fills shards of its own and positives are sought in the
shards of the anchor's label only. A tree and the anchors of one shard are a row each. Anchors travel to the shards, in
blocks, where they meet the tree one block after the other.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
ANCHOR_EVERY, RELABEL_EVERY, LABELS, SCALE = 100, 7, 10, 256
#: Rows and components of a shard, about, and rows of one where that gives fewer than SHARDS_LEAST shards; rows of a leaf; children of a node.
SHARD_ROWS, SHARD_NUMBERS, SHARDS_LEAST, SMALL_SHARD_ROWS, LEAF_ROWS, CHILDREN = 32_768, 4_000_000, 64, 4_096, 64, 64
#: Leaves that an anchor verifies first; each next step takes twice as many.
FIRST_LEAVES = 4
#: Beyond the first bound, products are made of integers; beyond the second they don't fit the result.
EXACT_FLOAT, EXACT_INT = 2.0**53, 2.0**63
#: Share of the squared lengths by which bounds are widened against rounding.
SLACK = 1e-9
VECTORS = "row bigint, vec_id bigint, label string, anchor boolean, v array<bigint>"
SHARDS = "shard bigint, labels array<string>, tree binary, anchors binary"
FOUND = "row bigint, anchor_id bigint, slot int, other_id bigint, score bigint"


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return dict(f)


def small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def padded(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of one width; shorter vectors go on with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def build(v: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS, children: int = CHILDREN) -> dict[str, np.ndarray]:
    """A cover tree: `order` of the rows; for each node its `center` (a row), `radius`, `parent` (before it) and rows `first` to `last` in order; `leaf` marks those without children."""
    x = v.astype(np.float64)
    norms = (x * x).sum(axis=1)
    top = norms.max(initial=0.0)
    more = np.sqrt(np.maximum(top - norms, 0.0))

    def distances(center: int, rows: np.ndarray) -> np.ndarray:
        squared = norms[rows] + norms[center] - 2 * (x[rows] @ x[center]) + (more[rows] - more[center]) ** 2
        return np.sqrt(np.maximum(squared, 0.0))

    nodes, order = [], []
    start = np.argsort(ids, kind="stable")
    stack = [(int(start[0]), distances(int(start[0]), start), start, -1)] if len(start) else []
    while stack:
        center, far, rows, parent = stack.pop()
        me, radius = len(nodes), float(far.max())
        leaf = len(rows) <= leaf_rows or radius**2 <= SLACK * top
        nodes.append([center, radius, parent, len(order), len(rows), leaf])
        if leaf:
            order += rows.tolist()
            continue
        nearest, whose, centers = far, np.zeros(len(rows), np.int64), [center]
        while len(centers) < children and nearest.max() > radius / 2:
            centers.append(int(rows[nearest.argmax()]))
            d = distances(centers[-1], rows)
            whose[closer := d < nearest] = len(centers) - 1
            nearest = np.where(closer, d, nearest)
        for k in reversed(range(len(centers))):  # a node's descendants follow it, in order
            if len(part := np.nonzero(whose == k)[0]):
                stack.append((centers[k], nearest[part], rows[part], me))
    center, radius, parent, first, rows, leaf = map(np.array, zip(*nodes, strict=True)) if nodes else [np.zeros(0, np.int64)] * 6
    return {"order": np.array(order, np.int64), "center": center, "radius": radius, "parent": parent, "first": first, "last": first + rows, "leaf": leaf.astype(bool)}


class Tree:
    """A shard's tree as searched: its vectors in the order of the leaves."""

    def __init__(self, data: bytes):
        t = load(data)
        self.rows, self.ids, self.labels = (t[c][t["order"]] for c in ("rows", "ids", "labels"))
        self.v = t["v"][t["order"]].astype(np.int64)
        self.floats = self.v.astype(np.float64)
        self.centers, self.radius = t["v"][t["center"]].astype(np.float64), t["radius"]
        self.parent, self.first, self.last, self.leaf = t["parent"], t["first"], t["last"], t["leaf"]
        self.top = (self.floats * self.floats).sum(axis=1).max(initial=0.0)
        depth = np.zeros(len(self.parent), np.int64)
        for n, parent in enumerate(self.parent.tolist()):  # parents come before their children
            depth[n] = depth[parent] + 1 if parent >= 0 else 0
        self.levels = [np.nonzero(depth == d)[0] for d in range(1, depth.max(initial=0) + 1)]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node (column) the least and greatest inner product that it may hold with each anchor (row)."""
        both = (q * q).sum(axis=1)[:, None] + self.top
        d = np.sqrt(np.maximum(both - 2 * (q @ self.centers.T), 0.0))
        slack = SLACK * both + 1e-6
        return (both - (d + self.radius) ** 2) / 2 - slack, (both - np.maximum(d - self.radius, 0.0) ** 2) / 2 + slack

    def products(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact products of the vectors in some places with an integer anchor."""
        if self.most(q) < EXACT_FLOAT / 2:
            return (self.floats[at] @ q.astype(np.float64)).astype(np.int64)
        return self.v[at] @ q

    def most(self, q: np.ndarray) -> float:
        """What no product with an anchor exceeds."""
        return float(np.sqrt(self.top) * np.sqrt((q.astype(np.float64) ** 2).sum()))

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, windows: np.ndarray, allowed: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each window (lowest and highest score, ends included) the first k of (score, id) among the allowed places."""
        if self.most(q) >= EXACT_INT / 2:
            raise OverflowError("a score may not fit in 64 bits")
        held: list[list[tuple[int, int]]] = [[] for _ in windows]
        least = windows[:, 0].astype(np.float64)  # what a leaf must reach to matter to a window
        alive = ((high[:, None] >= least) & (low[:, None] <= windows[:, 1])).any(axis=1)
        for level in self.levels:  # a node is only looked at below one that matters
            alive[level] &= alive[self.parent[level]]
        leaves = np.nonzero(alive & self.leaf)[0]
        leaves = leaves[np.argsort(-high[leaves], kind="stable")]
        begin, step = 0, FIRST_LEAVES
        while begin < len(leaves):
            part, begin, step = leaves[begin : begin + step], begin + step, step * 2
            part = part[((high[part, None] >= least) & (low[part, None] <= windows[:, 1])).any(axis=1)]
            if not len(part):
                if not (high[leaves[begin:], None] >= least).any():
                    break
                continue
            at = np.concatenate([np.arange(self.first[n], self.last[n]) for n in part])
            at = at[allowed[at]]
            scores = self.products(at, q)
            for w, (lowest, highest) in enumerate(windows):
                good = np.nonzero((scores >= max(lowest, held[w][-1][0] if len(held[w]) == k else lowest)) & (scores <= highest))[0]
                if len(good):
                    good = good[np.lexsort((self.ids[at[good]], -scores[good]))[:k]]
                    new = zip(scores[good].tolist(), self.ids[at[good]].tolist(), strict=True)
                    held[w] = sorted([*held[w], *new], key=lambda x: (-x[0], x[1]))[:k]
                    if len(held[w]) == k:
                        least[w] = max(least[w], held[w][-1][0])
        return held


def _shards(vectors: DataFrame) -> DataFrame:
    """SHARDS of VECTORS, a table: trees over all rows, and the anchors among them."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    rows = max(min(SHARD_ROWS, SHARD_NUMBERS // max(size.width or 1, 1), max(size.n // SHARDS_LEAST, SMALL_SHARD_ROWS)), 1)
    dealt = vectors.repartitionByRange(max(-(-size.n // rows), 1), "label", F.xxhash64("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        v = small(padded([np.asarray(x.values) for x in t["v"]]))
        own = {"rows": t["row"].to_numpy(), "ids": t["vec_id"].to_numpy(), "labels": np.array(t["label"].to_pylist(), str)}
        which = t["anchor"].to_numpy()
        tree, anchors = dump(v=v, **own, **build(v, own["ids"])), dump(v=v[which], **{n: x[which] for n, x in own.items()})
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sorted(set(own["labels"].tolist()))]), pa.array([tree], pa.binary()), pa.array([anchors], pa.binary())], names=["shard", "labels", "tree", "anchors"])

    return map_arrow(dealt, run, SHARDS)


def _search(pairs: DataFrame, trees: DataFrame, shards: int, same_label: bool, k: int, low: int, high: int) -> DataFrame:
    """FOUND by each anchor in each shard that it is sent to, in as many tasks as there are shards. `pairs` (shard, block, data, windows): the anchors of a block, and with `windows` (row, slot, score) their positives."""
    kinds = dict(pairs.dtypes)
    both = trees.select("shard", F.lit(-1).cast("bigint").alias("block"), F.col("tree").alias("data"), F.lit(None).cast(kinds["windows"]).alias("windows"))
    both = both.unionByName(pairs).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for b in batches:
            for r in range(b.num_rows):
                at, block, data, windows = (c[r] for c in b.columns)
                if block.as_py() < 0:
                    shard, tree = at.as_py(), Tree(data.as_buffer())
                elif tree is not None and at.as_py() == shard:
                    yield _block(tree, load(data.as_buffer()), windows.as_py(), same_label, k, low, high)

    return map_arrow(both, run, FOUND)


def _block(tree: Tree, anchors: dict[str, np.ndarray], positives: list | None, same_label: bool, k: int, low: int, high: int) -> pa.RecordBatch:
    """FOUND by the anchors of one block in one tree."""
    width = max(anchors["v"].shape[1], tree.v.shape[1])
    q = np.pad(anchors["v"].astype(np.int64), ((0, 0), (0, width - anchors["v"].shape[1])))
    if tree.v.shape[1] < width:
        tree.v, tree.floats, tree.centers = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (tree.v, tree.floats, tree.centers))
    lows, highs = tree.bounds(q.astype(np.float64))
    everything = np.array([[-(1 << 62), 1 << 62]])
    windows: dict[int, list[tuple[int, int]]] = {}
    for p in positives or []:
        windows.setdefault(p["row"], []).append((p["slot"], p["score"]))
    out: list[list[int]] = [[], [], [], [], []]
    for a, (row, vec_id, label) in enumerate(zip(anchors["rows"].tolist(), anchors["ids"].tolist(), anchors["labels"].tolist(), strict=True)):
        if positives is None:
            slots, ranges = [0], everything
        else:
            sought = [(slot, -(-low * s // 100), high * s // 100) for slot, s in windows.get(row, [])]
            sought = [x for x in sought if x[1] <= x[2]]
            slots, ranges = [x[0] for x in sought], np.array([x[1:] for x in sought], np.int64).reshape(-1, 2)
        allowed = (tree.labels == label) == same_label
        allowed &= tree.rows != row
        if len(slots) and allowed.any():
            for slot, found in zip(slots, tree.search(q[a], lows[a], highs[a], ranges, allowed, k), strict=True):
                for score, other in found:
                    for column, value in zip(out, (row, vec_id, slot, other, score), strict=True):
                        column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["row", "anchor_id", "slot", "other_id", "score"])


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of each anchor over all shards, with their rank from 1. Spark takes the first k in each partition before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (vec_id, label, v array<bigint>).

    An anchor's positives are its best `positives` other rows of the same label. For each, its negatives are the best
    `negatives` rows of another label that score from `low` to `high` percent of the positive's score. Higher scores come
    first, then smaller ids. Rows without an id, label or vector, or with a null component, take no part. Shorter
    vectors count as filled up with zeros. Rows that repeat, or share an id, are rows of their own: all can be found, and each anchor
    row answers for itself. Positives that no negative fits give no row, and so does an empty table. Scores must fit in
    64 bits. Other columns of `vectors` are ignored.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "v")
    rows = written(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())))
    shards = written(_shards(rows))
    everywhere = [r.shard for r in shards.select("shard").collect()]  # a number for each shard of thousands of rows
    trees, blocks = shards.select("shard", "tree"), shards.select(F.col("shard").alias("block"), F.col("anchors").alias("data"), "labels")
    homes = shards.select("shard", F.explode("labels").alias("label"))
    visits = blocks.select("block", F.explode("labels").alias("label")).join(homes, "label").select("block", "shard").distinct()
    none = F.lit(None).cast("array<struct<row:bigint,slot:int,score:bigint>>")
    near = _search(visits.join(blocks, "block").select("shard", "block", "data", none.alias("windows")), trees, len(everywhere), True, positives, low, high)
    best = written(_first(near, ["row"], positives).select("row", "anchor_id", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = best.join(_home(shards), "row").groupBy("block").agg(F.collect_list(F.struct("row", "slot", F.col("positive_score").alias("score"))).alias("windows"))
    sent = blocks.join(windows, "block").select("block", "data", "windows", F.explode(F.lit(everywhere).cast("array<bigint>")).alias("shard"))
    found = _first(_search(sent, trees, len(everywhere), False, negatives, low, high), ["row", "slot"], negatives)
    out = found.join(best.drop("anchor_id"), ["row", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _home(shards: DataFrame) -> DataFrame:
    """(row, block) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column(0), b.column(1), strict=True):
                rows = load(data.as_buffer())["rows"]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.full(len(rows), shard.as_py()), pa.int64())], names=["row", "block"])

    return map_arrow(shards.select("shard", "anchors"), run, "row bigint, block bigint")


def integer_vectors(embeddings: DataFrame, scale: int = SCALE, every: int = RELABEL_EVERY, labels: int = LABELS) -> DataFrame:
    """(vec_id, label, v) of (vec_id, embedding, label): components times `scale`, rounded down. Rows with a null label or vector, or a component that is null or no finite number, go; each `every`th id gets the next of `labels` labels."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = embeddings.select("vec_id", "embedding", "label").filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return kept.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % ANCHOR_EVERY == 0)


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS slot FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.slot ORDER BY s.score DESC, s.other_id)::INTEGER AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.slot <= 5
)
SELECT * FROM n WHERE rank <= 5
"""
