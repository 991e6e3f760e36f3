"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the count of set bits in each, 0 to 2, embeds it in a grid of
32 dimensions where the Manhattan distance never exceeds the Hamming distance. The counts are written in unary (00, 01,
11), so one exclusive-or and one bit count give the Manhattan distance.

Range join: the dimensions fall into more groups than bits may differ. Of two fingerprints within `bits`, all but
`bits` groups at least agree in their counts, so each fingerprint stands in one cell for each choice of that many groups
and meets those of its cell. How many groups there are follows the number of fingerprints, so that cells stay small: it
changes the work, not what is found. A candidate must pass the Manhattan bound over all dimensions, then the exact
Hamming distance, both inside the join condition: only links leave the join.

Equal fingerprints are one node before any of this, and links become a spanning forest, batch by batch, before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpoint, discard, groups_of, map_arrow, release, table, written
from .components import components, forest_of, spanning_forest
from .words import Runs, by_text, distinct, places

WORDS, BITS = 4, 4
SEED = 42
SEGMENTS = 32
#: Random fingerprints that a cell may hold on average.
CELL_NODES = 16
LOW_BITS = 0x5555555555555555
BYTE_ONES = 0x0101010101010101
#: Stands for the id of fingerprints whose rows have none; real ids are below.
NO_ID = 1 << 62

PRINTS = "doc_id bigint, fp bigint"


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of `words` lower-cased words; a shorter text is one run, a text without words none."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)]
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes, whose lengths are `sizes`: the bits set in over half of them.

    Eight bits at a time are spread over the bytes of a word, so that plain additions count them; a byte holds 255.
    """
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        parts = np.flatnonzero(at % 255 == 0)
        spread = np.stack([np.add.reduceat((hashes >> np.uint64(s)) & np.uint64(BYTE_ONES), parts) for s in range(8)], axis=1)
        counts = spread.astype("<u8").view(np.uint8).reshape(len(parts), 8, 8).astype(np.int64)
        counts = np.add.reduceat(counts, np.flatnonzero(at[parts] == 0), axis=0).transpose(0, 2, 1).reshape(len(some), 64)
        out[some] = np.packbits(2 * counts > sizes[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64 bits of one text."""
    hashes = shingle_hashes(text, words)
    return int(majorities(np.array(hashes, np.uint64), np.array([len(hashes)]))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed number. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = []
            for texts in groups_of([x.as_py() for x in b.column(1)]):
                hashes = [shingle_hashes(t, words) for t in texts]
                prints.append(majorities(np.fromiter(chain.from_iterable(hashes), np.uint64), np.array(list(map(len, hashes)))))
            yield batch(PRINTS, [b.column(0), np.concatenate(prints).view(np.int64)])

    return map_arrow(docs.select(F.col(id_col).cast("bigint"), as_bytes(F.col(text_col))), run, PRINTS)


def embedding(fp: Column) -> Column:
    """The counts of the 32 segments in unary."""
    low = F.lit(LOW_BITS)
    odd, even = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    return odd.bitwiseOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cell_masks(bits: int, nodes: int) -> list[int]:
    """The bits of the code that make a cell, for each choice of groups.

    A segment tells 1.5 bits on average, so a cell of half the segments has one in 2^24 of random fingerprints.
    """
    for groups in range(bits + 2, 2 * bits + 1):
        if nodes / 2 ** (1.5 * SEGMENTS * (groups - bits) / groups) <= CELL_NODES:
            break
    else:
        groups = max(2 * bits, bits + 1)
    at = [round(k * SEGMENTS / groups) for k in range(groups + 1)]
    own = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(at, at[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(own, groups - bits)]


def links_within(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) of all nodes (node, fp, code), one row for each distinct fp, at `bits` or fewer differing bits; a link may come more than once."""
    rows = [F.struct(F.lit(k).cast("tinyint").alias("t"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("cell")) for k, m in enumerate(cell_masks(bits, nodes.count()))]
    cells = nodes.select("node", "fp", "code", F.explode(F.array(*rows)).alias("x")).select("node", "fp", "code", "x.t", "x.cell")
    p, q = cells.alias("p"), cells.alias("q")
    near = (distance(F.col("p.code"), F.col("q.code")) <= bits) & (distance(F.col("p.fp"), F.col("q.fp")) <= bits)
    return p.join(q, (F.col("p.t") == F.col("q.t")) & (F.col("p.cell") == F.col("q.cell")) & (F.col("p.node") < F.col("q.node")) & near).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def near_duplicates(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of fingerprints(): the least doc_id reachable over links, itself included.

    All rows of a fingerprint are linked, those of texts without words too. Rows without a doc_id are linked and
    reported, but never name a component; where no row of it has an id, component_id is null.
    """
    prints = checkpoint(prints)
    substitute = F.lit(NO_ID) + F.shiftrightunsigned("fp", 2)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).select("fp", F.coalesce("node", substitute).alias("node"))
    nodes = checkpoint(nodes.withColumn("code", embedding(F.col("fp"))))
    roots = components(spanning_forest(links_within(nodes, bits)))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return prints.join(named, "fp").select("doc_id", "fp", F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a passage on average, for similar_documents(); neighbours that a passage's document is compared with first; rows of a key that stand together; bits beyond which documents aren't compared first. None of these decides what is found.
PASSAGE_WORDS, NEIGHBOURS, ORDERED_ROWS, FAR_BITS, LIKELY_BITS = 16, 4, 5_000, 22, 3
#: Rows of a rare shingle from which its central document is compared first.
HUB_ROWS = 8
#: Counters of how frequent shingles are, over all documents, and counters that travel as one row. They order shingles; any order finds the same.
COUNTERS, COUNTER_BLOCK = 1 << 22, 1 << 12
#: Slack of the bounds, so that rounding never loses a pair.
SLACK = 1e-6
#: Candidate documents up to which their keys are broadcast to fetch the texts.
BROADCAST_IDS = 500_000
SKETCH = "rid bigint, doc_id bigint, key bigint, fp bigint, same bigint, n bigint, passages array<bigint>, prefix array<bigint>"


def distinct_shingles(runs: Runs, words: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = runs.shingles(words)
    return distinct(hashes, np.repeat(np.arange(len(counts)), counts))


def shingle_frequencies(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many shingles of all rows, repeats included, fall on each counter: a table of fixed size."""
    blocks = "block int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for texts in groups_of([x.as_py() for x in b.column(0)]):
                hashes, _ = Runs(texts).shingles(words)
                np.add.at(sums, (hashes % np.uint64(COUNTERS)).astype(np.int64), 1)
        for block in range(0, COUNTERS, COUNTER_BLOCK):
            if sums[block : block + COUNTER_BLOCK].any():
                yield packed(block, sums[block : block + COUNTER_BLOCK])

    def packed(block: int, own: np.ndarray) -> pa.RecordBatch:
        return batch(blocks, [[block], [pa.compress(own.tobytes(), codec="zstd", asbytes=True)]])

    def unpacked(own: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(own, 8 * COUNTER_BLOCK, codec="zstd", asbytes=True), np.int64)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums.setdefault(block, np.zeros(COUNTER_BLOCK, np.int64))[:] += unpacked(own.as_py())
        for block, own in sums.items():
            yield packed(block, own)

    parts = map_arrow(docs.select(as_bytes(F.col(text_col))), count, blocks)
    counted = map_arrow(parts.repartition("block"), fold, blocks).toArrow()  # COUNTERS numbers
    out = np.zeros(COUNTERS, np.int64)
    for block, own in zip(counted["block"].to_pylist(), counted["counts"].to_pylist(), strict=True):
        out[block : block + COUNTER_BLOCK] = unpacked(own)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each count among the different ones: the same order in as few bytes as it takes."""
    different, at = np.unique(counts, return_inverse=True)
    return at.astype(np.uint16 if len(different) <= 1 << 16 else np.uint32)


def prefixes(found: np.ndarray, text_of: np.ndarray, n: np.ndarray, frequency: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each text): the rarest of a text's n different shingles, so many that any text this similar has one of them among its own rarest."""
    order = by_text(np.argsort(frequency[(found % np.uint64(COUNTERS)).astype(np.int64)], kind="stable"), text_of)
    most = np.minimum(n, n - np.ceil(similarity * n - SLACK).astype(np.int64) + 1)
    first = places(n) < np.repeat(most, n)
    return found[order][first], most


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Of each row a number of its own, the hash of its text, its fingerprint, a hash of its words, number of different shingles, passages, and rarest shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks(shingle_frequencies(docs, text_col, words)))  # COUNTERS numbers

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), values.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in groups_of([x.as_py() for x in b.column(3)]):
                runs = Runs(texts)
                hashes, counts = runs.shingles(words)
                found, text_of = distinct(hashes, np.repeat(np.arange(len(texts)), counts))
                n = np.bincount(text_of, minlength=len(texts))
                cut, cut_of = distinct(*runs.pieces(PASSAGE_WORDS))
                prints, same = majorities(hashes, counts).view(np.int64), runs.wholes().view(np.int64)
                rows = b.slice(at, len(texts))
                at += len(texts)
                yield batch(SKETCH, [*rows.columns[:3], prints, same, n, lists(cut, np.bincount(cut_of, minlength=len(texts))), lists(*prefixes(found, text_of, n, sent.value, similarity))])

    text = as_bytes(F.col(text_col))
    return map_arrow(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")), run, SKETCH)


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component_id, stays) for each row: documents connected by pairs whose sets of word shingles have at least this Jaccard similarity.

    Two rounds, all candidates verified on their whole texts. The first links what is cheap to find: the grid join of
    fingerprints within 3 bits, and of the documents with a passage each with its neighbours in size and with the first.
    The second is exact: of two documents this similar, each has a shingle of the other among its rarest ones
    (`prefixes`), so all documents that share one there are candidates, unless the first round has connected them or size
    and place of the shingle rule the similarity out.

    Rows with the same words are one node from the start; texts without words, null ones too, are all the same. key is
    the XXH64 of a row's text. component_id is the least doc_id of the rows connected, null where none has one. Rows
    without an id and rows that repeat take part like any other. stays marks the row of least doc_id (null last), then
    least key, in a component; rows that repeat with id and text are marked alike. An empty table gives no rows.
    """
    wide = written(sketches(docs, id_col, text_col, words, similarity))
    rows = checkpoint(wide.drop("passages", "prefix"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    by_rid = lambda c: F.min_by(c, "rid").alias(c)
    nodes = checkpoint(rows.groupBy("fp", "same", "n").agg(F.min("rid").alias("node"), by_rid("doc_id"), by_rid("key"), first))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(as_bytes(F.col(text_col))).alias("key"), as_bytes(F.col(text_col)).alias("text"))
    links = None

    def connect(pairs: DataFrame) -> DataFrame:
        """Roots once the similar ones of the pairs are linked, too."""
        nonlocal links
        found = checkpoint(_verified(pairs, nodes, texts, words, similarity))
        links = found if links is None else links.unionByName(found)
        release(docs.sparkSession)
        return components(links)

    roots = connect(_likely_pairs(wide, nodes, similarity))
    shared = _shared_rarest(wide, nodes, roots)
    discard(wide)
    central = _central_pairs(shared, similarity)
    if not central.isEmpty():
        roots = connect(central)
    roots = connect(_prefix_pairs(shared, roots, similarity))
    discard(shared)
    placed = nodes.join(roots, "node")
    of_root = checkpoint(placed.groupBy("root").agg(F.min("first").alias("_first")))
    grouped = nodes.join(placed.join(of_root, "root").select("node", "_first"), "node", "left").select("fp", "same", "n", F.coalesce("_first", "first").alias("first"))
    out = rows.join(grouped, ["fp", "same", "n"])
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    return out.select("doc_id", "key", F.col("first.doc_id").alias("component_id"), stays.alias("stays"))


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of similar_documents(): that of least doc_id (null last), then least key of the text.

    Of rows that repeat with id and text the one of least hash over all columns stays. Columns keep their names, whatever they are.
    """
    found = similar_documents(docs, words, similarity, id_col, text_col).filter("stays")
    kept = checkpoint(found.groupBy("doc_id", "key").agg(F.count("*").alias("copies")))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(as_bytes(F.col(text_col))).alias("_key"))
    out = packed.join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    if not kept.filter("copies > 1").isEmpty():
        hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        repeated = out.filter("copies > 1").groupBy("_id", "_key").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in hashed])).alias("row"))
        out = out.filter("copies = 1").select("row").unionByName(repeated.select("row"))
    return out.select("row.*")


def _likely_pairs(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that are cheap to find and probably similar."""
    # Fingerprints within the grid's reach, by the first node of each.
    prints = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("node")).withColumn("code", embedding(F.col("fp"))))
    near = links_within(prints, LIKELY_BITS).unionByName(nodes.join(prints.select("fp", F.col("node").alias("a")), "fp").filter("node <> a").select("a", F.col("node").alias("b")))
    # Passages that several nodes have: each node with the first, and where there are more than two, in parts of bounded size, with the next in size.
    each = nodes.select("node").join(rows.select(F.col("rid").alias("node"), "passages", "n"), "node").select("node", "n", F.explode("passages").alias("p"))
    shared = checkpoint(each.groupBy("p").agg(F.count("*").alias("rows"), F.min("node").alias("a")).filter("rows > 1"))
    held = each.join(shared, "p")
    with_first = held.filter("node <> a").select("a", F.col("node").alias("b"))
    in_order = Window.partitionBy("p", "_part").orderBy("n", "node")
    beside = held.filter("rows > 2").withColumn("_part", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / ORDERED_ROWS)))
    beside = beside.select("node", F.array(*[F.lead("node", k).over(in_order) for k in range(1, NEIGHBOURS + 1)]).alias("others"))
    beside = beside.select("node", F.explode("others").alias("o")).filter("o is not null").select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))
    pairs = near.unionByName(with_first).unionByName(beside).distinct()
    of = nodes.select("node", "fp", "n")
    known = pairs.join(of.toDF("a", "a_fp", "a_n"), "a").join(of.toDF("b", "b_fp", "b_n"), "b")
    # Repeats move a fingerprint but not the set of shingles, so far ones may be similar: they are left to the second round.
    likely = known.filter((distance(embedding(F.col("a_fp")), embedding(F.col("b_fp"))) <= FAR_BITS) & (distance(F.col("a_fp"), F.col("b_fp")) <= FAR_BITS))
    return checkpoint(likely.filter(F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - SLACK).select("a", "b"))


def _with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _shared_rarest(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, n, at, p): the rarest shingles of nodes, each with its place, where nodes of different roots share one."""
    held = written(rows.select(F.col("rid").alias("node"), "n", "prefix").join(_with_roots(nodes.filter("n > 0").select("node"), roots), "node"))
    each = held.select("node", "root", "n", F.posexplode("prefix").alias("at", "p"))
    keys = each.groupBy("p").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    keys = checkpoint(keys.select("p"))
    release(rows.sparkSession)
    shared = written(each.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "p"))
    discard(held)
    release(rows.sparkSession)
    return shared


def _possible(s, l, similarity: float) -> Column:  # noqa: E741
    """Whether sizes, and places of a shared shingle, leave room for the similarity if it is the first that they share: then they share at most what is left from there on."""
    room = F.least(s("n") - s("at"), l("n") - l("at")) >= similarity / (1 + similarity) * (s("n") + l("n")) - SLACK
    return room & (F.least(s("n"), l("n")) >= similarity * F.greatest(s("n"), l("n")) - SLACK)


def _central_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that share a shingle of many and the node where it comes first: copies of a text have own shingles before, the text hasn't.

    So large groups of copies are one root before all pairs are looked at.
    """
    hub = F.min(F.struct("at", "n", "node", "root")).alias("hub")
    hubs = checkpoint(shared.groupBy("p").agg(F.count("*").alias("rows"), hub).filter(F.col("rows") > HUB_ROWS).select(F.col("p").alias("_p"), "hub.*"))
    s, l = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"l.{c}"))  # noqa: E731, E741
    met = hubs.alias("s").join(shared.alias("l"), (s("_p") == l("p")) & (s("root") != l("root")) & _possible(s, l, similarity))
    return checkpoint(met.select(F.least(s("node"), l("node")).alias("a"), F.greatest(s("node"), l("node")).alias("b")).distinct())


def _prefix_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that share a shingle of their prefixes, where it can be their first shared one.

    Of two prefixes the shorter text's may be cut at what a partner of its own size leaves. A shingle whose documents
    all have one root needs no pair; rows of a frequent one are dealt out to parts, and the shorter texts go to each part.
    """
    each = _with_roots(shared.drop("root"), roots)
    keys = each.groupBy("p").agg(F.count("*").alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    keys = checkpoint(keys.select("p", F.ceil(F.col("rows") / ORDERED_ROWS).alias("parts")))
    each = checkpoint(each.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "p"))
    share = 2 * similarity / (1 + similarity)
    short = each.filter(F.col("n") - F.col("at") >= share * F.col("n") - SLACK).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).alias("s")
    long = each.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("l")
    s, l = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"l.{c}"))  # noqa: E731, E741
    ordered = (s("n") < l("n")) | ((s("n") == l("n")) & (s("node") < l("node")))
    met = short.join(long, (s("p") == l("p")) & (s("part") == l("part")) & (s("root") != l("root")) & ordered & _possible(s, l, similarity))
    return checkpoint(met.select(F.least(s("node"), l("node")).alias("a"), F.greatest(s("node"), l("node")).alias("b")).distinct())


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """A forest, by batches, of the pairs (a, b) whose texts (doc_id, key, text) are similar enough."""
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "key"), "node"))
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    wanted = texts.join(small, (texts["key"] == small["key"]) & texts["doc_id"].eqNullSafe(small["doc_id"]))
    wanted = wanted.groupBy("node").agg(F.first("text").alias("text"))  # rows that repeat with id and text
    both = pairs.join(wanted.toDF("a", "a_text"), "a").join(wanted.toDF("b", "b_text"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            ids, at = np.unique(np.append(a, b), return_index=True)
            sets: list[np.ndarray] = []
            for group in groups_of([(x.column(2)[k] if k < len(a) else x.column(3)[k - len(a)]).as_py() for k in at.tolist()]):
                found, text_of = distinct_shingles(Runs(group), words)
                sets += np.split(found, np.cumsum(np.bincount(text_of, minlength=len(group)))[:-1])
            near = np.zeros(len(a), bool)
            for k, (s, t) in enumerate(zip(np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist(), strict=True)):
                both = len(np.intersect1d(sets[s], sets[t], assume_unique=True))
                near[k] = both >= similarity * (len(sets[s]) + len(sets[t]) - both) - SLACK
            yield forest_of(a[near].tolist(), b[near].tolist())

    return map_arrow(both.select("a", "b", "a_text", "b_text"), run, "a bigint, b bigint")
