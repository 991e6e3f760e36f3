"""Markdown renditions as blocks and outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions.text import is_noise, strip

BODY = 99
HEADING = r"^(#+)\s+"


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_idx, kind, level, content, header_text) of (doc_id, text), in document order.

    Lines are stripped; blank and noise lines go, inside tables too. A table runs from a line with '<table>' to one with
    '</table>'; one that isn't closed goes. A caption right in front of a table merges into it and is its header text; as
    the merged block begins with the caption, tables that directly follow merge on.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", strip(F.col("line")))
    lines = lines.filter((F.col("line") != "") & ~is_noise(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("at")
    opens, closes = F.col("line").contains("<table>"), F.col("line").contains("</table>")
    # The last mark before a line tells whether it lies inside a table; a line that opens and closes leaves it closed.
    event = F.when(closes, False).when(opens, True)
    lines = lines.withColumn("_mark", event).withColumn("_in", F.coalesce(F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    lines = lines.withColumn("_table", F.col("_in") | opens)
    begins = ~F.col("_in")
    lines = lines.withColumn("_block", F.sum(begins.cast("int")).over(order))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    blocks = lines.groupBy("doc_id", "_block").agg(F.array_join(parts, "\n").alias("content"), F.max("_table").alias("_table"), F.max(F.struct("at", closes.alias("c")))["c"].alias("_closed"))
    blocks = blocks.filter(~F.col("_table") | F.col("_closed"))
    kind = F.when(F.col("_table"), "table").when(F.col("content").rlike(HEADING), "heading").otherwise("body")
    blocks = blocks.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("content", HEADING, 1))).otherwise(BODY))
    return _captioned(blocks)


def _captioned(blocks: DataFrame) -> DataFrame:
    """Merges each caption with the run of tables after it."""
    order = Window.partitionBy("doc_id").orderBy("_block")
    caption = (F.col("kind") == "body") & F.col("content").rlike(f"(?U){catalog.CAPTION_PATTERN}")
    leads = caption & (F.lead("kind").over(order) == "table")
    # A table belongs to the block in front if that block is a leading caption or itself belongs to one.
    blocks = blocks.withColumn("_leads", leads)
    start = F.when(F.col("kind") != "table", F.when(F.col("_leads"), F.col("_block")).otherwise(F.lit(-1)))
    blocks = blocks.withColumn("_run", F.last(start, ignorenulls=True).over(order))
    group = F.when((F.col("_run") >= 0) & ((F.col("kind") == "table") | F.col("_leads")), F.col("_run")).otherwise(F.col("_block"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "content", "kind")))
    merged = blocks.withColumn("_group", group).groupBy("doc_id", "_group").agg(parts.alias("_p"), F.min("level").alias("level"))
    texts = F.transform("_p", lambda x: x["content"])
    n = F.size("_p")
    header = F.when(n > 1, F.array_join(F.slice(texts, 1, n - 1), "\n")).otherwise("")
    kind = F.element_at("_p", -1)["kind"]
    out = merged.select("doc_id", kind.alias("kind"), "level", F.array_join(texts, "\n").alias("content"), header.alias("header_text"), "_group")
    return out.withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("_group")) - 1).drop("_group")


def markdown_outline(blocks: DataFrame, deepest: int = 6) -> DataFrame:
    """Adds parent_idx (null at the top) and subtree_length, the characters of a block and all below it.

    The parent is the nearest earlier heading of a lesser level. For each level the latest heading is carried along; one
    whose place is before a lesser heading's is closed.
    """
    before = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least("level", F.lit(deepest + 1))
    latest = [F.last(F.when(F.col("level") == k, F.col("block_idx")), ignorenulls=True).over(before) for k in range(1, deepest + 1)]
    b = blocks.withColumn("_at", F.array(*latest)).withColumn("_level", level)
    # Open headings: those of a lesser level that no later heading of an equal or lesser level has closed.
    open_at = F.filter(F.transform("_at", lambda x, i: F.when((i + 1 < F.col("_level")) & x.isNotNull() & ~F.exists(F.slice("_at", 1, F.greatest(i, F.lit(0))), lambda y: y > x), x)), lambda x: x.isNotNull())
    b = b.withColumn("_path", open_at).withColumn("parent_idx", F.array_max("_path"))
    own = b.select("doc_id", F.explode(F.concat("_path", F.array("block_idx"))).alias("block_idx"), F.length("content").alias("_n"))
    totals = own.groupBy("doc_id", "block_idx").agg(F.sum("_n").alias("subtree_length"))
    return b.drop("_at", "_path", "_level").join(totals, ["doc_id", "block_idx"])
