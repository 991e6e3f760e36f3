"""Page layout: words outside tables, lines and paragraphs of words, grids of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_paragraph_start, reflow_cell, strip

MARGIN, LINE_HEIGHT, WORD_GAP, INDENT, LINE_JUMP = 5.0, 10.0, 0.05, 40.0, 250.0
#: Boxes up to which they are sent to every task.
BROADCAST_BOXES = 200_000


def boxes_meet(a: str, b: str, margin: float = MARGIN) -> Column:
    """Whether two boxes (x0, x1, top, bottom), both shrunk by the margin, have a point in common."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = (c(a, "x1") - margin < c(b, "x0") + margin) | (c(b, "x1") - margin < c(a, "x0") + margin) | (c(a, "bottom") - margin < c(b, "top") + margin) | (c(b, "bottom") - margin < c(a, "top") + margin)
    return ~apart


def words_outside_tables(words: DataFrame, boxes: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Words that meet no table box of their page. Boxes are broadcast only if they are few."""
    few = boxes.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES
    w, b = words.alias("w"), (F.broadcast(boxes) if few else boxes).alias("b")
    return w.join(b, (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.page") == F.col("b.page")) & boxes_meet("w", "b", margin), "left_anti")


def words_to_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x0, jump, first): words whose height barely changes are one line."""
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("word_idx")
    height = F.col("top") + F.col("bottom")
    before = F.lag(F.struct("x1", height.alias("h"))).over(order)
    last = F.last("x1").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = words.withColumns({"_before": before, "_last": last})
    w = w.withColumn("_new", F.col("_before").isNotNull() & (F.abs(height - F.col("_before.h")) >= LINE_HEIGHT))
    w = w.withColumn("line", F.sum(F.col("_new").cast("int")).over(order))
    # The first word of a page is compared with the last.
    gap = F.abs(F.col("x0") - F.coalesce(F.col("_before.x1"), F.col("_last"))) > WORD_GAP
    piece = F.when(~F.col("_new") & gap, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    pieces = F.sort_array(F.collect_list(F.struct("word_idx", piece.alias("p"), "x0", F.col("_before.x1").alias("prev"), "text")))
    lines = w.groupBy("doc_id", "page", "line").agg(pieces.alias("_p"))
    head = F.col("_p")[0]
    return lines.select("doc_id", "page", "line", F.array_join(F.transform("_p", lambda x: x["p"]), "").alias("text"), head["x0"].alias("x0"), F.abs(head["x0"] - head["prev"]).alias("jump"), head["text"].alias("first"))


def words_to_paragraphs(words: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, page, paragraph, text): lines joined until an indent, a short way back or a paragraph's sign.

    `compat` also gives the open paragraph without the page's last line, before the whole one.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    lines = words_to_lines(words).withColumns({"_x": F.lag("x0").over(order), "_text": F.lag("text").over(order), "_next": F.lead("first").over(order)})
    space = F.col("_next").isNotNull() & F.col("text").rlike("[A-Za-z]$") & ~F.startswith(F.col("_next"), F.lit("\\"))
    lines = lines.withColumn("whole", F.when(space, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    lines = lines.withColumn("_whole", F.lag("whole").over(order))
    begins = F.col("_x").isNotNull() & ((F.abs(F.col("x0") - F.col("_x")) > INDENT) | (F.col("jump") < LINE_JUMP) | is_paragraph_start(F.col("_whole"), F.col("first")))
    lines = lines.withColumn("paragraph", F.sum(F.coalesce(begins.cast("int"), F.lit(0))).over(order))
    parts = F.sort_array(F.collect_list(F.struct("line", "whole")))
    out = lines.groupBy("doc_id", "page", "paragraph").agg(parts.alias("_l"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["whole"]), "")
    whole = out.select("doc_id", "page", "paragraph", text(F.col("_l")).alias("text"))
    if not compat:
        return whole
    final = Window.partitionBy("doc_id", "page")
    tails = out.withColumn("_last", F.max("paragraph").over(final)).filter((F.col("paragraph") == F.col("_last")) & (F.size("_l") > 1))
    return whole.unionByName(tails.select("doc_id", "page", "paragraph", text(F.slice("_l", 1, F.size("_l") - 1)).alias("text")))


def table_to_records(cells: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, table_idx, columns, data) of cells (doc_id, table_idx, row_idx, col_idx, cell).

    The first row is the header and goes; columns are numbered up to the width of the first row of data; cells are
    joined over their lines and stripped, null is ''; empty rows go. Tables of one row give nothing.
    """
    grid = cells.groupBy("doc_id", "table_idx", "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", F.coalesce("cell", F.lit("")).alias("c")))), lambda x: x["c"]).alias("row"))
    rows = grid.groupBy("doc_id", "table_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "row"))), lambda x: x["row"]).alias("rows")).filter(F.size("rows") > 1)
    body = F.slice("rows", 2, F.size("rows") - 1)
    width = F.size(body[0])
    names = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("column "), i.cast("string")))
    cleaned = F.transform(body, lambda r: F.transform(F.slice(r, 1, width), lambda c: strip(reflow_cell(c, strict))))
    filled = F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))
    data = F.transform(filled, lambda r: F.map_from_arrays(F.slice(names, 1, F.size(r)), r))
    out = rows.select("doc_id", "table_idx", names.alias("columns"), data.alias("data"), F.exists(F.flatten(cleaned), lambda c: c.isNull()).alias("_bad"))
    return out.filter(~F.coalesce("_bad", F.lit(False))).drop("_bad")


def compact_rows(rows: Column) -> Column:
    """JSON of an office table (array of rows): blank cells go first, the others are numbered; empty rows go; no rows give null."""
    full = F.transform(rows, lambda r: F.filter(F.transform(r, strip), lambda c: c != ""))
    some = F.filter(full, lambda r: F.size(r) > 0)
    numbered = F.transform(some, lambda r: F.map_from_entries(F.transform(r, lambda c, i: F.struct(F.concat(F.lit("column "), (i + 1).cast("string")), c))))
    return F.when(F.size(some) > 0, F.to_json(numbered))
