"""Cutting documents into chunks: sliding windows, packed paragraphs, packed Markdown blocks.

Windows are a built-in expression. Packing is a fold over one document's pieces, so it runs in mapInPandas over whole
documents, without a shuffle and in small batches. The default keeps every character once; `compat` also reproduces
known slips of older chunkers, so that results can be compared with theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog

NAIVE, FIXED, ADAPTIVE = "baseline_naive", "baseline_fixed", "adaptive_markdown"
HARD_SPLIT = "hard_split"
# What ends a sentence, and where an overlong one may be cut.
SENTENCE = re.compile(r"[^。？！\n]*[。？！\n]|[^。？！\n]+")
SOFT_CUTS = "]，；,.;"
CONTINUED, TABLE_END = "(续表)", "</table>"
ROW = re.compile(r"<tr.*?>.*?</tr>", re.S)
#: A buffer under this share of a chunk is too short to stand alone.
SHORT_SHARE = 0.1


def sliding_windows(text: Column, size: int | Column = catalog.CHUNK_SIZE, overlap: int = catalog.OVERLAP) -> Column:
    """Array of windows; the last is the first that reaches the end. Null and empty texts have none. A size may be a column above the overlap."""
    if isinstance(size, int) and not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, size if isinstance(size, Column) else F.lit(size)))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def chunk_sliding(docs: DataFrame, size: int | Column = catalog.CHUNK_SIZE, overlap: int = catalog.OVERLAP) -> DataFrame:
    """Adds chunk_idx, chunk, length and strategy to (…, text); the text goes."""
    others = [c for c in docs.columns if c != "text"]
    out = docs.select(*others, F.posexplode(sliding_windows(F.col("text"), size, overlap)).alias("chunk_idx", "chunk"))
    return out.withColumns({"length": F.length("chunk"), "strategy": F.lit(NAIVE)})


def split_paragraph(text: str, size: int, compat: bool = False) -> list[str]:
    """Packs the sentences of a long paragraph. An overlong sentence is cut at its last comma or the like, else hard."""
    if len(text) <= size:
        return [text]
    out: list[str] = []
    held = ""
    for sentence in SENTENCE.findall(text):
        if len(held) + len(sentence) <= size and (compat or len(sentence) <= size):
            held += sentence
            continue
        if held:
            out.append(held)
        held = sentence
        if len(sentence) > size:
            pieces = list(_cut(sentence, size))
            out += pieces
            held = pieces[-1] if compat else ""
    return out + [held] * bool(held)


def _cut(sentence: str, size: int) -> Iterator[str]:
    begin = 0
    while begin < len(sentence):
        line_end = sentence.find("\n", begin, begin + size)  # a cut isn't looked for beyond a line break
        window = sentence[begin : line_end if line_end >= 0 else begin + size]
        soft = max(window.rfind(c) for c in SOFT_CUTS)
        end = begin + (soft + 1 if soft >= 0 else size)
        yield sentence[begin:end]
        begin = end


def pack_paragraphs(text: str, size: int, compat: bool = False, split_lines: bool = True) -> list[str]:
    """Packs stripped lines, each with a line break behind it, while they fit; long lines are split by sentences.

    Without `split_lines` a line that doesn't fit into a chunk with its line break is one of its own, whole.

    `compat`: the first line of a text's first chunk, and one after a split line, has no line break; a line of exactly
    `size` characters is lost where nothing is held.
    """
    out: list[str] = []
    held = ""
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(held) + len(line) + 1 <= size:
            held += line if compat and not held else line + "\n"
            continue
        if held:
            out.append(held)
        if not split_lines:
            held = line + "\n"
        elif len(line) > size:
            out += split_paragraph(line, size, compat)
            held = ""
        elif compat:
            held = line + "\n" if held else ""
        else:
            held = line + "\n" if len(line) < size else line
    return out + [held] * bool(held)


def _table_pieces(text: str, header: str, size: int) -> Iterator[tuple[str, str | None]]:
    """Pieces of a long table, each a table of its own: the first with what precedes the rows, later ones with the caption as continued and the first row."""
    rows = ROW.findall(text)
    tag = re.search(r"<table[^>]*>", text)
    caption = f"{header}\n" if CONTINUED in header else f"{header} {CONTINUED}\n" if header else ""
    again = caption + (tag[0] if tag else "<table>") + rows[0]
    limit = size - len(TABLE_END)
    held = text[: text.index(rows[0])]
    for row in rows:
        if len(row) > limit:
            if held:
                yield held + TABLE_END, None
            for k in range(0, len(row), limit):
                yield row[k : k + limit], HARD_SPLIT
            held = again
        else:
            if len(held) + len(row) > limit and held:
                yield held + TABLE_END, None
                held = again
            held += row
    if held:
        yield held + TABLE_END, None


def _text_pieces(text: str, size: int) -> Iterator[tuple[str, str | None]]:
    held = ""
    for sentence in SENTENCE.findall(text):
        if len(held) + len(sentence) > size:
            if held:
                yield held, None
            held = ""
            if len(sentence) > size:
                for k in range(0, len(sentence), size):
                    yield sentence[k : k + size], HARD_SPLIT
                continue
        held += sentence
    if held:
        yield held, None


def split_block(text: str, header: str = "", size: int = catalog.CHUNK_SIZE) -> list[tuple[str, str | None]]:
    """(piece, note) of a block: tables by rows, other text by sentences."""
    if len(text) <= size:
        return [(text, None)]
    if "<table>" in text and ROW.search(text):
        return list(_table_pieces(text, header or "", size))
    return list(_text_pieces(text, size))


def pack_blocks(blocks: list[tuple[str, str]], size: int) -> list[tuple[str, str | None]]:
    """Packs (content, header text) of a document's blocks in order. A short buffer goes in front of a block that must be split, or takes one more block."""
    out: list[tuple[str, str | None]] = []
    held: list[str] = []
    used = 0  # characters, and one for each block

    def flush() -> None:
        nonlocal used
        if held:
            out.append(("\n".join(held), None))
            held.clear()
            used = 0

    for content, header in blocks:
        short = used < size * SHORT_SHARE
        if used + len(content) > size and len(content) > size:
            if held and short:
                content = "\n".join([*held, content])
                held.clear()
                used = 0
            flush()
            out += split_block(content, header, size)
            continue
        if used + len(content) > size and not short:
            flush()
        held.append(content)
        used += len(content) + 1
    flush()
    return out


def _fold(docs: DataFrame, fn, strategy: str, columns: list[str]) -> DataFrame:
    """Runs fn over the given columns of each row; other columns stay, with chunk_idx, chunk, length, strategy and note."""
    others = [f for f in docs.schema.fields if f.name not in columns]
    names = [f.name for f in others]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "chunk_idx int, chunk string, length int, strategy string, note string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for kept, given in zip(f[names].itertuples(index=False, name=None), f[columns].itertuples(index=False, name=None), strict=True):
                rows += [(*kept, k, chunk, len(chunk), strategy, note) for k, (chunk, note) in enumerate(fn(*given))]
            yield pd.DataFrame(rows, columns=[*names, "chunk_idx", "chunk", "length", "strategy", "note"])

    return docs.select(*names, *columns).mapInPandas(run, schema)


def chunk_paragraphs(docs: DataFrame, size: int = catalog.CHUNK_SIZE, compat: bool = False, split_lines: bool = True) -> DataFrame:
    return _fold(docs, lambda text: [(c, None) for c in pack_paragraphs(text or "", size, compat, split_lines)], FIXED, ["text"])


def chunk_markdown(blocks: DataFrame, size: int = catalog.CHUNK_SIZE) -> DataFrame:
    """Chunks of markdown_blocks(), one fold for each document. A document's blocks meet in one row: no more than its text."""
    one = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", "content", "header_text"))).alias("blocks"))
    return _fold(one, lambda blocks: pack_blocks([(b["content"], b["header_text"]) for b in blocks], size), ADAPTIVE, ["blocks"])


def choose_strategy(strategy: Column, adaptive: Column) -> Column:
    """The strategy to run; adaptive chunking that is turned off means fixed. Unknown names are null."""
    known = strategy.isin("baseline-naive", "ours-fixed", "ours-adaptive")
    return F.when((strategy == "ours-adaptive") & ~F.coalesce(adaptive, F.lit(True)), "ours-fixed").when(known, strategy)


def dispatch(docs: DataFrame, renditions: DataFrame, size: int = catalog.CHUNK_SIZE, archive_size: int = catalog.ARCHIVE_CHUNK_SIZE, compat: bool = False, split_lines: bool = True) -> DataFrame:
    """(doc_id, chunk_idx, chunk, length, strategy, note) of (doc_id, base_name, suffix, strategy, text) under each document's strategy.

    `renditions` (base_name, priority, text) are Markdown forms; the least priority wins, then the first text, and those
    without a priority come last. Adaptive documents without one are packed by paragraphs, whose long lines stay whole without `split_lines`. Archives have larger chunks.
    Rows of unknown strategy give nothing. Rows without a doc_id, and rows that share one, are documents of their own.
    """
    from .markdown import markdown_blocks

    best = renditions.groupBy("base_name").agg(F.min(F.struct(F.col("priority").isNull(), "priority", "text"))["text"].alias("_markdown"))
    sized = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "base_name", "strategy", "text", F.when(F.coalesce(F.col("suffix") == "chm", F.lit(False)), archive_size).otherwise(size).alias("_size"))
    naive = sized.filter(F.col("strategy") == "baseline-naive").select("doc_id", "text", "_size")
    naive = chunk_sliding(naive, F.col("_size")).withColumn("note", F.lit(None).cast("string"))
    rest = sized.filter(F.col("strategy").isin("ours-fixed", "ours-adaptive")).join(best, "base_name", "left")
    adaptive = (F.col("strategy") == "ours-adaptive") & F.col("_markdown").isNotNull()
    fixed = _fold(rest.filter(~adaptive).select("doc_id", "text", "_size"), lambda text, n: [(c, None) for c in pack_paragraphs(text or "", n, compat, split_lines)], FIXED, ["text", "_size"])
    each = F.struct("_row", "doc_id", "_size").alias("doc_id")  # a row's blocks stay together, and take along what packing needs
    blocks = markdown_blocks(rest.filter(adaptive).select(each, F.col("_markdown").alias("text")))
    one = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", "content", "header_text"))).alias("blocks")).select("doc_id.doc_id", "doc_id._size", "blocks")
    packed = _fold(one, lambda blocks, n: pack_blocks([(b["content"], b["header_text"]) for b in blocks], n), ADAPTIVE, ["blocks", "_size"])
    parts = [x.select("doc_id", "chunk_idx", "chunk", "length", "strategy", "note") for x in (naive, fixed, packed)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, strategy, length, total_chunks), without the naive strategy, which keeps none."""
    kept = chunks.filter(F.col("strategy") != NAIVE).select("doc_id", "chunk_idx", F.when(F.col("strategy") == FIXED, "ours_fixed").otherwise(F.col("strategy")).alias("strategy"), "length")
    return kept.withColumn("total_chunks", F.count("*").over(Window.partitionBy("doc_id")))
