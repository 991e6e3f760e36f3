"""Chunkers against expectations worked out by hand, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import chunking as c
from auditloom.operators.markdown import markdown_blocks, markdown_outline


def test_windows(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, ""), (4, None)], "doc_id int, text string")
    got = {(r.doc_id, r.chunk_idx): r.chunk for r in c.chunk_sliding(docs, 4, 1).collect()}
    assert got == {(1, 0): "abcd", (1, 1): "defg", (1, 2): "ghij", (2, 0): "abc"}
    with pytest.raises(ValueError):
        c.sliding_windows(F.col("text"), 4, 4)


def test_windows_without_overlap_join_to_the_text(spark):
    texts = [(k, "é漢x" * k) for k in range(1, 30)]
    rows = c.chunk_sliding(spark.createDataFrame(texts, "doc_id int, text string"), 7, 0).orderBy("doc_id", "chunk_idx").collect()
    for k, text in texts:
        assert "".join(r.chunk for r in rows if r.doc_id == k) == text


def test_paragraphs_default_loses_nothing():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("ab。，；\n ") for _ in range(r.randint(0, 80)))
        chunks = c.pack_paragraphs(text, 10)
        assert "".join(chunks).replace("\n", "") == "".join(x.strip() for x in text.split("\n"))
        assert all(0 < len(x) <= 10 for x in chunks)


def test_paragraphs_compat_slips():
    assert c.pack_paragraphs("ab\ncd\nef", 20, compat=True) == ["abcd\nef\n"]
    assert c.pack_paragraphs("x" * 5, 5, compat=True) == []
    assert c.pack_paragraphs("ab\n" + "x" * 5, 5, compat=True) == ["ab", "x" * 5 + "\n"]
    assert c.pack_paragraphs("x" * 5, 5) == ["x" * 5]


def test_long_sentences():
    assert c.split_paragraph("aaaa,bbbb,cc。", 7) == ["aaaa,", "bbbb,", "cc。"]
    assert c.split_paragraph("abcdefghij", 4, compat=True) == ["abcd", "efgh", "ij", "ij"]
    assert c.split_paragraph("abcdefghij", 4) == ["abcd", "efgh", "ij"]


def test_blocks():
    assert c.pack_blocks([("aa", ""), ("bb", "")], 20) == [("aa\nbb", None)]
    assert c.pack_blocks([("a" * 12, ""), ("b" * 12, "")], 20) == [("a" * 12, None), ("b" * 12, None)]
    # A short buffer goes in front of what must be split, or takes a block that is slightly too long.
    assert c.pack_blocks([("h", ""), ("b" * 45, "")], 40)[0][0] == "h\n"
    assert c.pack_blocks([("h", ""), ("b" * 39, "")], 40) == [("h\n" + "b" * 39, None)]


def test_long_table():
    row = "<tr><td>%d</td></tr>"
    text = "表 1\n<table>" + "".join(row % k for k in range(6)) + "</table>"
    pieces = c.split_block(text, "表 1", 70)
    assert pieces[0][0].startswith("表 1\n<table>") and all(p.endswith("</table>") for p, _ in pieces)
    assert all(p.startswith("表 1 (续表)\n<table><tr><td>0</td></tr>") for p, _ in pieces[1:])
    assert [note for _, note in c.split_block("<table><tr>" + "x" * 50 + "</tr></table>", "", 30)] == [None, "hard_split", "hard_split", "hard_split", None]


def test_markdown(spark):
    text = "# A\nbody\n12\n表 1-1 x\n<table>\n<tr></tr>\n</table>\n<table></table>\n## B\n<table border=1>\n### C\nlast\n<table>\nopen"
    blocks = markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = [(r.kind, r.level, r.content, r.header_text) for r in blocks.orderBy("block_idx").collect()]
    first = "表 1-1 x\n<table>\n<tr></tr>\n</table>"
    assert got == [("heading", 1, "# A", ""), ("body", 99, "body", ""), ("table", 99, first + "\n<table></table>", first), ("heading", 2, "## B", ""), ("body", 99, "<table border=1>", ""), ("heading", 3, "### C", ""), ("body", 99, "last", "")]
    outline = {r.block_idx: (r.parent_idx, r.subtree_length) for r in markdown_outline(blocks).collect()}
    assert outline[0] == (None, sum(len(x[2]) for x in got)) and outline[3][0] == 0 and outline[5][0] == 3 and outline[6][0] == 5


def test_dispatch(spark):
    docs = spark.createDataFrame([(1, "a", "docx", "ours-adaptive", "plain"), (2, "b", "docx", "ours-adaptive", "plain"), (3, "c", "chm", "baseline-naive", "x" * 9000), (4, "d", "docx", "odd", "t")], "doc_id int, base_name string, suffix string, strategy string, text string")
    forms = spark.createDataFrame([("a", 2, "# late"), ("a", 1, "# first")], "base_name string, priority int, text string")
    got = sorted((r.doc_id, r.chunk_idx, r.strategy, r.length) for r in c.dispatch(docs, forms).collect())
    assert got == [(1, 0, "adaptive_markdown", 7), (2, 0, "baseline_fixed", 6), (3, 0, "baseline_naive", 8000), (3, 1, "baseline_naive", 1000)]
