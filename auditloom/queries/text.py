"""Sources, layout, text preparation, Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..folders import shared_folder
from ..functions import text as fx
from ..operators import layout, markdown
from ..sources import readers
from .base import Tables, query
from .inputs import DOCUMENTS, FINDINGS, MATERIALS, TASKS

SPACES = r"^[\s]+|[\s]+$"


def _folder(t: Tables) -> str:
    """A new folder where all executors see it."""
    return f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"


@query("route_files", f"WITH d AS ({DOCUMENTS}) SELECT doc_id, CASE WHEN file_name LIKE '%.xlsx' THEN 'sheets' WHEN file_name LIKE '%.pptx' THEN 'slides' WHEN file_name LIKE '%.tar' THEN NULL ELSE lower(split_part(file_name, '.', 2)) END AS reader, CASE WHEN file_name LIKE '%.tar' THEN 'cannot read .tar' END AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'a.tar' ELSE file_name END AS file_name FROM d)")
def _(t: Tables):
    files = t.sql(DOCUMENTS).withColumn("file_name", F.when(F.col("doc_id") % 9 == 0, "a.tar").otherwise(F.col("file_name")))
    return readers.route_files(files).select("doc_id", "reader", "reason")


#: Files of twenty documents each: Markdown, with CRLF, with bytes that are no UTF-8, of a suffix that another reader takes, and of an unknown one.
_FILE = "'f' || cast(doc_id // 20 AS string) || CASE (doc_id // 20) % 5 WHEN 3 THEN '.pdf' WHEN 4 THEN '.tar' ELSE '.md' END"


@query("read_documents", f"""WITH f AS (SELECT doc_id // 20 AS id, {_FILE} AS file_name, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM {{documents}} GROUP BY ALL)
SELECT file_name, CASE WHEN id % 5 < 2 THEN sha256(replace(text, chr(13) || chr(10), chr(10))) END AS sha, CASE id % 5 WHEN 2 THEN 'not UTF-8' WHEN 3 THEN 'needs extracted rows: pdf' WHEN 4 THEN 'cannot read .tar' END AS reason FROM f""")
def _(t: Tables):
    """Real files, written and read back whole, with those that can't be read."""
    kind, path = F.expr("(doc_id div 20) % 5"), _folder(t)
    named = t["documents"].select("doc_id", F.expr(_FILE.replace("//", "div")).alias("name"), kind.alias("kind"), "text")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    files = named.groupBy("name", "kind").agg(whole.alias("text"))
    raw = F.when(F.col("kind") == 1, F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")).when(F.col("kind") == 2, F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff\xfe"))).otherwise(F.encode("text", "UTF-8"))
    readers.write_files(files.select("name", raw.alias("content")), path)
    good, bad = readers.read_documents(t.spark, path)
    good = good.select("file_name", F.sha2("text", 256).alias("sha"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select("file_name", F.lit(None).cast("string").alias("sha"), "reason"))


@query("decode_html_blocks", "SELECT page_id // 20 AS doc_id, count(*) AS parts, sha256(string_agg(html, chr(10) ORDER BY path)) AS sha FROM (SELECT *, url || '#' || cast(page_id AS string) AS path FROM {pages}) GROUP BY page_id // 20")
def _(t: Tables):
    files = t["pages"].select(F.expr("page_id div 20").alias("doc_id"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return readers.decode_html_blocks(files).select("doc_id", "parts", F.sha2("text", 256).alias("sha"))


_CELLS = """
SELECT cast(floor(p_partkey / 200.0) AS bigint) AS doc_id, p_size % 3 AS sheet_idx, 0 AS col_idx, p_partkey AS row_idx, p_name AS value FROM {part}
UNION ALL SELECT cast(floor(p_partkey / 200.0) AS bigint), p_size % 3, 1, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END FROM {part}
UNION ALL SELECT cast(floor(p_partkey / 200.0) AS bigint), p_size % 3, 2, p_partkey, p_type FROM {part}"""


@query("assemble_sheet_text", f"WITH c AS ({_CELLS}) SELECT doc_id, coalesce(string_agg(value, chr(10) ORDER BY sheet_idx, col_idx, row_idx) FILTER (row_idx > 0 AND value IS NOT NULL), '') AS text, count(DISTINCT sheet_idx) AS sheets FROM c GROUP BY doc_id")
def _(t: Tables):
    return readers.assemble_sheet_text(t.sql(_CELLS)).select("doc_id", "text", "sheets")


_ITEMS = "SELECT conv_id AS doc_id, turn AS slide, 0 AS shape, turn AS pos, CASE WHEN turn % 3 = 2 THEN 'table' ELSE 'text' END AS kind, replace(replace(text, chr(10), ' '), '\"', '') AS text FROM {conversations}"
_SAID = "CASE WHEN kind = 'table' THEN '[{\"column 1\":\"' || text || '\",\"column 2\":\"x\"}]' ELSE trim(text) END"


def _items(t: Tables):
    return t.sql(_ITEMS).withColumn("rows", F.array(F.array("text", F.lit(" "), F.lit("x")), F.array(F.lit(""))))


@query("assemble_slide_text", f"WITH i AS ({_ITEMS}) SELECT doc_id, string_agg({_SAID}, chr(10) ORDER BY slide, shape, pos) AS text, count(*) AS parts FROM i GROUP BY doc_id")
def _(t: Tables):
    return readers.assemble_slide_text(_items(t))


@query("assemble_docx_text", f"WITH i AS ({_ITEMS}) SELECT doc_id, string_agg({_SAID}, chr(10) ORDER BY kind = 'table', pos) AS text, count(*) AS parts FROM i GROUP BY doc_id")
def _(t: Tables):
    return readers.assemble_docx_text(_items(t))


@query("load_sensitive_words", "SELECT p_brand AS word FROM {part} UNION SELECT cast(p_size AS string) FROM {part} WHERE p_size % 3 <> 0")
def _(t: Tables):
    sizes = t["part"].select(F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    return readers.load_sensitive_words(t["part"].select("p_brand"), sizes)


_BACK = f"WITH f AS ({FINDINGS}) SELECT finding_id, task_id, file_name, scan_item, sentence, suggestion FROM f"


@query("write_findings", _BACK)
def _(t: Tables):
    path = _folder(t)
    readers.write_findings(t.sql(FINDINGS).drop("value"), path)
    return readers.read_findings(t.spark, path).select("finding_id", "task_id", "file_name", "scan_item", "sentence", "suggestion")


@query("commit_findings", _BACK)
def _(t: Tables):
    """Three units of work, each tried twice."""
    path, rows = _folder(t), t.sql(FINDINGS).drop("value")
    for unit in range(3):
        for _ in range(2):
            readers.commit_findings(rows.filter(F.col("finding_id") % 3 == unit), path, f"unit-{unit}")
    return readers.read_committed(t.spark, path).select("finding_id", "task_id", "file_name", "scan_item", "sentence", "suggestion")


@query("read_findings_jsonl", f"WITH f AS ({FINDINGS}) SELECT scan_item, count(*) AS n, count(suggestion) AS suggestions FROM f GROUP BY scan_item")
def _(t: Tables):
    path = _folder(t)
    t.sql(FINDINGS).drop("value").write.json(path)
    return readers.read_findings(t.spark, path).groupBy("scan_item").agg(F.count("*").alias("n"), F.count("suggestion").alias("suggestions"))


@query("export_report_csv", f"WITH f AS ({FINDINGS}) SELECT file_name, problem_type, sentence, coalesce(suggestion, 'none') AS suggestion FROM f WHERE scan_item = 'scanItem6002'")
def _(t: Tables):
    path = _folder(t)
    rows = t.sql(FINDINGS).filter("scan_item = 'scanItem6002'").select(*readers.REPORT_NAMES)
    readers.export_report(rows, path)
    back = t.spark.read.csv(path, header=True, escape='"', schema="a string, b string, c string, d string").toDF(*readers.REPORT_NAMES)
    return back.withColumn("suggestion", F.coalesce("suggestion", F.lit("none")))


@query("load_task_tables", f"WITH t AS ({TASKS}), m AS ({MATERIALS}) SELECT status, count(DISTINCT t.task_id) AS tasks, count(file_name) AS materials FROM t LEFT JOIN m ON m.task_id = t.task_id GROUP BY status")
def _(t: Tables):
    joined = readers.load_task_tables(t.sql(TASKS), t.sql(MATERIALS))
    return joined.groupBy("status").agg(F.count_distinct("task_id").alias("tasks"), F.count("file_name").alias("materials"))


@query("document_summary", "SELECT documents.doc_id % 20 AS task_id, coalesce(documents.doc_id, -1) AS doc_id, cast(sum(length(text)) AS bigint) AS words, cast(sum(len(string_split(text, chr(10)))) AS bigint) AS parts FROM {documents} GROUP BY GROUPING SETS ((documents.doc_id % 20, documents.doc_id), (documents.doc_id % 20))")
def _(t: Tables):
    docs = t["documents"].select((F.col("doc_id") % 20).alias("task_id"), "doc_id", "text", F.size(F.split("text", "\n")).alias("parts"))
    return readers.document_summary(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


_WORDS_SQL = """
WITH raw AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents),
w AS (SELECT doc_id, i AS word_idx, ws[i + 1] AS text FROM raw, unnest(range(len(ws))) AS u(i)),
words AS (SELECT doc_id, word_idx // 400 AS page, word_idx, text, 50.0 + (word_idx % 10) * 45 + (CASE WHEN (word_idx // 10) % 7 = 0 THEN 60 ELSE 0 END) AS x0, 50.0 + (word_idx % 10) * 45 + (CASE WHEN (word_idx // 10) % 7 = 0 THEN 60 ELSE 0 END) + 4 * length(text) AS x1, 100.0 + ((word_idx // 10) % 40) * 12 AS top, 110.0 + ((word_idx // 10) % 40) * 12 AS bottom FROM w)"""


def _words(t: Tables):
    w = t["documents"].select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word_idx", "text"))
    row = F.expr("word_idx div 10")
    x0 = 50.0 + (F.col("word_idx") % 10) * 45 + F.when(row % 7 == 0, 60).otherwise(0)
    top = 100.0 + (row % 40) * 12
    return w.select("doc_id", F.expr("word_idx div 400").alias("page"), "word_idx", "text", x0.alias("x0"), (x0 + 4 * F.length("text")).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


@query("words_outside_tables", f"{_WORDS_SQL}, boxes AS (SELECT DISTINCT doc_id, page, 100.0 AS x0, 300.0 AS x1, 100.0 + (doc_id % 20) * 12 AS top, 160.0 + (doc_id % 20) * 12 AS bottom FROM words WHERE doc_id % 3 = 0) SELECT w.doc_id, w.page, count(*) AS n, cast(sum(w.word_idx) AS bigint) AS idx FROM words w WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = w.doc_id AND b.page = w.page AND NOT (w.x1 - 5 < b.x0 + 5 OR b.x1 - 5 < w.x0 + 5 OR w.bottom - 5 < b.top + 5 OR b.bottom - 5 < w.top + 5)) GROUP BY ALL")
def _(t: Tables):
    words = _words(t)
    top = 100.0 + (F.col("doc_id") % 20) * 12
    boxes = words.filter("doc_id % 3 = 0").select("doc_id", "page", F.lit(100.0).alias("x0"), F.lit(300.0).alias("x1"), top.alias("top"), (top + 60).alias("bottom")).distinct()
    left = layout.words_outside_tables(words, boxes)
    return left.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("word_idx").alias("idx"))


_STARTS = r"(regexp_matches({0}, '^(?:[•\-*→●]|步骤|[1-9][. )]|\d\.\d|[a-z]\.|表\s*\d)') OR regexp_matches({1}, '\.\s?\d+$'))"


@query("words_to_paragraphs", rf"""{_WORDS_SQL},
a AS (SELECT *, lag(x1) OVER o AS px, lag(top + bottom) OVER o AS ph, last_value(x1) OVER (PARTITION BY doc_id, page ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx FROM words WINDOW o AS (PARTITION BY doc_id, page ORDER BY word_idx)),
b AS (SELECT *, coalesce(abs(top + bottom - ph) >= 10, false) AS nl FROM a),
c AS (SELECT *, sum(nl::int) OVER (PARTITION BY doc_id, page ORDER BY word_idx) AS line FROM b),
l AS (SELECT doc_id, page, line, string_agg((CASE WHEN NOT nl AND abs(x0 - coalesce(px, lx)) > 0.05 THEN ' ' ELSE '' END) || text, '' ORDER BY word_idx) AS text, first(x0 ORDER BY word_idx) AS x0, abs(first(x0 ORDER BY word_idx) - first(px ORDER BY word_idx)) AS jump, first(text ORDER BY word_idx) AS head FROM c GROUP BY doc_id, page, line),
m AS (SELECT *, text || (CASE WHEN lead(head) OVER p IS NOT NULL AND regexp_matches(text, '[A-Za-z]$') AND NOT starts_with(lead(head) OVER p, chr(92)) THEN ' ' ELSE '' END) AS whole, lag(x0) OVER p AS lx0 FROM l WINDOW p AS (PARTITION BY doc_id, page ORDER BY line)),
n AS (SELECT *, lx0 IS NOT NULL AND (abs(x0 - lx0) > 40 OR jump < 250 OR {_STARTS.format('head', 'lag(whole) OVER p')}) AS begins FROM m WINDOW p AS (PARTITION BY doc_id, page ORDER BY line)),
q AS (SELECT *, sum(coalesce(begins, false)::int) OVER (PARTITION BY doc_id, page ORDER BY line) AS paragraph FROM n)
SELECT doc_id, page, cast(paragraph AS bigint) AS paragraph, sha256(string_agg(whole, '' ORDER BY line)) AS sha FROM q GROUP BY doc_id, page, paragraph""")
def _(t: Tables):
    out = layout.words_to_paragraphs(_words(t))
    return out.select("doc_id", "page", F.col("paragraph").cast("bigint").alias("paragraph"), F.sha2("text", 256).alias("sha"))


_LINES_SQL = "WITH l AS (SELECT doc_id, pos, list_extract(ls, cast(pos AS bigint) + 1) AS line, CASE WHEN pos > 0 THEN ls[pos] ELSE '' END AS before FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS u(pos))"


@query("is_paragraph_start", f"{_LINES_SQL} SELECT doc_id, count(*) AS lines, count(*) FILTER ({_STARTS.format('line', 'before')}) AS starts FROM l GROUP BY doc_id")
def _(t: Tables):
    lines = t["documents"].select("doc_id", F.explode(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.element_at(F.split("text", "\n"), i)).otherwise("").alias("before")))).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(fx.is_paragraph_start(F.col("x.before"), F.col("x.line"))).alias("starts"))


@query("clean_text_lines", "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 3), chr(10))) AS sha FROM {documents}")
def _(t: Tables):
    return t["documents"].select("doc_id", F.sha2(fx.clean_lines(F.col("text")), 256).alias("sha"))


@query("reflow_newlines", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([A-Za-z])( *)\n', '\1\2△', 'g'), '([^.?!。！？"''”》】」:;…~ \n])( *)\n', '\1\2', 'g')) AS sha FROM {documents}""")
def _(t: Tables):
    return t["documents"].select("doc_id", F.sha2(fx.reflow_newlines("text"), 256).alias("sha"))


_TWO = r"SELECT p_partkey, p_name || (CASE p_partkey % 6 WHEN 0 THEN ',' WHEN 1 THEN ' 5' WHEN 2 THEN ' run.l' WHEN 3 THEN ' a" + '"' + r"b' WHEN 4 THEN '：' ELSE '' END) AS a, (CASE p_partkey % 4 WHEN 0 THEN '2. ' WHEN 1 THEN '' WHEN 2 THEN 'og ' ELSE '7 ' END) || p_brand AS b FROM {part}"


@query("reflow_table_cell", rf"""WITH c AS ({_TWO}) SELECT p_partkey, CASE WHEN {_STARTS.format('b', 'a')} THEN a || chr(10) || b WHEN regexp_matches(a, '[,;:]$') THEN a || ' ' || b WHEN a LIKE '%"%' OR (a LIKE '%.l' AND b LIKE 'og %') THEN a || b WHEN regexp_matches(a, '[0-9]$') OR regexp_matches(b, '^[0-9]') THEN a || ' ' || b WHEN regexp_matches(a, '[A-Za-z]$') AND regexp_matches(b, '^[A-Za-z]') THEN a || '△' || b ELSE a || b END AS cell FROM c""")
def _(t: Tables):
    return t.sql(_TWO).select("p_partkey", fx.reflow_cell(F.concat("a", F.lit("\n"), "b")).alias("cell"))


_GRID = """
SELECT l_orderkey AS table_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_idx, l_returnflag AS c0, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS c1, CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE l_linestatus END AS c2
FROM {lineitem}"""


@query("table_to_records", f"WITH g AS ({_GRID}) SELECT table_idx, 3 AS n_columns, count(*) AS n_rows, '[' || string_agg('{{\"column 1\":\"' || c0 || '\",\"column 2\":\"' || coalesce(c1, '') || '\",\"column 3\":\"' || trim(c2) || '\"}}', ',' ORDER BY row_idx) || ']' AS data FROM g WHERE row_idx > 1 GROUP BY table_idx")
def _(t: Tables):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("col_idx"), F.col(f"c{k}").alias("cell")) for k in range(3)]))
    cells = t.sql(_GRID).select(F.lit(0).alias("doc_id"), "table_idx", "row_idx", each.alias("x")).select("doc_id", "table_idx", "row_idx", "x.col_idx", "x.cell")
    return layout.table_to_records(cells).select("table_idx", F.size("columns").alias("n_columns"), F.size("data").cast("bigint").alias("n_rows"), F.to_json("data").alias("data"))


@query("compact_table_json", "SELECT p_partkey, '[{\"column 1\":\"' || p_brand || '\"' || (CASE WHEN p_size % 2 = 0 THEN ',\"column 2\":\"' || p_type || '\"' ELSE '' END) || '}]' AS data FROM {part}")
def _(t: Tables):
    rows = F.array(F.array(F.lit(" "), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")), F.array(F.lit(""), F.lit("\t")))
    return t["part"].select("p_partkey", layout.compact_rows(rows).alias("data"))


_HEADS = "SELECT l_partkey AS k, CASE l_partkey % 6 WHEN 0 THEN 'Heading ' || cast(1 + l_linenumber % 5 AS string) ELSE '' END AS style, (CASE l_partkey % 5 WHEN 0 THEN '1.2 ' WHEN 1 THEN '3 ' WHEN 2 THEN '一、' WHEN 3 THEN '(二)' ELSE '' END) || l_returnflag AS text FROM {lineitem}"


@query("heading_level", rf"WITH h AS ({_HEADS}) SELECT style, text, cast(CASE WHEN style <> '' THEN cast(split_part(style, ' ', 2) AS integer) WHEN regexp_matches(text, '^\d+(\.\d+){{1,2}}\s') THEN 2 WHEN regexp_matches(text, '^\d+\s') THEN 1 WHEN text LIKE '一、%' THEN 1 WHEN text LIKE '(二)%' THEN 2 ELSE 99 END AS integer) AS level, count(*) AS n FROM h GROUP BY ALL")
def _(t: Tables):
    return t.sql(_HEADS).withColumn("level", fx.heading_level(F.col("style"), F.col("text"))).groupBy("style", "text", "level").agg(F.count("*").alias("n"))


_NOISY = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' 12 ' WHEN 1 THEN '文档版本 3' WHEN 2 THEN '发布日期 2024-01-02' WHEN 3 THEN '版权所有 © x' WHEN 4 THEN '非经本公司书面许可，' ELSE props END AS line FROM {events}"


@query("drop_noise_lines", f"WITH n AS ({_NOISY}) SELECT event_id, line FROM n WHERE event_id % 7 > 4")
def _(t: Tables):
    return t.sql(_NOISY).filter(~fx.is_noise(F.col("line")))


#: Conversations as Markdown: a heading, turns below, captions and tables.
MARKDOWN_LINES = """
SELECT conv_id AS doc_id, turn * 10 AS pos, (CASE WHEN turn % 2 = 0 THEN '# ' ELSE '## ' END) || role || cast(turn AS string) AS line FROM {conversations}
UNION ALL SELECT conv_id, turn * 10 + 1, text FROM {conversations}
UNION ALL SELECT conv_id, turn * 10 + 2, '表 1-' || cast(turn AS string) FROM {conversations} WHERE turn % 3 = 1
UNION ALL SELECT conv_id, turn * 10 + 3, '<table><tr><td>a</td></tr>' FROM {conversations} WHERE turn % 3 = 1
UNION ALL SELECT conv_id, turn * 10 + 4, '# <tr><td>' || role || '</td></tr></table>' FROM {conversations} WHERE turn % 3 = 1
UNION ALL SELECT conv_id, turn * 10 + 5, '<table><tr><td>b</td></tr></table>' FROM {conversations} WHERE turn % 3 = 1 AND conv_id % 2 = 0"""


def markdown_docs(t: Tables):
    return readers.in_order(["pos"], F.col("line"), ["doc_id"], t.sql(MARKDOWN_LINES)).select("doc_id", "text")


#: The same blocks from how the lines were made: bodies by line, a caption with all its tables as one block.
_BLOCKS_SQL = f"""
WITH ml AS ({MARKDOWN_LINES}), heads AS (SELECT doc_id, pos, 0 AS sub, 'heading' AS kind, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(line) AS content, '' AS header_text FROM ml WHERE pos % 10 = 0),
bodies AS (SELECT doc_id, pos, i AS sub, 'body' AS kind, 99 AS level, trim(ls[i + 1]) AS content, '' AS header_text FROM (SELECT doc_id, pos, string_split(line, chr(10)) AS ls FROM ml WHERE pos % 10 = 1), unnest(range(len(ls))) AS u(i) WHERE trim(ls[i + 1]) <> ''),
tables AS (SELECT doc_id, min(pos) AS pos, 0 AS sub, 'table' AS kind, 99 AS level, string_agg(line, chr(10) ORDER BY pos) AS content, string_agg(line, chr(10) ORDER BY pos) FILTER (pos % 10 = 2 OR (doc_id % 2 = 0 AND pos % 10 < 5)) AS header_text FROM ml WHERE pos % 10 > 1 GROUP BY doc_id, pos // 10),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS block_idx, kind, level, content, header_text FROM (SELECT * FROM heads UNION ALL SELECT * FROM bodies UNION ALL SELECT * FROM tables))"""


@query("markdown_blocks", f"{_BLOCKS_SQL} SELECT doc_id, cast(block_idx AS integer) AS block_idx, kind, cast(level AS integer) AS level, content, header_text FROM blocks")
def _(t: Tables):
    return markdown.markdown_blocks(markdown_docs(t)).select("doc_id", F.col("block_idx").cast("int").alias("block_idx"), "kind", F.col("level").cast("int").alias("level"), "content", "header_text")


@query("markdown_outline", f"""{_BLOCKS_SQL}, up AS (SELECT b.doc_id, b.block_idx, b.content, (SELECT max(h.block_idx) FROM blocks h WHERE h.doc_id = b.doc_id AND h.kind = 'heading' AND h.block_idx < b.block_idx AND h.level < b.level AND NOT EXISTS (SELECT 1 FROM blocks k WHERE k.doc_id = b.doc_id AND k.kind = 'heading' AND k.block_idx > h.block_idx AND k.block_idx < b.block_idx AND k.level <= h.level)) AS parent_idx FROM blocks b)
SELECT u.doc_id, cast(u.block_idx AS integer) AS block_idx, cast(coalesce(u.parent_idx, -1) AS integer) AS parent_idx, cast(length(u.content) + coalesce((SELECT sum(length(c.content)) FROM up c LEFT JOIN up p ON p.doc_id = c.doc_id AND p.block_idx = c.parent_idx WHERE c.doc_id = u.doc_id AND (c.parent_idx = u.block_idx OR p.parent_idx = u.block_idx)), 0) AS bigint) AS subtree_length FROM up u""")
def _(t: Tables):
    out = markdown.markdown_outline(markdown.markdown_blocks(markdown_docs(t)))
    return out.select("doc_id", F.col("block_idx").cast("int").alias("block_idx"), F.coalesce("parent_idx", F.lit(-1)).cast("int").alias("parent_idx"), F.col("subtree_length").cast("bigint").alias("subtree_length"))
