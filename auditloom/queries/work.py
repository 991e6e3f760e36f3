"""Fan-out of documents over checks, and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import fanout
from .base import Tables, query
from .inputs import DOCUMENTS, FINDINGS

NAMES = ", ".join(f"('{c}', '{n}', '{'skip' if r == catalog.SKIPPED else 'live'}')" for c, n, r in catalog.SCAN_ITEMS)
ITEMS_SQL = "CASE WHEN items IS NULL THEN ['default'] ELSE list_transform(string_split(items, ','), lambda x: trim(x)) END"
EACH = f"each_item AS (SELECT doc_id, file_name, unnest({ITEMS_SQL}) AS scan_item FROM documents_in)"
DOCS = f"WITH documents_in AS ({DOCUMENTS})"
CATALOG = f"catalog(code, name, live) AS (VALUES {NAMES})"


def _docs(t: Tables):
    return t.sql(DOCUMENTS).withColumn("scan_items", fanout.parse_scan_items(F.col("items")))


@query("parse_scan_items", f"{DOCS} SELECT doc_id, array_to_string({ITEMS_SQL}, '|') AS items, cast(len({ITEMS_SQL}) AS bigint) AS n FROM documents_in")
def _(t: Tables):
    return _docs(t).select("doc_id", F.array_join("scan_items", "|").alias("items"), F.size("scan_items").cast("bigint").alias("n"))


@query("detect_language", f"{DOCS} SELECT doc_id, file_name, CASE WHEN regexp_matches(file_name, '[一-鿿]') THEN 'chinese' ELSE 'english' END AS language FROM documents_in")
def _(t: Tables):
    return _docs(t).select("doc_id", "file_name", fanout.detect_language(F.col("file_name")).alias("language"))


@query("scan_items_by_language", f"{DOCS}, {EACH}, bad(language, code) AS (VALUES {', '.join(f"('{k}', '{c}')" for k, v in catalog.UNSUITED.items() for c in v)}) SELECT doc_id, language, scan_item FROM (SELECT *, CASE WHEN file_name LIKE '文%' THEN 'chinese' ELSE 'english' END AS language FROM each_item) e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.language = e.language AND bad.code = e.scan_item)")
def _(t: Tables):
    each = _docs(t).select("doc_id", fanout.detect_language(F.col("file_name")).alias("language"), F.explode("scan_items").alias("scan_item"))
    return fanout.items_for_language(each).select("doc_id", "language", "scan_item")


@query("classify_file_type", f"{DOCS}, types(suffix, label) AS (VALUES {', '.join(str(x) for x in catalog.FILE_TYPES)}) SELECT doc_id, lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) AS suffix, label AS file_type, label IS NULL AS rejected FROM documents_in LEFT JOIN types ON types.suffix = lower(regexp_extract(file_name, '\\.([^.]*)$', 1))")
def _(t: Tables):
    known, unknown = fanout.classify_file_type(_docs(t))
    rejected = unknown.select("doc_id", "suffix", F.lit(None).cast("string").alias("file_type"), F.lit(True).alias("rejected"))
    return known.select("doc_id", "suffix", "file_type", F.lit(False).alias("rejected")).unionByName(rejected)


@query("fan_out_scan_items", f"{DOCS}, {EACH}, {CATALOG} SELECT doc_id, scan_item, name AS scan_item_name, code IS NULL AS rejected FROM each_item LEFT JOIN catalog ON code = scan_item")
def _(t: Tables):
    work, rejects = fanout.fan_out(_docs(t).select("doc_id", "scan_items"))
    return work.select("doc_id", "scan_item", "scan_item_name", F.lit(False).alias("rejected")).unionByName(rejects.select("doc_id", "scan_item", F.lit(None).cast("string").alias("scan_item_name"), F.lit(True).alias("rejected")))


@query("scan_item_catalog", f"WITH f AS ({FINDINGS}), {CATALOG} SELECT name AS scan_item_name, code, count(*) AS findings FROM f JOIN catalog ON code = scan_item GROUP BY ALL")
def _(t: Tables):
    named = t.sql(FINDINGS).join(F.broadcast(catalog.scan_items(t.spark).select(F.col("code").alias("scan_item"), F.col("name").alias("scan_item_name"))), "scan_item")
    return fanout.with_codes(named).groupBy("scan_item_name", "code").agg(F.count("*").alias("findings"))


@query("drop_skipped_items", f"{DOCS}, {EACH}, {CATALOG} SELECT doc_id, scan_item FROM each_item WHERE scan_item IN (SELECT code FROM catalog WHERE live = 'live')")
def _(t: Tables):
    each = _docs(t).select("doc_id", F.explode("scan_items").alias("scan_item"))
    return fanout.drop_skipped(each).select("doc_id", "scan_item")


@query("route_work", f"WITH f AS ({FINDINGS}) SELECT finding_id, CASE WHEN file_name LIKE '%1.md' THEN 'model-b' ELSE 'model-a' END AS model, CASE WHEN strategy = 'adaptive_markdown' THEN 'markdown' ELSE 'extraction' END AS instruction FROM f")
def _(t: Tables):
    models = t.spark.createDataFrame([("english", "model-a"), ("chinese", "model-b")], "language string, model string")
    work = t.sql(FINDINGS).withColumn("language", fanout.detect_language(F.when(F.col("file_name").endswith("1.md"), "名.md").otherwise(F.col("file_name"))))
    return fanout.route(work, models).select("finding_id", "model", "instruction")


@query("dedupe_uploads", "SELECT source AS file_name, n_chars AS size, min(doc_id) AS doc_id FROM {documents} GROUP BY source, n_chars")
def _(t: Tables):
    files = t["documents"].select(F.col("source").alias("file_name"), F.col("n_chars").alias("size"), "doc_id")
    return fanout.dedupe_uploads(files, arrival="doc_id")
