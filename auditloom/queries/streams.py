"""Streams over the given tables; each runs over all that is there and gives what a batch would."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..folders import shared_folder
from ..operators import fanout
from ..streaming import audit
from .base import Tables, query
from .chunking import windows_sql
from .detection import WORDS
from .inputs import DOCUMENTS


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("stream_audit", f"WITH d AS ({DOCUMENTS}), w AS ({WORDS}), c AS ({windows_sql(2000, 0)}) SELECT d.doc_id, chunk_idx, word FROM c JOIN d ON c.doc_id = d.doc_id JOIN w ON contains(chunk, word) WHERE items LIKE '%scanItem99999%'")
def _(t: Tables):
    folder = _folder(t)
    given = audit.read_documents(t.spark, f"{t.sf_dir}/documents.parque*", t["documents"].schema)
    docs = t.spark.sql(DOCUMENTS, documents=given).withColumns({"task_id": F.col("doc_id") % 7, "scan_items": fanout.parse_scan_items(F.col("items"))}).drop("items")
    audit.stream_audit(docs, t.sql(WORDS), f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").select("doc_id", "chunk_idx", "word")


@query("stream_progress", "SELECT user_id AS task_id, count(*) AS complete, cast(trunc(count(*) / 200 * 100) AS integer) AS progress FROM {events} WHERE event_type = 'purchase' GROUP BY user_id")
def _(t: Tables):
    """Completions some of which are told twice."""
    folder = _folder(t)
    done = audit.read_documents(t.spark, f"{t.sf_dir}/events.parque*", t["events"].schema).filter("event_type = 'purchase'")
    told = F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    done = done.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("item_id"), told.alias("time"))
    totals = t["events"].select(F.col("user_id").alias("task_id")).distinct().withColumn("total", F.lit(200))
    audit.stream_progress(done, totals, f"{folder}/out", f"{folder}/checkpoint")
    return audit.read_progress(t.spark, f"{folder}/out")
