"""Exact deduplication by skew-safe combining.

Each map task first combines its own equal rows (the partial aggregate), then a salted shuffle combines the rows of one
digest in up to `salts` tasks, then the few salt winners meet under the digest alone. Every stage groups by the whole
normalised text beside the digest, so equal digests of different texts never merge.

Only native expressions. The salt is the number of the input partition: one task gives one row for each text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
#: A rank holds the length above and the reversed id below this power; ids are 64-bit.
ID_ROOM = "100000000000000000000"
LARGEST_ID = "9223372036854775807"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """A number that is largest for the longest text, then for the smallest id; rows without an id come last."""
    wide = lambda c: c.cast("decimal(38,0)")
    place = F.coalesce(wide(F.lit(LARGEST_ID)) - wide(doc_id) + F.lit(1), wide(F.lit(0)))
    return (wide(n_chars) * wide(F.lit(ID_ROOM)) + place).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    place = rank % F.lit(ID_ROOM).cast("decimal(38,0)")
    return F.when(place > 0, (F.lit(LARGEST_ID).cast("decimal(38,0)") - place + F.lit(1)).cast("bigint"))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """One row for each (digest, text): best rank and number of rows."""
    salted = rows.groupBy((F.spark_partition_id() % salts).alias("_salt"), "_digest", "_norm").agg(F.max("_rank").alias("_rank"), F.sum("_rows").alias("_rows"))
    return salted.groupBy("_digest", "_norm").agg(F.max("_rank").alias("_rank"), F.sum("_rows").alias("_rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Each row with the row that stands for its group of equal texts.

    Texts are equal when identical without white space; null counts as empty, and all empty texts are one group. The
    longest original stays, then the smallest id; rows without an id lose every tie and get a null keep_id if no other
    row is in the group. Rows that repeat the id and text of the row that stays are reported alike. Other columns of
    `docs` are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("_n"), F.regexp_replace(text, WHITE_SPACE, "").alias("_norm"))
    rows = rows.withColumns({"_digest": digest(F.col("_norm")), "_rank": _rank(F.col("_n"), F.col("doc_id")), "_rows": F.lit(1).cast("bigint")})
    groups = _combined(rows, salts)
    by_digest = checkpoint(groups.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("_rank").alias("_best"), F.sum("_rows").alias("_size")))
    members = rows.select("doc_id", "_digest", "_rank")
    out = members.join(by_digest.filter("_texts = 1").drop("_texts"), "_digest")
    clashing = by_digest.filter("_texts > 1").select("_digest")
    if not clashing.isEmpty():  # different texts under one digest: these are joined by the text itself
        clash = rows.join(clashing, "_digest", "left_semi")
        best = _combined(clash, salts).withColumnsRenamed({"_rank": "_best", "_rows": "_size"})
        out = out.unionByName(clash.join(best, ["_digest", "_norm"]).select("_digest", "doc_id", "_rank", "_best", "_size"))
    return out.select("doc_id", _ranked_id(F.col("_best")).alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_rank") == F.col("_best")).alias("kept"), F.col("_digest").alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
