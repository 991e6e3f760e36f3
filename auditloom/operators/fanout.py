"""From chunks to work items: parsing, filtering and joining with the catalogue of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog


def parse_scan_items(text: Column) -> Column:
    """Codes of a comma-separated text; null means the default check. Outer spaces go."""
    return F.when(text.isNull(), F.array(F.lit(catalog.DEFAULT_NAME[0]))).otherwise(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")))


def detect_language(name: Column) -> Column:
    """By the file's name: any CJK ideograph makes it Chinese."""
    return F.when(name.rlike(r"[\x{4e00}-\x{9fff}]"), "chinese").otherwise("english")


def items_for_language(items: DataFrame) -> DataFrame:
    """Rows (…, language, scan_item) without the checks unsuited to the language; repeated ones stay."""
    bad = F.broadcast(catalog.unsuited_items(items.sparkSession)).withColumnRenamed("language", "_l")
    return items.join(bad, (F.col("language") == F.col("_l")) & (F.col("scan_item") == F.col("code")), "left_anti")


def classify_file_type(files: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Files with the label of their type, and those of unknown type."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    typed = files.withColumn("suffix", suffix).join(F.broadcast(catalog.file_types(files.sparkSession)), "suffix", "left")
    return typed.filter("label is not null").withColumnRenamed("label", "file_type"), typed.filter("label is null").drop("label")


def fan_out(chunks: DataFrame, live_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """A row for each chunk and known check, and the rows of unknown codes. `live_only` drops skipped checks first.

    Only names of checks multiply: chunks keep their text in the row that Spark already holds.
    """
    known = catalog.scan_items(chunks.sparkSession)
    if live_only:
        known = known.filter(F.col("live") | (F.col("code") == catalog.SENSITIVE_ITEM))
    each = chunks.withColumn("scan_item", F.explode("scan_items")).drop("scan_items")
    names = F.broadcast(known.select(F.col("code").alias("scan_item"), F.col("name").alias("scan_item_name")))
    every = F.broadcast(catalog.scan_items(chunks.sparkSession).select(F.col("code").alias("scan_item")))
    return each.join(names, "scan_item"), each.join(every, "scan_item", "left_anti")


def drop_skipped(work: DataFrame) -> DataFrame:
    """Work items whose check is live."""
    live = catalog.scan_items(work.sparkSession).filter("live").select(F.col("code").alias("scan_item"))
    return work.join(F.broadcast(live), "scan_item", "left_semi")


def with_codes(rows: DataFrame, name: str = "scan_item_name") -> DataFrame:
    """Adds the code for a check's name; unknown names have null."""
    codes = F.broadcast(catalog.item_codes(rows.sparkSession).toDF("_name", "code"))
    return rows.join(codes, F.col(name) == F.col("_name"), "left").drop("_name")


def route(work: DataFrame, models: DataFrame) -> DataFrame:
    """Adds the model of the language (language, model) and the kind of instruction for the chunk's strategy."""
    kind = F.when(F.col("strategy").contains("adaptive_markdown"), "markdown").otherwise("extraction")
    return work.join(models, "language", "left").withColumn("instruction", kind)


def dedupe_uploads(files: DataFrame, name: str = "file_name", size: str = "size", arrival: str = "arrival") -> DataFrame:
    """Of uploads with one name and size the first stays, of several at once that of least hash."""
    first = F.min_by(F.struct(*files.columns), F.struct(arrival, F.xxhash64(*files.columns))).alias("_first")
    return files.groupBy(name, size).agg(first).select("_first.*")
