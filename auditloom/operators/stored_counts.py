"""Counts of findings as a stored table that batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import exists, saved

#: Partitions of the table: a batch rewrites those that hold a count it changes.
BUCKETS = 64
COUNTS = "task_id bigint, file_name string, scan_item string, n bigint, batch bigint, bucket int"
KEYS = ["task_id", "file_name", "scan_item"]


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, file_name, scan_item, n, batch, bucket): the batch is the one that last set the count."""
    return spark.read.schema(COUNTS).parquet(path) if exists(spark, path) else spark.createDataFrame([], COUNTS)


def upsert_counts(counts: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> int:
    """Sets counts (task_id, file_name, scan_item, n) in the table of a path; returns how many partitions it rewrote.

    A count replaces one that an earlier batch has set. Batches have rising numbers: one that comes again, or late,
    changes nothing that it or a later one has set, and partitions without a change keep their files. Of counts of one key in a
    batch the largest stays. Nulls are values like others.
    """
    spark = counts.sparkSession
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")
    new = counts.groupBy(*KEYS).agg(F.max(F.col("n").cast("bigint")).alias("n")).withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": bucket})
    old = read_counts(spark, path)
    key = lambda x: F.struct(*[F.struct(F.col(f"{x}.{k}").isNull(), F.col(f"{x}.{k}")) for k in KEYS])
    known = new.alias("a").join(old.filter(F.col("batch") >= batch).alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (key("a") == key("b")), "left_anti")
    changed = saved(known)
    touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return 0
    kept = old.filter(F.col("bucket").isin(touched)).alias("a").join(changed.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (key("a") == key("b")), "left_anti")
    merged = saved(kept.unionByName(changed))  # whole before the first file is replaced
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)
