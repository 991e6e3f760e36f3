"""Incremental forms of the audit: files are checked as they arrive, and progress follows completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import progress
from ..plans.audit import sensitive_findings


def read_documents(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_audit(docs: DataFrame, words: DataFrame, out: str, checkpoint: str) -> None:
    """Appends the findings of all that has arrived. Stateless; the same functions as in a batch, so a restart neither loses nor repeats."""
    found = sensitive_findings(docs, words)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def stream_progress(completions: DataFrame, totals: DataFrame, out: str, checkpoint: str, within: str | None = None) -> None:
    """Writes, after every batch, the completed items and percent of the tasks that changed in it.

    `completions` (task_id, item_id, …) may repeat: an item counts once. Which items have been seen is state, dealt by
    item and so spread for a hot task too; with `within` and a column event_ts it is kept for that long only. Each batch
    has a folder of its own, which a batch that runs again after a restart replaces, and none rewrites what others wrote.
    """
    if within:
        seen = completions.withWatermark("event_ts", within).dropDuplicatesWithinWatermark(["task_id", "item_id"])
    else:
        seen = completions.dropDuplicates(["task_id", "item_id"])
    counts = seen.groupBy("task_id").agg(F.count("*").alias("complete"))

    def publish(changed: DataFrame, batch: int) -> None:
        done = changed.join(totals, "task_id").select("task_id", "complete", progress(F.col("complete"), F.col("total")).alias("progress"))
        done.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start().awaitTermination()


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """(task_id, complete, progress) as each task last reported it."""
    rows = spark.read.schema("task_id bigint, complete bigint, progress int, batch bigint").parquet(out)
    return rows.groupBy("task_id").agg(F.max_by(F.struct("complete", "progress"), "batch").alias("x")).select("task_id", "x.*")
