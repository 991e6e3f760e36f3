"""Reports stored in their order, so that a page, a check or a file is read without the rest.

Findings are dealt into ranges of (task, seq, id) and sorted, which gives each its place in its task's report without
gathering a task anywhere: a range counts its own rows of a task, and the ranges before it add up to an offset. The
table is partitioned by task and check, and sorted by place within its files, whose pages of rows are small. A page of a
report then reads the partitions of the task, and of these the pages of rows that the range of places can lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import saved
from ..operators.reports import MOST_A_PAGE, USUAL_PAGE, page_rows

#: Rows of a page and of a group in the files: what is read around the rows that are asked for.
FILE_PAGE_ROWS, FILE_GROUP_ROWS = 1_000, 20_000
#: What the findings of a task are ordered by.
REPORT_ORDER = ("seq", "finding_id")


def with_places(findings: DataFrame, ranges: int | None = None, by: tuple[str, ...] = REPORT_ORDER) -> DataFrame:
    """Adds the place of each finding in its task's report, from 1: in the order of the given columns, nulls first, then of a hash of the row. A null task is one task. No task is gathered in one place."""
    order = ["task_id", *by, "_tie"]
    rows = findings.withColumn("_tie", F.xxhash64(*[c for c, kind in findings.dtypes if "map<" not in kind]))
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    dealt = saved(dealt.sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    parts = dealt.groupBy("task_id", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("task_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("task_id").alias("_task"), F.col("_range").alias("_part"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = dealt.join(parts, dealt["task_id"].eqNullSafe(parts["_task"]) & (dealt["_range"] == parts["_part"]))
    return met.select(*findings.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("place"))


def write_report(findings: DataFrame, path: str, ranges: int | None = None, by: tuple[str, ...] = REPORT_ORDER) -> None:
    """Writes findings (task_id, scan_item, …) with their places. A second run replaces the first."""
    placed = with_places(findings, ranges, by)
    placed = placed.repartitionByRange("task_id", "scan_item", "place").sortWithinPartitions("task_id", "scan_item", "place")
    out = placed.write.mode("overwrite").partitionBy("task_id", "scan_item")
    out.option("parquet.page.row.count.limit", FILE_PAGE_ROWS).option("parquet.block.row.count.limit", FILE_GROUP_ROWS).parquet(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored report. With its schema given, task and check keep their types whatever their values look like."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def _is(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == value


def stored_page(report: DataFrame, page: int, limit: int = USUAL_PAGE, **task) -> DataFrame:
    """A page of every task's report, or with task_id=… of that task's: a filter on the stored place, which reaches the files."""
    limit = min(limit, MOST_A_PAGE)
    rows = report.filter(_is("task_id", task["task_id"])) if "task_id" in task else report
    return page_rows(rows.filter(F.col("place").between((page - 1) * limit + 1, page * limit)))


def stored_selection(report: DataFrame, scan_item: str | None = None, **task) -> DataFrame:
    """Rows of one check, or all, of every task or with task_id=… of that one: only their partitions are read."""
    rows = report.filter(_is("task_id", task["task_id"])) if "task_id" in task else report
    return rows.filter(F.col("scan_item") == scan_item) if scan_item else rows
