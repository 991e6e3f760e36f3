"""Questions to the report that an audit has written: its pages, filtered screens, facets and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports
from ..sources import report_store
from .rules import PLACE, SAID

#: The order of findings in the report: that of the text.
ORDER = ("doc_id", "chunk_idx", "scan_item", "sentence", "suggestion")
SCHEMA = "doc_id bigint, file_name string, chunk_idx int, strategy string, problem_type string, sentence string, suggestion string, term string, place bigint, task_id bigint, scan_item string"


def publish(found: DataFrame, folder: str) -> None:
    """Writes the findings of an audit as its report. A second run of the audit replaces the first one's."""
    report_store.write_report(found.select(*PLACE, *SAID), f"{folder}/report", by=ORDER)


def report(spark: SparkSession, folder: str) -> DataFrame:
    return report_store.read_report(spark, f"{folder}/report", SCHEMA)


def page(spark: SparkSession, folder: str, number: int, limit: int = reports.USUAL_PAGE, **task) -> DataFrame:
    """A page of every task's report, or with task_id=… of one."""
    return report_store.stored_page(report(spark, folder), number, limit, **task)


def screen(spark: SparkSession, folder: str, number: int, problem_type: str | None = None, file_name: str | None = None) -> DataFrame:
    """A screen of each task's issues of a type or file; a number past the end is the last one."""
    rows = report(spark, folder).withColumnsRenamed({"place": "seq"})
    return reports.filter_issues(rows.withColumn("finding_id", rows["seq"]), number, problem_type, file_name).withColumnRenamed("page", "screen")


def facets(spark: SparkSession, folder: str) -> DataFrame:
    """The types and files in each task's report; no other column is read."""
    return reports.issue_facets(report(spark, folder))


def selection(spark: SparkSession, folder: str, scan_item: str | None = None, **task) -> DataFrame:
    """The report of one check, or all, of every task or one."""
    return report_store.stored_selection(report(spark, folder), scan_item, **task)
