"""Questions to reports: union, pages, filters, facets, history, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import with_place

MOST_A_PAGE, USUAL_PAGE, SCREEN_ROWS, HISTORY_ROWS = 1000, 500, 20, 100


def build_report(detected: DataFrame, final: DataFrame) -> DataFrame:
    """Findings before and after review in one table, told apart by `stage`."""
    return detected.withColumn("stage", F.lit("detector")).unionByName(final.withColumn("stage", F.lit("final")))


def suggestion_text(suggestion: Column) -> Column:
    """A suggestion as text; JSON objects stay JSON."""
    return F.coalesce(suggestion, F.lit(""))


def issue_page(findings: DataFrame, page: int, limit: int = USUAL_PAGE) -> DataFrame:
    """One page of every task's report, with what a list of issues shows.

    Spark takes the first page * limit rows of a task in each partition before it shuffles, up to spark.sql.optimizer.windowGroupLimitThreshold rows.
    """
    limit = min(limit, MOST_A_PAGE)
    return page_rows(with_place(findings).filter(F.col("place").between((page - 1) * limit + 1, page * limit)))


def page_rows(placed: DataFrame) -> DataFrame:
    """What a list of issues shows of findings with their places."""
    return placed.select("task_id", "place", F.col("problem_type").alias("type"), F.col("file_name").alias("location"), F.col("sentence").alias("question"), suggestion_text(F.col("suggestion")).alias("suggestion"))


def filter_issues(findings: DataFrame, page: int, problem_type: str | None = None, file_name: str | None = None) -> DataFrame:
    """A screen of the matching issues of each task; a page past the end is the last one.

    Matches are counted by an aggregate of their own, so that only the first screens of a task are sorted, as in issue_page().
    """
    rows = findings
    if problem_type:
        rows = rows.filter(F.col("problem_type") == problem_type)
    if file_name:
        rows = rows.filter(F.col("file_name") == file_name)
    matches = rows.groupBy(F.col("task_id").alias("_task")).agg(F.count("*").alias("matches"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy("seq", "finding_id"))).filter(F.col("n") <= page * SCREEN_ROWS)
    first = first.join(matches, F.col("task_id").eqNullSafe(F.col("_task"))).drop("_task")
    first = first.withColumn("page", F.least(F.lit(page), F.ceil(F.col("matches") / SCREEN_ROWS)).cast("int"))
    return first.filter((F.col("n") > (F.col("page") - 1) * SCREEN_ROWS) & (F.col("n") <= F.col("page") * SCREEN_ROWS))


def issue_facets(findings: DataFrame) -> DataFrame:
    """The problem types and files that occur in each task."""
    kinds = F.explode(F.array(F.struct(F.lit("type").alias("facet"), F.col("problem_type").alias("value")), F.struct(F.lit("file").alias("facet"), F.col("file_name").alias("value"))))
    return findings.select("task_id", kinds.alias("x")).select("task_id", "x.facet", "x.value").distinct()


def task_history(tasks: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The newest tasks."""
    return tasks.orderBy(F.desc("create_time"), F.desc("task_id")).limit(rows)


def export_selection(findings: DataFrame, scan_item: str | None = None) -> DataFrame:
    """Rows of one check, or all; on a table partitioned by check only its files are read."""
    return findings.filter(F.col("scan_item") == scan_item) if scan_item else findings


def dedupe_findings(findings: DataFrame, keys: tuple[str, ...] = ("file_name", "scan_item", "sentence", "suggestion")) -> DataFrame:
    """One finding, the one with the least id, for each file, check, sentence and suggestion. Findings without an id come last; equal ids are told apart by a hash of the row."""
    plain = [c for c, kind in findings.dtypes if "map<" not in kind]
    order = F.struct(F.col("finding_id").isNull(), "finding_id", F.xxhash64(*plain))
    first = F.min_by(F.struct(*findings.columns), order).alias("_first")
    return findings.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first).select("_first.*")
