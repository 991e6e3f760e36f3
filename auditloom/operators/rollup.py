"""Counting findings, and the states and results made of the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog

FINDING_KEYS = ["task_id", "scan_item", "file_name"]


def count_by_file(findings: DataFrame) -> DataFrame:
    """Findings of each task, check and file."""
    return findings.groupBy(*FINDING_KEYS).agg(F.count("*").alias("n"))


def problem_totals(findings: DataFrame) -> DataFrame:
    """Totals by (task, check, file), (task, check), (task, file) and task; `level` names what a row is for.

    Counts are made once; the grouping sets run over these.
    """
    task, item, file = FINDING_KEYS
    sets = count_by_file(findings).groupingSets([[task, item, file], [task, item], [task, file], [task]], task, item, file)
    level = F.concat_ws("+", F.when(F.grouping(item) == 0, "item"), F.when(F.grouping(file) == 0, "file"))
    return sets.agg(F.sum("n").alias("n"), level.alias("level")).select(task, item, file, "level", "n")


def merge_counts(materials: DataFrame, counts: DataFrame) -> DataFrame:
    """`materials` (…, task_id, file_name, problem_counts map) with each check's count (task_id, scan_item, file_name, n) set; new values win."""
    new = counts.groupBy("task_id", "file_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("scan_item", F.col("n").cast("bigint"))))).alias("_new"))
    joined = materials.join(new, ["task_id", "file_name"], "left")
    old = F.map_filter("problem_counts", lambda k, v: ~F.array_contains(F.map_keys("_new"), k))
    merged = F.when(F.col("_new").isNull(), F.col("problem_counts")).otherwise(F.map_concat(F.coalesce(old, F.create_map().cast("map<string,bigint>")), "_new"))
    return joined.withColumn("problem_counts", merged).drop("_new").select(*materials.columns)


def total_of(counts):
    """Sum of a map's values; null and empty maps have 0."""
    return F.aggregate(F.coalesce(F.map_values(counts), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def material_status(materials: DataFrame) -> DataFrame:
    """Adds problem_count and message: a sentence with the count once complete, else the state itself."""
    n = total_of(F.col("problem_counts"))
    said = F.when(F.col("status") == "complete", F.format_string("处理完成，发现%d个问题", n)).otherwise(F.col("status"))
    return materials.withColumn("problem_count", n).withColumn("message", said)


def task_status(tasks: DataFrame) -> DataFrame:
    """The same for tasks: known states have a text of their own, unknown ones stand for themselves; a complete task keeps its end."""
    known = F.broadcast(catalog.status_texts(tasks.sparkSession))
    said = F.when(F.col("status") == "complete", F.format_string("处理完成，发现%d个问题", F.coalesce("problem_count", F.lit(0)).cast("bigint"))).otherwise(F.coalesce("status_text", "status"))
    return tasks.join(known, "status", "left").withColumn("message", said).drop("status_text")


def results_by_item(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """For complete tasks (task_id, status, items array) a row for each check with sums and every file's count, 0 where there is none.

    A row holds a name and a number for each file of its task: some megabytes for a hundred thousand uploaded files.
    """
    done = tasks.filter("status = 'complete'").select("task_id", F.explode("items").alias("scan_item"))
    each = done.join(materials, "task_id").withColumn("n", F.coalesce(F.element_at("problem_counts", F.col("scan_item")), F.lit(0)).cast("bigint"))
    reports = F.sort_array(F.collect_list(F.struct("file_name", "n")))
    return each.groupBy("task_id", "scan_item").agg(F.sum("n").alias("problem_count"), F.count("*").alias("file_count"), F.sum(F.when(F.col("file_status") == "complete", 1).otherwise(0)).alias("completed_files"), reports.alias("file_reports"))


def results_by_file(by_item: DataFrame) -> DataFrame:
    """results_by_item() turned: a row for each task and file with its total and its checks."""
    each = by_item.select("task_id", "scan_item", "file_count", F.explode("file_reports").alias("r"))
    return each.groupBy("task_id", F.col("r.file_name").alias("file_name")).agg(F.sum("r.n").alias("total"), F.max("file_count").alias("files_in_task"), F.sort_array(F.collect_list(F.struct("scan_item", F.col("r.n").alias("n")))).alias("details"))


def progress(complete, total):
    """Whole percent; nothing to do is 100, not counted yet (99999) is 0."""
    return F.when(total == 0, 100).when(total == 99999, 0).otherwise((complete / total * 100).cast("int"))


def materials_per_task(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    counts = materials.groupBy("task_id").agg(F.count("*").alias("n"))
    return tasks.select("task_id").join(counts, "task_id", "left").select("task_id", F.coalesce("n", F.lit(0)).alias("materials"))


def counts_by_column(counts: DataFrame, items: list[str]) -> DataFrame:
    """One row for each task and file with a column for each of the given checks."""
    return counts.groupBy("task_id", "file_name").pivot("scan_item", items).agg(F.sum("n")).na.fill(0)


def with_place(findings: DataFrame) -> DataFrame:
    """Adds the place of each finding in its task's report, from 1."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("seq", "finding_id")))
