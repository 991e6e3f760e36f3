"""Counts of findings, states, results and report questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, rollup, stored_counts
from ..sources import report_store
from .base import Tables, query
from .inputs import FINDINGS, MATERIALS, TASKS
from .text import _folder

F_ = f"WITH f AS ({FINDINGS})"
T_ = f"WITH t AS ({TASKS})"
TM = f"WITH t AS ({TASKS}), m AS ({MATERIALS})"


def _materials(t: Tables):
    counts = F.create_map(F.lit("scanItem5001"), F.col("n_5001"), F.lit("scanItem99999"), F.col("n_99999"))
    return t.sql(MATERIALS).withColumn("problem_counts", F.when(F.col("words") % 3 != 0, counts).otherwise(F.create_map().cast("map<string,bigint>")))


def _tasks(t: Tables):
    return t.sql(TASKS).withColumn("items", F.split("items", ","))


@query("count_findings_by_file", f"{F_} SELECT task_id, scan_item, file_name, count(*) AS n FROM f GROUP BY ALL")
def _(t: Tables):
    return rollup.count_by_file(t.sql(FINDINGS))


@query("problem_totals", f"{F_} SELECT task_id, scan_item, file_name, concat_ws('+', CASE WHEN grouping(scan_item) = 0 THEN 'item' END, CASE WHEN grouping(file_name) = 0 THEN 'file' END) AS level, count(*) AS n FROM f GROUP BY GROUPING SETS ((task_id, scan_item, file_name), (task_id, scan_item), (task_id, file_name), (task_id))")
def _(t: Tables):
    return rollup.problem_totals(t.sql(FINDINGS))


_MERGED = """
, c AS (SELECT user_id * 10 + event_id % 10 AS task_id, 'file_' || cast(1 + event_id % 7 AS string) || '.pdf' AS file_name, CASE WHEN event_type = 'view' THEN 'scanItem5001' ELSE 'scanItem6002' END AS scan_item, count(*) AS n FROM {events} GROUP BY ALL)
SELECT task_id, file_name,
  coalesce((SELECT n FROM c WHERE c.task_id = m.task_id AND c.file_name = m.file_name AND c.scan_item = 'scanItem5001'), CASE WHEN words % 3 != 0 THEN n_5001 END, -1) AS n_5001,
  coalesce((SELECT n FROM c WHERE c.task_id = m.task_id AND c.file_name = m.file_name AND c.scan_item = 'scanItem6002'), -1) AS n_6002, CASE WHEN words % 3 != 0 THEN n_99999 ELSE -1 END AS n_99999
FROM m"""


@query("merge_problem_counts", f"WITH m AS ({MATERIALS}) {_MERGED}")
def _(t: Tables):
    counts = t.sql("SELECT user_id * 10 + event_id % 10 AS task_id, 'file_' || cast(1 + event_id % 7 AS string) || '.pdf' AS file_name, CASE WHEN event_type = 'view' THEN 'scanItem5001' ELSE 'scanItem6002' END AS scan_item, count(*) AS n FROM {events} GROUP BY ALL")
    merged = rollup.merge_counts(_materials(t), counts)
    return merged.select("task_id", "file_name", *[F.coalesce(F.try_element_at("problem_counts", F.lit(f"scanItem{k}")), F.lit(-1)).alias(f"n_{k}") for k in (5001, 6002, 99999)])


_BATCH = "SELECT task_id, file_name, scan_item, count(*) AS n FROM f WHERE finding_id % 3 = {} GROUP BY ALL"


@query("upsert_problem_counts", f"{F_}, a AS ({_BATCH.format(0)}), b AS ({_BATCH.format(1)}) SELECT task_id, file_name, scan_item, coalesce(b.n, a.n) AS n, CASE WHEN b.n IS NULL THEN 1 ELSE 2 END::BIGINT AS batch FROM a FULL JOIN b USING (task_id, file_name, scan_item)")
def _(t: Tables):
    """Two batches of counts, the second told twice and the first once more after it."""
    path, f = _folder(t), t.sql(FINDINGS)
    for part, batch in ((0, 1), (1, 2), (1, 2), (0, 1)):
        stored_counts.upsert_counts(rollup.count_by_file(f.filter(F.col("finding_id") % 3 == part)), path, batch)
    return stored_counts.read_counts(t.spark, path).drop("bucket")


@query("problem_counts_by_column", f"{F_} SELECT task_id, file_name, count(*) FILTER (scan_item = 'scanItem5001') AS \"scanItem5001\", count(*) FILTER (scan_item = 'scanItem6002') AS \"scanItem6002\" FROM f GROUP BY ALL")
def _(t: Tables):
    return rollup.counts_by_column(rollup.count_by_file(t.sql(FINDINGS)), ["scanItem5001", "scanItem6002"])


@query("material_status", f"WITH m AS ({MATERIALS}), n AS (SELECT *, CASE WHEN words % 3 != 0 THEN n_5001 + n_99999 ELSE 0 END AS problem_count FROM m) SELECT task_id, file_name, problem_count, CASE WHEN file_status = 'complete' THEN '处理完成，发现' || cast(problem_count AS string) || '个问题' ELSE file_status END AS message FROM n")
def _(t: Tables):
    return rollup.material_status(_materials(t).withColumnRenamed("file_status", "status")).select("task_id", "file_name", "problem_count", "message")


@query("task_status", f"{T_} SELECT task_id, CASE status WHEN 'complete' THEN '处理完成，发现' || cast(problem_count AS string) || '个问题' WHEN 'processing' THEN '任务处理中' WHEN 'error' THEN '任务执行失败' ELSE status END AS message FROM t")
def _(t: Tables):
    return rollup.task_status(_tasks(t)).select("task_id", "message")


_BY_ITEM = """, i AS (SELECT task_id, unnest(string_split(items, ',')) AS scan_item FROM t WHERE status = 'complete'),
e AS (SELECT i.task_id, scan_item, file_name, file_status, CASE WHEN words % 3 = 0 THEN 0 WHEN scan_item = 'scanItem5001' THEN n_5001 WHEN scan_item = 'scanItem99999' THEN n_99999 ELSE 0 END AS n FROM i JOIN m ON i.task_id = m.task_id)"""


@query("results_by_item", f"{TM}{_BY_ITEM} SELECT task_id, scan_item, cast(sum(n) AS bigint) AS problem_count, count(*) AS file_count, count(*) FILTER (file_status = 'complete') AS completed_files, string_agg(file_name || '=' || cast(n AS string), ';' ORDER BY file_name) AS reports FROM e GROUP BY task_id, scan_item")
def _(t: Tables):
    out = rollup.results_by_item(_tasks(t), _materials(t))
    text = F.array_join(F.transform("file_reports", lambda r: F.concat(r["file_name"], F.lit("="), r["n"].cast("string"))), ";")
    return out.select("task_id", "scan_item", "problem_count", "file_count", "completed_files", text.alias("reports"))


@query("results_by_file", f"{TM}{_BY_ITEM} SELECT task_id, file_name, cast(sum(n) AS bigint) AS total, (SELECT count(*) FROM m WHERE m.task_id = e.task_id) AS files_in_task, string_agg(scan_item || '=' || cast(n AS string), ';' ORDER BY scan_item) AS details FROM e GROUP BY task_id, file_name")
def _(t: Tables):
    out = rollup.results_by_file(rollup.results_by_item(_tasks(t), _materials(t)))
    text = F.array_join(F.transform("details", lambda r: F.concat(r["scan_item"], F.lit("="), r["n"].cast("string"))), ";")
    return out.select("task_id", "file_name", "total", "files_in_task", text.alias("details"))


@query("task_progress", f"{T_} SELECT task_id, cast(CASE total_chunks WHEN 0 THEN 100 WHEN 99999 THEN 0 ELSE trunc(complete_chunks / total_chunks * 100) END AS integer) AS progress FROM t")
def _(t: Tables):
    return _tasks(t).select("task_id", rollup.progress(F.col("complete_chunks"), F.col("total_chunks")).alias("progress"))


@query("materials_per_task", f"{TM} SELECT t.task_id, count(file_name) AS materials FROM t LEFT JOIN m ON t.task_id = m.task_id GROUP BY t.task_id")
def _(t: Tables):
    return rollup.materials_per_task(_tasks(t), _materials(t))


@query("build_report", f"{F_} SELECT finding_id, 'detector' AS stage FROM f UNION ALL SELECT finding_id, 'final' FROM f WHERE value > 20")
def _(t: Tables):
    f = t.sql(FINDINGS)
    return reports.build_report(f, f.filter("value > 20")).select("finding_id", "stage")


@query("issue_page", f"{F_}, p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq, finding_id) AS place FROM f) SELECT task_id, cast(place AS integer) AS place, problem_type AS type, file_name AS location, sentence AS question, coalesce(suggestion, '') AS suggestion FROM p WHERE place BETWEEN 51 AND 100")
def _(t: Tables):
    return reports.issue_page(t.sql(FINDINGS), page=2, limit=50)


_STORED = "finding_id bigint, seq bigint, file_name string, problem_type string, sentence string, suggestion string, strategy string, value double, place bigint, task_id bigint, scan_item string"


def _stored(t: Tables):
    """The findings as a stored report."""
    path = _folder(t)
    report_store.write_report(t.sql(FINDINGS), path)
    return report_store.read_report(t.spark, path, _STORED)


_PLACED = "SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq, finding_id) AS place FROM f"


@query("stored_issue_page", f"{F_}, p AS ({_PLACED}) SELECT task_id, place, problem_type AS type, file_name AS location, sentence AS question, coalesce(suggestion, '') AS suggestion FROM p WHERE place BETWEEN 101 AND 150")
def _(t: Tables):
    """The third page of every task's report, read from the stored order."""
    return report_store.stored_page(_stored(t), page=3, limit=50)


@query("stored_selection", f"{F_}, p AS ({_PLACED}) SELECT finding_id, place, file_name, sentence, suggestion FROM p WHERE task_id = 3 AND scan_item = 'scanItem6001'")
def _(t: Tables):
    """One check of one task, read from its partition."""
    return report_store.stored_selection(_stored(t), "scanItem6001", task_id=3).select("finding_id", "place", "file_name", "sentence", "suggestion")


@query("filter_issues", f"{F_}, p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq, finding_id) AS n, count(*) OVER (PARTITION BY task_id) AS matches FROM f WHERE problem_type = 'error'), q AS (SELECT *, least(3, ceil(matches / 20)) AS page FROM p) SELECT task_id, finding_id, cast(n AS integer) AS n, matches, cast(page AS integer) AS page FROM q WHERE n > (page - 1) * 20 AND n <= page * 20")
def _(t: Tables):
    return reports.filter_issues(t.sql(FINDINGS), page=3, problem_type="error").select("task_id", "finding_id", "n", "matches", "page")


@query("issue_facets", f"{F_} SELECT DISTINCT task_id, 'type' AS facet, problem_type AS value FROM f UNION SELECT DISTINCT task_id, 'file', file_name FROM f")
def _(t: Tables):
    return reports.issue_facets(t.sql(FINDINGS))


@query("task_history", f"{T_} SELECT task_id, status FROM t ORDER BY create_time DESC, task_id DESC LIMIT 100")
def _(t: Tables):
    return reports.task_history(_tasks(t)).select("task_id", "status")


@query("export_selection", f"{F_} SELECT file_name, problem_type, sentence, suggestion FROM f WHERE scan_item = 'scanItem5002'")
def _(t: Tables):
    return reports.export_selection(t.sql(FINDINGS), "scanItem5002").select("file_name", "problem_type", "sentence", "suggestion")


@query("dedupe_findings", f"{F_} SELECT min(finding_id) AS finding_id, file_name, scan_item, sentence, suggestion FROM f GROUP BY file_name, scan_item, sentence, suggestion")
def _(t: Tables):
    return reports.dedupe_findings(t.sql(FINDINGS)).select("finding_id", "file_name", "scan_item", "sentence", "suggestion")
