"""Stored reports: places, pages and selections, and what is read for them."""

import re

import pytest

from auditloom.sources import report_store as s

FINDINGS = "task_id bigint, scan_item string, seq bigint, finding_id bigint, file_name string, problem_type string, sentence string, suggestion string"


def findings(n, task=lambda k: k % 3):
    return [(task(k), f"i{k % 4}", (k * 7919) % 501, k, f"f{k % 5}", "t", f"s{k}", None if k % 6 == 0 else "x") for k in range(n)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_places_are_those_of_a_window(spark, ranges):
    rows = [*findings(700), *[(None, "i1", k % 2, None, "f", "t", "s", None) for k in range(9)], (2, None, None, None, None, None, None, None)]
    got = s.with_places(spark.createDataFrame(rows, FINDINGS).repartition(4), ranges).collect()
    last = lambda x: (x is not None, x or 0)
    for task in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.task_id == task), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        order = [(last(r.seq), last(r.finding_id)) for r in mine]
        assert order == sorted(order)
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, rows))
    assert s.with_places(spark.createDataFrame([], FINDINGS)).count() == 0


def read(df, metric="numOutputRows"):
    """Rows that the scan of a plan that ran has given out, and its description."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    leaf = leaf.plan() if "QueryStage" in leaf.nodeName() else leaf
    return leaf.metrics().apply(metric).value(), leaf.toString()


def test_a_late_page_reads_few_rows(spark, tmp_path):
    n = 120_000
    rows = spark.range(n).selectExpr("id % 2 AS task_id", "concat('i', id % 3) AS scan_item", "id AS seq", "id AS finding_id", "'f' AS file_name", "'t' AS problem_type", "concat('s', id) AS sentence", "'x' AS suggestion")
    path = str(tmp_path / "report")
    s.write_report(rows, path)
    s.write_report(rows, path)  # a second run replaces the first
    report = s.read_report(spark, path)
    assert report.count() == n
    page = s.stored_page(report, page=1000, limit=50, task_id=1)
    assert [r.place for r in page.orderBy("place").collect()] == list(range(49_951, 50_001))
    assert page.filter("question = 's99901'").count() == 1
    seen, plan = read(s.stored_page(report, page=1000, limit=50, task_id=1))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(place,49951\)", plan)
    assert re.search(r"PartitionFilters: \[[^]]*task_id", plan)
    assert seen <= 3 * 2 * s.FILE_PAGE_ROWS < n / 10
    seen, plan = read(s.stored_selection(report, "i2", task_id=0))
    assert seen == n / 6
    assert re.search(r"PartitionFilters: \[[^]]*scan_item", plan)
    files, _ = read(s.stored_selection(report, "i2", task_id=0), "numFiles")
    assert files <= 2


def test_page_of_a_null_task(spark, tmp_path):
    path = str(tmp_path / "report")
    s.write_report(spark.createDataFrame(findings(50, lambda k: None if k % 2 else 1), FINDINGS), path)
    page = s.stored_page(s.read_report(spark, path), 2, 10, task_id=None)
    assert [(r.task_id, r.place) for r in page.orderBy("place").collect()] == [(None, k) for k in range(11, 21)]
