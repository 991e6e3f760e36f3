"""Answers, committed findings, counts and progress that outlive a run."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from auditloom.operators import answers, stored_counts
from auditloom.plans import audit as plan
from auditloom.sources import readers
from auditloom.streaming import audit


def asks(folder, poison=None, slow=None, answer=lambda p: p.upper()):
    """A callable that notes each prompt it answers in a file of its own."""

    def fn(part):
        if poison in set(part["prompt"]):
            os._exit(1)  # the worker dies, and with it the run
        if slow in set(part["prompt"]):
            import time

            time.sleep(5)
        for p in part["prompt"]:
            with open(f"{folder}/{p}-{uuid.uuid4().hex}", "w"):
                pass
        return [answer(p) for p in part["prompt"]]

    return fn


def calls(folder):
    out = {}
    for f in os.listdir(folder):
        out[f.split("-")[0]] = out.get(f.split("-")[0], 0) + 1
    return out


def test_a_run_that_dies_asks_nothing_twice(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    os.mkdir(log)
    requests = spark.range(60).selectExpr("id", "concat('p', id % 40) AS prompt")
    with pytest.raises(Exception, match="(?i)exit|crash|EOF|abort"):
        answers.ask(requests, asks(log, poison="p7"), store, ("prompt",), batch=1, calls_at_once=40, task_requests=1)
    kept = {r.digest for r in answers.read_store(spark, store).filter("content is not null").collect()}
    answered = {r.prompt for r in requests.withColumn("d", answers.digest(("prompt",))).collect() if r.d in kept}
    assert 0 < len(answered) < 40
    before = calls(log)
    answers.ask(requests, asks(log), store, ("prompt",), batch=3, calls_at_once=4, task_requests=3)
    after = calls(log)
    assert set(after) == {f"p{k}" for k in range(40)}
    assert all(after[p] == before[p] for p in answered)
    answers.ask(requests, asks(log, answer=None), store, ("prompt",))
    assert calls(log) == after
    got = answers.answered(requests, store, ("prompt",), ("id", "prompt")).collect()
    assert sorted((r.id, r.content, r.error) for r in got) == [(k, f"P{k % 40}", None) for k in range(60)]


def test_failed_and_slow_calls_are_asked_again(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    os.mkdir(log)
    requests = spark.range(4).selectExpr("id", "concat('p', id) AS prompt")

    def fails(part):
        raise ValueError("no")

    answers.ask(requests.filter("id < 2"), fails, store, ("prompt",), tries=2)
    answers.ask(requests.filter("id = 2"), asks(log, slow="p2"), store, ("prompt",), tries=1, seconds=0.2)
    got = {r.id: (r.content, r.error) for r in answers.answered(requests, store, ("prompt",)).collect()}
    assert got == {0: (None, "ValueError: no"), 1: (None, "ValueError: no"), 2: (None, "took over 0.2 s"), 3: (None, None)}
    answers.ask(requests, asks(log), store, ("prompt",))
    assert {r.content for r in answers.answered(requests, store, ("prompt",)).collect()} == {"P0", "P1", "P2", "P3"}
    assert answers.read_store(spark, str(tmp_path / "none")).count() == 0
    answers.ask(requests.limit(0), asks(log), str(tmp_path / "none"), ("prompt",))


def test_rejects_of_the_audit(spark, tmp_path):
    docs = spark.createDataFrame([(1, k, f"f{k}.md", "baseline-naive", ["scanItem5001"], f"text {k}") for k in range(4)], "task_id bigint, doc_id bigint, file_name string, strategy string, scan_items array<string>, text string").drop("strategy")
    models = spark.createDataFrame([("english", "m")], "language string, model string")
    told = {"text 0": '[{"问题所在句子": "s"}]', "text 1": "none", "text 2": None, "text 3": "[]"}
    found = plan.detected_findings(docs, spark.createDataFrame([], "word string"), models, lambda part: [told[c] for c in part["chunk"]], str(tmp_path))
    assert [(r.doc_id, r.sentence) for r in found.collect()] == [(0, "s")]
    assert sorted((r.doc_id, r.content, r.reason) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == [(1, "none", "no JSON array"), (2, None, "no answer: null")]


FINDINGS = "finding_id bigint, task_id bigint, seq bigint, file_name string, problem_type string, scan_item string, sentence string, suggestion string, strategy string"


def findings(spark, task, n):
    return spark.createDataFrame([(k, task, k, "f", "t", f"i{k % 2}", "s", None, "x") for k in range(n)], FINDINGS)


def test_a_unit_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "findings")
    assert readers.read_committed(spark, path).count() == 0
    dies = findings(spark, 1, 6).withColumn("sentence", F.when(F.col("finding_id") == 5, F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("sentence"))).repartition(6, "finding_id")
    with pytest.raises(Exception, match="boom"):
        readers.commit_findings(dies, path, "task-1")
    assert readers.read_committed(spark, path).count() == 0
    assert readers.commit_findings(findings(spark, 1, 6), path, "task-1")
    assert not readers.commit_findings(findings(spark, 1, 6), path, "task-1")
    os.makedirs(f"{path}/_manifest", exist_ok=True)
    open(f"{path}/_manifest/task-2", "w").close()  # an attempt that died while it wrote the note
    assert readers.read_committed(spark, path).count() == 6
    assert readers.commit_findings(findings(spark, 2, 3), path, "task-2")
    got = readers.read_committed(spark, path)
    assert sorted((r.task_id, r.finding_id, r.scan_item) for r in got.collect()) == sorted([(1, k, f"i{k % 2}") for k in range(6)] + [(2, k, f"i{k % 2}") for k in range(3)])


def test_counts_are_merged_once(spark, tmp_path):
    path = str(tmp_path / "counts")
    frame = lambda rows: spark.createDataFrame(rows, "task_id bigint, file_name string, scan_item string, n bigint")
    first = [(k, f"f{j}", "i", k + j) for k in range(20) for j in range(3)] + [(None, None, "i", 5)]
    assert stored_counts.upsert_counts(frame(first), path, 1, 8) > 1
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    second = [(3, "f0", "i", 99), (3, "f9", "i", 1), (3, "f9", "i", 2), (None, None, "i", 6)]
    assert stored_counts.upsert_counts(frame(second), path, 2, 8) <= 2
    after = files()
    assert set(before) & set(after)
    assert all(before[f] == after[f] for f in set(before) & set(after))
    assert stored_counts.upsert_counts(frame(second), path, 2, 8) == 0
    assert stored_counts.upsert_counts(frame(first), path, 1, 8) == 0
    assert files() == after
    want = {(k, f, i): n for k, f, i, n in first} | {(3, "f0", "i"): 99, (3, "f9", "i"): 2, (None, None, "i"): 6}
    assert {(r.task_id, r.file_name, r.scan_item): r.n for r in stored_counts.read_counts(spark, path).collect()} == want


@pytest.mark.parametrize("within", [None, "1 hour"])
def test_progress_counts_items_once_and_goes_on(spark, tmp_path, within):
    done, out, state = (str(tmp_path / x) for x in ("done", "out", "state"))
    schema = "task_id bigint, item_id bigint, event_ts timestamp"
    totals = spark.createDataFrame([(1, 4), (2, 2), (3, 1)], "task_id bigint, total bigint")

    def arrives(rows):
        spark.createDataFrame(rows, "task_id bigint, item_id bigint").withColumn("event_ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(done)

    def run():
        audit.stream_progress(audit.read_documents(spark, done, spark.createDataFrame([], schema).schema), totals, out, state, within)
        return {r.task_id: (r.complete, r.progress) for r in audit.read_progress(spark, out).collect()}

    arrives([(1, 10), (1, 11), (1, 10), (2, 10)])
    assert run() == {1: (2, 50), 2: (1, 50)}
    first = sorted(os.listdir(out))
    stamp = os.stat(f"{out}/{first[0]}").st_mtime_ns
    arrives([(1, 11), (1, 12), (9, 1)])  # told again, new, of no known task
    assert run() == {1: (3, 75), 2: (1, 50)}
    later = sorted(set(os.listdir(out)) - set(first))
    assert {r.task_id for f in later for r in spark.read.parquet(f"{out}/{f}").collect()} == {1}
    assert os.stat(f"{out}/{first[0]}").st_mtime_ns == stamp
    assert run() == {1: (3, 75), 2: (1, 50)}


def test_files_written_and_read(spark, tmp_path):
    files = [("a.md", "x\r\ny".encode()), ("b.MD", "é".encode("latin-1")), ("c.pdf", b"1"), ("d", b"2"), ("e.tar", None), ("f.md", "字".encode())]
    assert readers.write_files(spark.createDataFrame(files, "name string, content binary").repartition(3), str(tmp_path / "in")) == 6
    good, bad = readers.read_documents(spark, str(tmp_path / "in"))
    assert sorted((r.file_name, r.text) for r in good.collect()) == [("a.md", "x\ny"), ("f.md", "字")]
    assert {(r.file_name, r.reason) for r in bad.collect()} >= {("b.MD", "not UTF-8"), ("c.pdf", "needs extracted rows: pdf"), ("d", "cannot read .")}


def test_stored_tables_are_read_in_ranges(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    tasks = spark.range(-5, 95).selectExpr("id AS task_id", "concat('s', id % 3) AS status")
    tasks.write.jdbc(url, "tasks")
    got = readers.read_stored_table(spark, url, "tasks", "task_id", rows_a_part=30)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tasks.collect()))
    assert max(got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 30
    tasks.limit(0).write.jdbc(url, "idle")
    assert readers.read_stored_table(spark, url, "idle", "task_id").count() == 0
