"""The audit by rules: each check's findings, exempt ones, and states of files and tasks."""

from auditloom.plans import rules

DOCS = "task_id bigint, doc_id bigint, file_name string, scan_items array<string>, base_name string, suffix string, strategy string, text string"
EVERY = [rules.SPELLING, rules.TYPOS, rules.TERMS, rules.SIGNS, rules.GARBLED, "scanItem99999", "scanItem1001", "unknown"]


def known(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return rules.Knowledge(frame([("secret",)], "word string"), frame([("good",), ("text",)], "word string"), frame([("帐号", "账号"), ("步署", "部署")], "wrong string, right string"), frame([("web", "web site"), ("web", "website"), ("one", "uno")], "term string, variant string"), frame([("步署",)], "term string"))


def run(spark, docs, tasks=(), files=(), renditions=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return rules.rule_audit(frame(docs, DOCS), frame(renditions, "base_name string, priority int, text string"), known(spark), frame(tasks, "task_id bigint, status string"), frame(files, "task_id bigint, file_name string, status string, problem_counts map<string,bigint>"))


def test_each_rule_once(spark):
    text = "good text wrng secret web site\nwebsite 帐号 步署\n(open“ ok。Fine ??? end"
    docs = [(1, 7, "f.md", EVERY, "f", "docx", "ours-fixed", text), (1, 8, "g.md", [], "g", "docx", "ours-fixed", text), (None, None, "h.md", [rules.TYPOS], "h", "docx", "baseline-naive", "帐号"), (1, 9, "k.md", [rules.TYPOS], "k", "docx", "ours-adaptive", "plain"), (1, 9, "l.md", None, "l", None, "nobody", "帐号")]
    found, files, tasks = run(spark, docs, [(1, "complete"), (2, "processing")], [(1, "f.md", "complete", {"old": 5}), (1, "g.md", "complete", None), (3, "f.md", "complete", None)], [("k", 1, "# h\n帐号 here")])
    got = {(r.file_name, r.scan_item, r.sentence, r.suggestion) for r in found.collect()}
    spelling = {("f.md", rules.SPELLING, w, "") for w in ("wrng", "secret", "web", "site", "website", "open", "ok", "fine", "end")}
    assert got == spelling | {
        ("f.md", rules.TYPOS, "帐号", "账号"), ("h.md", rules.TYPOS, "帐号", "账号"), ("k.md", rules.TYPOS, "帐号", "账号"), ("f.md", rules.TERMS, "web site,website", ""),
        ("f.md", rules.SIGNS, "(open“ ok。", "“” ()"), ("f.md", rules.GARBLED, "???", ""), ("f.md", "scanItem99999", "检测到敏感词：secret", "请确认是否需要替换或删除"),
    }
    assert found.filter("doc_id is null and task_id is null").count() == 1
    assert {(r.scan_item, r.chunk_idx, r.strategy) for r in found.filter("file_name <> 'f.md' or scan_item = 'scanItem6001'").collect()} == {(rules.TYPOS, 0, "baseline_naive"), (rules.TYPOS, 0, "adaptive_markdown"), (rules.TERMS, -1, "")}
    counts = {(r.task_id, r.file_name): (r.problem_counts, r.message) for r in files.collect()}
    assert counts[(1, "f.md")] == ({"old": 5, rules.SPELLING: 9, rules.TYPOS: 1, rules.TERMS: 1, rules.SIGNS: 1, rules.GARBLED: 1, "scanItem99999": 1}, "处理完成，发现19个问题")
    assert counts[(1, "g.md")][1] == counts[(3, "f.md")][1] == "处理完成，发现0个问题"
    assert {(r.task_id, r.message) for r in tasks.collect()} == {(1, "处理完成，发现19个问题"), (2, "任务处理中")}


def test_nothing(spark):
    found, files, tasks = run(spark, [])
    assert found.count() == files.count() == tasks.count() == 0


def test_questions_to_the_written_report(spark, tmp_path):
    from auditloom.plans import serving

    docs = [(task, k, f"f{k % 3}.md", [rules.TYPOS, rules.GARBLED], "b", "docx", "ours-fixed", f"帐号 {k} ??") for task in (1, None) for k in range(30)]
    found, _, _ = run(spark, docs)
    folder = str(tmp_path)
    serving.publish(found, folder)
    assert [r.place for r in serving.page(spark, folder, 2, 10, task_id=None).orderBy("place").collect()] == list(range(11, 21))
    assert serving.page(spark, folder, 7, 10).count() == 0
    assert serving.selection(spark, folder, rules.TYPOS, task_id=1).count() == 30
    assert serving.selection(spark, folder).count() == 120
    screens = serving.screen(spark, folder, 9, file_name="f1.md").collect()
    assert {(r.task_id, r.matches, r.screen) for r in screens} == {(1, 20, 1), (None, 20, 1)}
    assert serving.facets(spark, folder).filter("facet = 'file'").count() == 6
