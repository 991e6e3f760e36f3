"""Rules and edge cases of the other operators."""

import pandas as pd
from pyspark.sql import functions as F

from auditloom.functions import text as fx
from auditloom.operators import detect, evaluate, fanout, layout, reports, rollup, scoring
from auditloom.sources import readers


def one(spark, column, **values):
    given = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return given.select(column.alias("x")).first().x


def test_strip_and_clean(spark):
    assert one(spark, fx.strip(F.col("a")), a="　 x\x1c\r\n") == "x"
    assert one(spark, fx.clean_lines(F.col("a")), a=" abc \r\nde\x0bfgh") == "abc\nfgh"


def test_reflow(spark):
    assert one(spark, fx.reflow_newlines("a"), a="ab \n\ncd。\n中\nx") == "ab △△cd。\n中x"
    cell = lambda a, **k: one(spark, fx.reflow_cell(F.col("a"), **k), a=a)
    assert cell("one") == "one" and cell("ab\nCd\nef") == "ab Cdef" and cell("word\nnext") == "word△next"
    assert cell("expert.l\nog is") == "expert.log is" and cell("list:\nitem") == "list: item" and cell("item\n1. two") == "item\n1. two"
    assert cell("http://a.b\nword") == "http://a.bword" and cell('say "x\nword') == 'say "xword'
    assert cell("long\n\nline") == "longline" and cell("long\n\nline", strict=True) is None


def test_paragraph_start(spark):
    start = lambda a, b="": one(spark, fx.is_paragraph_start(F.col("b"), F.col("a")), a=a, b=b)
    assert all(map(start, ["• x", "步骤 1", "1. x", "2) x", "1.2 x", "a. x", "表 3"])) and start("x", "Intro ..... 12")
    assert not any(map(start, ["x", "12. x", "A. x", "10 x"]))


def test_table_records(spark):
    cells = [(1, 0, 0, 0, "h"), (1, 0, 1, 0, "a"), (1, 0, 1, 1, None), (1, 0, 2, 0, " "), (1, 0, 3, 0, "b"), (1, 0, 3, 1, "c"), (1, 0, 3, 2, "extra"), (1, 1, 0, 0, "only")]
    out = layout.table_to_records(spark.createDataFrame(cells, "doc_id int, table_idx int, row_idx int, col_idx int, cell string")).collect()
    assert len(out) == 1 and out[0].data == [{"column 1": "a", "column 2": ""}, {"column 1": "b", "column 2": "c"}]


def test_layout_tail(spark):
    words = [(1, 0, k, w, x, x + 10.0, top, top + 10.0) for k, (w, x, top) in enumerate([("one", 50.0, 0.0), ("two", 400.0, 0.0), ("three", 50.0, 30.0), ("four", 400.0, 30.0)])]
    df = spark.createDataFrame(words, "doc_id int, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double")
    assert [r.text for r in layout.words_to_paragraphs(df).collect()] == [" one two three four"]
    assert sorted(r.text for r in layout.words_to_paragraphs(df, compat=True).collect()) == [" one two ", " one two three four"]


def test_fan_out(spark):
    docs = spark.createDataFrame([(1, ["scanItem99999", "scanItem1001", "nope"])], "doc_id int, scan_items array<string>")
    work, bad = fanout.fan_out(docs)
    assert work.count() == 2 and [r.scan_item for r in bad.collect()] == ["nope"]
    live, _ = fanout.fan_out(docs, live_only=True)
    assert [r.scan_item for r in live.collect()] == ["scanItem99999"]
    assert one(spark, fanout.detect_language(F.col("a")), a="说明.pdf") == "chinese"


def test_merge_counts(spark):
    m = spark.createDataFrame([(1, "f", {"a": 1, "b": 2}), (1, "g", None)], "task_id int, file_name string, problem_counts map<string,bigint>")
    n = spark.createDataFrame([(1, "f", "b", 5), (1, "f", "c", 1), (1, "none", "a", 9), (1, "g", "a", 3)], "task_id int, file_name string, scan_item string, n bigint")
    got = {r.file_name: r.problem_counts for r in rollup.merge_counts(m.select("task_id", "file_name", "problem_counts"), n).collect()}
    assert got == {"f": {"a": 1, "b": 5, "c": 1}, "g": {"a": 3}}


def test_progress(spark):
    got = spark.createDataFrame([(0, 0), (5, 99999), (1, 3), (2, 3)], "c int, t int").select(rollup.progress(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [100, 0, 33, 66]


def test_sensitive_words(spark):
    chunks = spark.createDataFrame([(1, "some token and 机密"), (2, ""), (3, None)], "doc_id int, chunk string")
    words = spark.createDataFrame([("token",), ("机密",), ("",), (None,), ("Token",)], "word string")
    few = sorted(r.word for r in detect.scan_sensitive_words(chunks, words).collect())
    many = words.unionByName(spark.range(2000).select(F.concat(F.lit("zz"), F.col("id").cast("string")).alias("word")))
    assert few == ["token", "机密"] == sorted(r.word for r in detect.scan_sensitive_words(chunks, many).collect())
    assert detect.scan_sensitive_words(chunks, words.limit(0)).count() == 0


def test_load_words(spark):
    words = spark.createDataFrame([("a",), (None,), ("a",), (" ",)], "w string")
    assert [r.word for r in readers.load_sensitive_words(words).collect()] == ["a"]
    assert sorted(r.word for r in readers.load_sensitive_words(words, keep_nan=True).collect()) == [" ", "a", "nan"]


def test_decode(spark):
    files = [(1, "a", "é".encode()), (1, "b", "中文".encode("gbk")), (1, "c", b"\xff\xfe\xff")]
    text = readers.decode_html_blocks(spark.createDataFrame(files, "doc_id int, path string, content binary")).first().text
    assert text.split("\n")[:2] == ["é", "中文"]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("x\r\ny".encode())
    (tmp_path / "b.exe").write_bytes(b"x")
    good, bad = readers.read_documents(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["x\ny"] and [r.reason for r in bad.collect()] == ["cannot read .exe"]


def test_score_retries(spark):
    def flaky(part: pd.DataFrame) -> list[str]:
        if (part["k"] == 3).any():
            raise ValueError("no")
        return ["[]"] * len(part)

    out = scoring.score(spark.range(5).select(F.col("id").alias("k")).coalesce(1), flaky, batch=2).orderBy("k").collect()
    assert [r.content for r in out] == ["[]", "[]", None, None, "[]"] and out[3].error == "ValueError: no"


def test_parse(spark):
    answers = [(1, "<think>\n\n<think>\n\n[{\"问题所在句子\": \"s\"}]"), (2, "{}"), (3, "[1"), (4, None), (5, "[]")]
    found, bad = scoring.parse_responses(spark.createDataFrame(answers, "k int, content string"))
    assert [(r.k, r.sentence) for r in found.collect()] == [(1, "s")] and sorted(r.k for r in bad.collect()) == [2, 3]


def test_review(spark):
    f = spark.createDataFrame([(k, "scanItem5001") for k in range(4)] + [(9, "scanItem99999")], "finding_id int, scan_item string")
    v = spark.createDataFrame([(0, "True"), (1, "False"), (2, None)], "finding_id int, decision string")
    assert {r.finding_id: r.review for r in scoring.apply_review(f, v).collect()} == {0: "confirmed", 3: "unreviewed", 9: "bypassed"}
    assert scoring.apply_review(f, v, "detector-only").count() == 5


def test_unpaired(spark):
    signs = lambda a: one(spark, detect.unpaired(F.col("a")), a=a)
    assert signs("“a”") == "" and signs("“a (b") == "“” ()" and signs('`(` "') == '"'


def test_pages(spark):
    rows = spark.createDataFrame([(k, 1, k, "t", "f", "s", None) for k in range(45)], "finding_id int, task_id int, seq int, problem_type string, file_name string, sentence string, suggestion string")
    assert reports.filter_issues(rows, 9).count() == 5
    assert [r.place for r in reports.issue_page(rows, 2, 20).orderBy("place").collect()] == list(range(21, 41))


def test_metrics_without_findings(spark):
    truth = spark.createDataFrame([(1, "e", "f", "x", "y")], "gt_id int, experiment string, file_name string, injected_text string, expected_correction string")
    none = spark.createDataFrame([], "finding_id int, experiment string, file_name string, scan_item string, sentence string, suggestion string")
    r = evaluate.detection_metrics(truth, none).first()
    assert (r.recall, r.precision, r.f1, r.reported) == (0, 0, 0, 0)


def test_keywords_match(spark):
    truth = spark.createDataFrame([(1, "e", "f", "x", "never", ["k"])], "gt_id int, experiment string, file_name string, injected_text string, expected_correction string, keywords array<string>")
    found = spark.createDataFrame([(7, "e", "f", "axb", "a k"), (8, "e", "f", "axb", "z")], "finding_id int, experiment string, file_name string, sentence string, suggestion string")
    assert [r.finding_id for r in evaluate.match_ground_truth(truth, found).collect()] == [7]


def test_reviewed_audit(spark, tmp_path):
    from auditloom.plans import audit

    def detector(part):
        return ['[{"问题类型": "p", "问题所在句子": "' + c.split()[0] + '"}]' for c in part["chunk"]]

    def reviewer(part):
        if "boom" in set(part["sentence"]):
            raise ValueError("down")
        return ['{"decision": "True"}' if s == "good" else "no JSON" if s == "odd" else '{"decision": "False"}' for s in part["sentence"]]

    both = ["scanItem6002", "scanItem6002", "scanItem99999", "scanItem6003", "scanItem1"]
    rows = [(1, 1, "a.md", both, "good token"), (1, 2, "b.md", ["scanItem6002"], "bad x"), (1, 3, "c.md", ["scanItem6002"], "odd x"), (2, 4, "d.md", both, ""), (2, 5, "e.md", both, None), (2, 6, "f.md", None, "good")]
    docs = spark.createDataFrame(rows, "task_id bigint, doc_id bigint, file_name string, scan_items array<string>, text string").coalesce(1)
    words = spark.createDataFrame([("token",), ("",)], "word string")
    models = spark.createDataFrame([("english", "m")], "language string, model string")
    shape = lambda x: sorted((r.doc_id, r.scan_item, r.sentence) for r in x.collect())

    detected, final = audit.reviewed_audit(docs, words, models, detector, reviewer, str(tmp_path / "one"))
    good, word = (1, "scanItem6002", "good"), (1, "scanItem99999", "检测到敏感词：token")
    assert shape(detected) == sorted([good, good, word, (2, "scanItem6002", "bad"), (3, "scanItem6002", "odd")])
    assert shape(final) == sorted([good, good, word])
    assert {(r.sentence, r.review) for r in final.collect()} == {("good", "confirmed"), (word[2], "bypassed")}
    assert spark.read.csv(str(tmp_path / "one/final-csv"), header=True).count() == 3
    assert spark.read.json(str(tmp_path / "one/final-json")).count() == 3

    failing = docs.withColumn("text", F.lit("boom x"))
    detected, final = audit.reviewed_audit(failing, words, models, detector, reviewer, str(tmp_path / "two"))
    assert shape(final) == shape(detected) and {r.review for r in final.collect()} == {"unreviewed"}
    detected, final = audit.reviewed_audit(docs.limit(0), words, models, detector, reviewer, str(tmp_path / "three"))
    assert detected.count() == final.count() == 0
