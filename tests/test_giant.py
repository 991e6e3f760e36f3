"""Documents packed in segments against the fold over the whole document."""

import random

import numpy as np
import pytest

from auditloom.operators import chunking, evaluate, giant, reports


def line(r, size):
    return "".join(r.choice("abc。， ，；") for _ in range(r.choice([0, 1, 3, 7, size - 1, size, size + 1, 3 * size])))


def documents(seed, size, most):
    r = random.Random(seed)
    return {k: [line(r, size) for _ in range(r.randint(0, n))] for k, n in [(1, 3), (2, most), (None, most), (4, most // 2), (5, 0)]}


@pytest.mark.parametrize(("seed", "size", "places", "fan"), [(1, 20, 4, 2), (2, 20, 9, 256), (3, 7, 5, 3)])
def test_lines(spark, monkeypatch, seed, size, places, fan):
    monkeypatch.setattr(giant, "FAN", fan)
    docs = documents(seed, size, 70)
    r = random.Random(seed)
    rows = [(k, at + (at // 11) * 7, x, "z") for k, lines in docs.items() for at, x in enumerate(lines)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, at int, line string, _segment string").repartition(3)
    got = {}
    for x in giant.chunk_lines(df, size, places).collect():
        assert (x.length, x.strategy, x.note) == (len(x.chunk), "baseline_fixed", None)
        got.setdefault(x.doc_id, {})[x.chunk_idx] = x.chunk
    want = {k: chunking.pack_paragraphs("\n".join(lines), size) for k, lines in docs.items()}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize(("seed", "size", "places", "fan"), [(1, 40, 3, 2), (2, 15, 6, 4)])
def test_blocks(spark, monkeypatch, seed, size, places, fan):
    monkeypatch.setattr(giant, "FAN", fan)
    r = random.Random(seed)
    table = lambda: "表 1\n<table>" + "".join(f"<tr><td>{'x' * r.randint(1, 9)}</td></tr>" for _ in range(r.randint(1, 9))) + "</table>"
    docs = {k: [r.choice(["a", "bc", "d" * (size // 2), line(r, size) or "e", table()]) for _ in range(n)] for k, n in [(1, 60), (2, 2), (None, 33)]}
    head = lambda x: "表 1" if "<table>" in x else ""
    rows = [(k, at, x, head(x)) for k, blocks in docs.items() for at, x in enumerate(blocks)]
    got = {}
    for x in giant.chunk_block_rows(spark.createDataFrame(rows, "doc_id bigint, block_idx int, content string, header_text string").repartition(4), size, places).collect():
        got.setdefault(x.doc_id, {})[x.chunk_idx] = (x.chunk, x.note)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: chunking.pack_blocks([(x, head(x)) for x in v], size) for k, v in docs.items()}


@pytest.mark.parametrize("packing", [giant.PARAGRAPHS, giant.BLOCKS])
def test_tables_say_what_is_held(packing):
    r = random.Random(8)
    for _ in range(50):
        size = r.randint(3, 30)
        lengths = [r.choice([1, 2, size // 2 + 1, size - 1, size, size + 1]) for _ in range(r.randint(0, 40))]
        table = giant.held_after(lengths, size, packing)
        for used in range(packing.most_held(size) + 1):
            state = np.int64(used)
            for n in lengths:
                state, _ = packing.step(state, n, size)
            assert table[used] == state


def test_no_rows(spark):
    assert giant.chunk_lines(spark.createDataFrame([], "doc_id bigint, at int, line string")).count() == 0
    assert giant.chunk_lines(spark.createDataFrame([(1, 0, " "), (1, 1, None)], "doc_id bigint, at int, line string")).count() == 0


def test_dispatch_of_rows_without_id_or_with_the_same(spark):
    docs = [(1, "a", "docx", "ours-adaptive", "plain"), (1, "a", "docx", "ours-adaptive", "plain"), (None, "a", "docx", "ours-adaptive", "plain"), (None, "b", "docx", "ours-fixed", "one\ntwo"), (2, "c", "docx", "ours-adaptive", None), (3, None, "chm", "baseline-naive", "abc"), (4, "d", None, None, "x")]
    forms = [("a", 1, "# h\nbody"), ("a", 1, "# i\nbody"), ("a", None, "# g\nno"), ("c", None, "# c\ntext"), (None, 1, "never")]
    got = chunking.dispatch(spark.createDataFrame(docs, "doc_id int, base_name string, suffix string, strategy string, text string"), spark.createDataFrame(forms, "base_name string, priority int, text string"))
    assert sorted(((r.doc_id, r.chunk_idx, r.chunk, r.strategy) for r in got.collect()), key=repr) == sorted([(1, 0, "# h\nbody", "adaptive_markdown")] * 2 + [(None, 0, "# h\nbody", "adaptive_markdown"), (None, 0, "one\ntwo\n", "baseline_fixed"), (2, 0, "# c\ntext", "adaptive_markdown"), (3, 0, "abc", "baseline_naive")], key=repr)


def test_best_run_has_an_f1(spark):
    runs = [("x", "a", 0.5), ("x", "b", None), ("x", "c", 0.9), ("x", "d", 0.9), ("y", "e", None), (None, "f", 0.1)]
    got = evaluate.best_runs(spark.createDataFrame(runs, "strategy string, experiment string, f1 double"), ("strategy",))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("x", "c", 0.9), ("y", "e", None), (None, "f", 0.1)]))


def test_findings_without_id_stay(spark):
    rows = [(None, "f", "i", "s", "t"), (None, "f", "i", "s", "t"), (3, "f", "i", "u", "t"), (None, "f", "i", "u", "t"), (2, "f", None, "u", None), (2, "f", None, "u", None)]
    got = reports.dedupe_findings(spark.createDataFrame(rows, "finding_id int, file_name string, scan_item string, sentence string, suggestion string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[4]]))
