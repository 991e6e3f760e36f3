"""Token counts against the model itself, and their edge cases."""

import random

import pytest

from auditloom.llm import token_counts as t
from auditloom.llm.packing import public_vocabulary

PATH = public_vocabulary(t.MODEL)
HARD = ["", " ", "  ", "a ", " a", "▁x", "a▁b", "\n", "a\n\n b\t c", "12 345.6e7", "ＡＢＣ ﬁ", "a\x00b", "é É", "<s> </s> <0x0A> <unk>", "　x", "a\r\n\tb", "日本語 テキスト", "²。². ²", "x" * 5000, "ab" * 40 + " " + "?" * 60, "a  b   c", "don't (stop)... it's", "​x", "🙂🙂 👍🏽"]


def texts(n, seed=5):
    r = random.Random(seed)
    signs = [" ", "  ", "\n", "\t", "\r", "a", "the", "Ing", "é", "ß", "7", "42", ".", ",", "--", "(", "²", "日", "🙂", "▁", " ", "\x1f", "</s>", "ø×÷ɐ"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("hot", [0, 7, 100_000])
def test_counts_are_the_models(spark, hot):
    rows = [(k, x) for k, x in enumerate([None, *HARD, *texts(300)])]
    model = t.load(PATH)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in t.token_counts(df, hot=hot, limit=20).collect()}
    want = {k: (len((x or "").encode()), n := len(model.encode(x or "")), n > 20) for k, x in rows}
    assert got == want


def test_whole_texts_where_cuts_do_not_hold(spark, monkeypatch):
    monkeypatch.setattr(t, "cuts_hold", lambda model: False)
    rows, model = list(enumerate(HARD)), t.load(PATH)
    got = {r.doc_id: r.n_tokens for r in t.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: len(model.encode(x)) for k, x in rows}


def test_cuts_hold_for_the_model():
    assert t.cuts_hold(t.load(PATH))


def test_long_texts_are_cut_in_slices(monkeypatch):
    whole = t.frequencies(text := "".join(texts(60, 6)))
    monkeypatch.setattr(t, "SLICE", 11)
    assert t.frequencies(text) == whole


def test_edges(spark):
    docs = "doc_id bigint, text string, row string, name string, pieces bigint, keys string"
    assert t.token_counts(spark.createDataFrame([], docs)).count() == 0
    again = [(None, "a b", "r", "n", 1, "k")] * 3 + [(1, "a b", "r", "n", 1, "k")] * 2 + [(1, "c", None, None, None, None), (2, None, "r", "n", 1, "k")]
    got = t.token_counts(spark.createDataFrame(again, docs), hot=1)
    assert sorted(map(repr, got.collect())) == sorted([f"Row(doc_id={i}, n_bytes={b}, n_tokens={n}, over_limit=False)" for i, b, n in [(None, 3, 2)] * 3 + [(1, 3, 2)] * 2 + [(1, 1, 1), (2, 0, 0)]])
    named = t.token_counts(spark.createDataFrame([(1, "a", 3)], "row bigint, text string, n_hot int"), keys=("row", "n_hot"))
    assert [tuple(r) for r in named.collect()] == [(1, 3, 1, 1, False)]
