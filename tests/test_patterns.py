"""Words and texts contained in texts, against plain search."""

import random

import pyarrow as pa
import pytest

from auditloom.operators import detect, evaluate, patterns


def strings(n, least, most, seed, letters="abé字"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_word_table(seed):
    texts = [None, "", *strings(60, 0, 90, seed)]
    r = random.Random(seed)
    inside = [t[(k := r.randrange(len(t))) : k + r.randint(1, 40)] for t in texts if t for _ in range(3)]
    words = sorted({w for w in [*strings(200, 1, 6, seed + 9), *inside, "a" * 50, "a" * 8, "a" * 9, "b字" * 30] if w})
    table = patterns.WordTable(words)
    for part in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array(texts[:2]), pa.array([], pa.string())):
        row, word = patterns.find_words(part, table)
        assert list(zip(row.tolist(), word.tolist(), strict=True)) == [(i, k) for i, t in enumerate(part.to_pylist()) for k, w in enumerate(words) if w in (t or "")]


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(patterns._Rolling, "hashes", lambda self, first, lengths: lengths.astype("uint64") * 0 + 7)
    words = ["abcdefghij", "abcdefghik", "abcdefghijk"]
    row, word = patterns.find_words(pa.array(["xabcdefghijk", "abcdefghik"]), patterns.WordTable(words))
    assert list(zip(row.tolist(), word.tolist(), strict=True)) == [(0, 0), (0, 2), (1, 1)]


@pytest.mark.parametrize(("inline", "table_bytes"), [(1000, 0), (3, 1 << 20), (3, 10)])
def test_contained_words_every_way(spark, monkeypatch, inline, table_bytes):
    monkeypatch.setattr(detect, "INLINE_WORDS", inline)
    monkeypatch.setattr(detect, "TABLE_BYTES", table_bytes)
    texts, words = [None, "", *strings(40, 0, 30, 3), "a.b*字"], ["", None, "a", "a.b", "字", *strings(30, 1, 12, 4)]
    chunks = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, "ab", "y")] * 2, "doc_id bigint, chunk string, n string")
    got = detect.contained_words(chunks, spark.createDataFrame([(w,) for w in words + words[:5]], "word string")).collect()
    want = [(k, t, n, w) for k, t, n in map(tuple, chunks.collect()) for w in {w for w in words if w} if t and w in t]
    assert sorted(map(tuple, got)) == sorted(want)
    assert detect.contained_words(chunks, spark.createDataFrame([], "word string")).count() == 0


@pytest.mark.parametrize("gram", [1, 2, 6])
def test_contained_pairs(spark, gram):
    r = random.Random(gram)
    key = lambda: r.choice(["p", "q", None])
    texts = [(key(), t) for t in [None, "", "hello world", *strings(80, 0, 25, 5)]]
    needles = [(key(), n) for n in [None, "", "hello", *strings(40, 1, 5, 6), *[t[2:12] for _, t in texts[5:30]]]]
    got = patterns.contained_pairs(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "k string, text string"), ["k"], gram).collect()
    assert sorted(map(tuple, got)) == sorted({(k, n, t) for k, n in needles for j, t in texts if k is not None and k == j and None not in (n, t) and n in t})


def test_matches_of_ground_truth(spark):
    truth = [(1, "e", "f", "bad", "good", None), (2, "e", "f", "", "good", ["other"]), (3, "e", None, "bad", "good", None), (4, "e", "f", None, "x", None), (5, "e", "f", "bad", None, ["word", None])]
    found = [(10, "e", "f", "a bad one", "a good one"), (11, "e", "f", "a bad one", "other word"), (11, "e", "f", "a bad one", "other word"), (12, "e", "f", None, "good"), (13, "x", "f", "bad", "good"), (14, "e", "f", "none", None)]
    t = spark.createDataFrame(truth, "gt_id int, experiment string, file_name string, injected_text string, expected_correction string, keywords array<string>")
    f = spark.createDataFrame(found, "finding_id int, experiment string, file_name string, sentence string, suggestion string")
    got = sorted((r.gt_id, r.finding_id) for r in evaluate.match_ground_truth(t, f).collect())
    assert got == [(1, 10), (2, 10), (2, 11), (2, 11), (5, 11), (5, 11)]
    assert evaluate.match_ground_truth(t.drop("keywords"), f).count() == 2
    hot = spark.range(2000).selectExpr("'e' AS experiment", "'f' AS file_name", "id AS finding_id", "concat('text ', id, ' end') AS sentence", "'s' AS suggestion")
    some = spark.range(300).selectExpr("'e' AS experiment", "'f' AS file_name", "id AS gt_id", "concat('xt ', id * 3 + 1000, ' e') AS injected_text", "'s' AS expected_correction")
    assert evaluate.match_ground_truth(some, hot).count() == 300


@pytest.mark.parametrize("seed", range(4))
def test_word_filter(seed, monkeypatch):
    monkeypatch.setattr(patterns, "SLICE", 50)
    texts = [None, "", *strings(60, 0, 90, seed), "c" * 20]
    r = random.Random(seed)
    inside = [t[(k := r.randrange(len(t))) : k + r.randint(1, 40)] for t in texts if t for _ in range(3)]
    words = sorted({w for w in [*strings(200, 1, 6, seed + 9), *inside, "a" * 50, "a" * 8, "a" * 9, "b字" * 30, "c" * 8, "c" * 12] if w})
    bits = patterns.filter_bits(len(words))
    bitmap = bytearray(1 << bits - 3)
    for part in (pa.array(words[:50]), pa.array(words).slice(50)):
        for p in patterns.word_places(part, bits).tolist():
            bitmap[p >> 3] |= 1 << (p & 7)
    table = patterns.WordFilter(sorted({len(w.encode()) for w in words}), bits, bytes(bitmap))
    for part in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array(texts[:2]), pa.array([], pa.string())):
        found = patterns.possible_words(part, table).to_pylist()
        assert all(len(set(f)) == len(f) and all(x in (t or "") for x in f) for t, f in zip(part.to_pylist(), found, strict=True))
        assert [sorted(set(f) & set(words)) for f in found] == [[w for w in words if w in (t or "")] for t in part.to_pylist()]
        assert sum(map(len, found)) <= 1.01 * sum(w in (t or "") for t in part.to_pylist() for w in words)


def test_words_beyond_a_table_need_no_grams(spark, monkeypatch):
    monkeypatch.setattr(detect, "TABLE_WORDS", 100)
    monkeypatch.setattr(patterns, "grams", lambda *_: pytest.fail("as many rows as the texts have signs"))
    chunks = spark.range(300).selectExpr("id", "concat('no. ', id, '@ and Überlänge-', id, ' of all') AS chunk")
    words = spark.range(0, 5000, 2).selectExpr("concat(id, '@') AS word").union(spark.range(0, 5000, 3).selectExpr("concat('Überlänge-', id) AS word"))
    got = {(r.id, r.word) for r in detect.contained_words(chunks, words).collect()}
    tails = lambda k: [str(k)[j:] for j in range(len(str(k))) if str(k)[j:] == str(int(str(k)[j:]))]
    heads = lambda k: [str(k)[:j] for j in range(1, len(str(k)) + 1)]
    assert got == {(k, f"{x}@") for k in range(300) for x in tails(k) if int(x) % 2 == 0} | {(k, f"Überlänge-{x}") for k in range(300) for x in heads(k) if int(x) % 3 == 0}
