"""The pipeline's stages on a small corpus with known cases."""

import random

import pytest

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)] for lang, letters in (("en", "aehinorst"), ("de", "äcefghiknz"))}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    docs = [(k, text(lang, 120), lang) for k in range(60) for lang in [("en", "de")[k % 2]]]
    near = docs[10][1].split()
    near[5], near[60] = "changed", "twice"
    line, window = text("en", 20), text("en", 14)
    docs += [(100, docs[4][1], "en"), (101, " ".join(near), "en"), (102, text("en", 80) + "\n" + line, "en"), (103, text("en", 80) + "\n" + line + "x", "en"), (104, text("en", 60) + " " + window + " " + text("en", 60), "en"), (105, "12345 !!!", "en"), (106, None, "en"), (None, text("en", 90), "en")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, window)], "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs, ids, texts = spark.read.parquet(f"{corpus}/documents.parquet"), {}, {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        rows = docs.collect()
        ids[name], texts[name] = {r.doc_id for r in rows}, {r.doc_id: r.text for r in rows}
    clean = set(range(60)) | {None}
    assert ids["language_id"] == clean | {100, 101, 102, 103, 104}
    lines = texts["line_dedup"]
    assert lines[100] == "" and "\n" in lines[102] and "\n" not in lines[103] and ids["line_dedup"] == ids["language_id"]
    assert ids["simhash_near_dedup"] == ids["line_dedup"] - {101}
    assert ids["decontaminate"] == ids["simhash_near_dedup"] - {104}
    packed = corpus_pipeline.run(spark, corpus)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids["decontaminate"]
