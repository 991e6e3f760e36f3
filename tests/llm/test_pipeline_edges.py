"""Each stage on empty tables, repeated rows, ties, nulls and columns of clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import language_id

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _id int, _kept int, node bigint, key string, row bigint"


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, None), (2, ""), (3, "never here at all")], "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def text(seed, n=90):
    r = random.Random(seed)
    words = ["".join(r.choice("aehinorst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


def rows(*docs):
    return [(i, t, lang, "s", len(t or ""), "k", 1, 2, 3, "x", 4) for i, t, lang in docs]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_table(spark, bench, stage):
    out = stage[1](spark, spark.createDataFrame([], DOCS), bench)
    assert out.count() == 0
    if stage != corpus_pipeline.STAGES[-1]:
        assert out.columns == spark.createDataFrame([], DOCS).columns


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_nulls_repeated_rows_and_clashing_columns(spark, bench, stage):
    clean = [(k, text(k), "en") for k in range(12)]
    odd = [(None, text(50), "en"), (None, text(51), None), (3, text(52), "en"), (60, None, None), (61, "", "en")]
    again = [(70, text(70), "en")] * 3
    df = spark.createDataFrame(rows(*clean, *odd, *again), DOCS).repartition(3)
    out = stage[1](spark, df, bench)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert {r._key for r in out.select("_key").collect()} == {"k"}
    assert {d[:2] for d in clean} <= set(got), "clean documents stay"
    assert {(None, text(50)), (3, text(52))} <= set(got), "rows that share an id, or have none, are told apart"
    # Of rows that repeat the near-duplicate stage keeps one; the others keep or change each of them alike.
    assert got.count((70, text(70))) == (1 if stage[0] == "simhash_near_dedup" else 3)


def test_ties_of_equal_texts(spark, bench):
    name, stage = corpus_pipeline.STAGES[2]
    df = spark.createDataFrame(rows((9, text(1), "en"), (4, text(1), "en"), (7, text(1), "en"), (5, text(2), "en")), DOCS)
    assert name == "simhash_near_dedup"
    assert sorted(r.doc_id for r in stage(spark, df, bench).collect()) == [4, 5]


def test_language_models_are_fitted_on_all_documents(spark, bench, monkeypatch):
    models, identify = [], language_id.identify
    monkeypatch.setattr(language_id, "identify", lambda rows, model, keys: (models.append(model), identify(rows, model, keys))[1])
    n, every = 2 * language_id.LABEL_DOCS, 500
    said = F.when(F.col("id") % every == 3, "the rare one").otherwise("many of these")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), said.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars")).repartition(3)
    assert corpus_pipeline.keep_known_languages(spark, docs, bench).count() == n
    counts = Counter()
    for text, times in ((b"the rare one", n // every), (b"many of these", n - n // every)):
        for b in language_id.trigrams(text)[0].tolist():
            counts[b] += times
    want = np.array([counts[b] + 0.1 for b in range(language_id.BINS)])
    assert models[0][0] == ["en"] and np.allclose(models[0][1][0], np.log(want / want.sum()), rtol=0, atol=1e-9)
