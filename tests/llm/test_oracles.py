"""The SQL of the operators against their queries, on small tables in the given layout."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from auditloom.llm import registry


def test_oracles_are_sql():
    assert all(isinstance(x, str) and "SELECT" in x for x in entry.oracle_sql().values())
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(17), str(tmp_path_factory.mktemp("tables"))
    text = lambda n: "".join(r.choice(["a", "b", "É", "7 ", " ", ", ", "\n", "Cd"]) for _ in range(n))
    shared, window = text(260), text(60)
    docs = [(k, r.choice(["", shared, shared[20:240]]) + text(r.randint(0, 300)) + r.choice(["", window, shared])) for k in range(40)]
    docs += [(60, docs[3][1]), (61, docs[3][1] + " "), (62, None), (63, ""), (64, "z" * 2500), (65, text(1500) + shared)]
    items = [(k, r.choice([window, text(15), text(4), None, shared])) for k in range(9)]
    turns = [(k // 4, r.choice([k % 4, 1]), r.choice(["user", "assistant", "system", "tool<s>", None]), r.choice([None, "<s>x", "<a>", "[INST]", "</s>[OUT]", text(9)])) for k in range(60)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    vectors = [(k % 700 if k % 50 else None, [r.choice([0.5, -0.25, 0.013, r.random()]) for _ in range(6)], r.choice([0, 1, 1, 1, 4, 9])) for k in range(900)]
    vectors += [(1400, None, 1), (1401, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (1402, [float("nan")] * 6, 2), (1403, [float("-inf")] * 6, 2), (1500, [0.5] * 6, None)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = registry.QUERIES[name](spark, folder)
    want = db.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert set(names) == set(found.columns)
    assert sorted(map(repr, map(tuple, found.select(names).collect()))) == sorted(map(repr, want.fetchall()))
