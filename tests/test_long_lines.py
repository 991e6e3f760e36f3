"""Queries whose SQL packs whole lines, on documents with lines of about a chunk's length and above."""

import os

import duckdb
import pytest

from auditloom import registry
from tests.test_queries import SF_DIR, TABLES, rows

LONG = ["chunk_paragraphs", "chunk_stats", "chunk_quality_by_strategy", "chunk_length_quantiles", "chunk_dispatch", "rule_audit", "rule_audit_states", "mixed_audit"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "documents" and os.path.exists(f"{SF_DIR}/{t}.parquet"):
            os.symlink(f"{SF_DIR}/{t}.parquet", out / f"{t}.parquet")
    lines = ["x" * 1999, "y" * 2000, "z" * 2001, "a,b。" * 900, "w" * 9000 + "a????b帐号(", "short", "v" * 3000, "u" * 8000]
    texts = [(1_000_000 + k, "\n".join([*lines[k % 8 :], *lines[: k % 8]][: 1 + k % 5]), "en", "s", 1) for k in range(60)]
    db = duckdb.connect()
    db.execute("CREATE TABLE extra (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO extra VALUES (?, ?, ?, ?, ?)", texts)
    db.execute(f"COPY (SELECT * FROM '{SF_DIR}/documents.parquet' WHERE doc_id < 40 UNION ALL BY NAME SELECT * FROM extra) TO '{out}/documents.parquet' (FORMAT parquet)")
    return out


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables aren't here")
@pytest.mark.parametrize("name", LONG)
def test_long_lines(name, spark, folder):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(folder / f"{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, str(folder)).toPandas()) == rows(db.execute(registry.ORACLES[name]).df())
