"""Densities of empty, null and other odd texts, against their SQL."""

import math

import duckdb
import pytest

from auditloom import registry

TEXTS = ["", None, " ", ".", "a. b\nc. # <table>", "a " * 41 + " " * 558, "a \u000b b\t　\u0085c\f", "no\n\nmarks"]
DENSITIES = ["structure_marker_density", "information_density"]


@pytest.mark.parametrize("name", DENSITIES)
def test_densities(name, spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = {r.doc_id: r.density for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    want = dict(db.execute(registry.ORACLES[name]).fetchall())
    same = lambda a, b: a == b or None not in (a, b) and math.isnan(a) and math.isnan(b)
    assert got.keys() == want.keys() and [k for k in want if not same(got[k], want[k])] == []
