"""Every query with SQL gives the rows that SQL gives."""

import os

import duckdb
import pytest

from auditloom import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(name, spark, db):
    mine = rows(registry.QUERIES[name](spark, SF_DIR).toPandas())
    assert mine == rows(db.execute(registry.ORACLES[name]).df())
    assert mine[1]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
