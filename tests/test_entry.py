"""The driver's entry points."""

import os

import pytest

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="the given tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
