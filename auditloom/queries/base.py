"""Registration of queries, and tables derived by SQL that Spark and the checking engine both understand."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Names in braces are tables; other braces stand for themselves."""
        names = set(re.findall(r"\{(\w+)\}", text))
        doubled = re.sub(r"\{\{(\w+)\}\}", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(doubled, **{n: self[n] for n in names})


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables under a name, with the SQL that gives the same rows."""

    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", oracle)
        return fn

    return keep
