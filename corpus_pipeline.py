"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.folders import shared_folder
from auditloom.llm import decontaminate, language_id, line_dedup, packing, simhash
from auditloom.llm.common import table

NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks in front as it takes not to be a column of `docs`."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, or in no language of the labelled ones, go. Models are fitted on all of them.

    Rows that share an id are told apart by a hash of all their columns, so only equal rows share the fate of one. An
    empty table stays empty.
    """
    key, its_id, its_key = _free_names(docs, "_key", "_id", "_kept")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    evidence = language_id.document_evidence(keyed.select("doc_id", "text", "lang", "source", F.col(key).alias("_key")), ["doc_id", "_key"])
    found = language_id.identify(evidence, language_id.fit(docs, label_docs=None), ["doc_id", "_key"]).filter("accepted").select(F.col("doc_id").alias(its_id), F.col("_key").alias(its_key))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found[its_id]) & (keyed[key] == found[its_key]), "left_semi").drop(key)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of equal or near lines the first in the corpus stays; documents all stay."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of similar documents one stays, the one with the least doc_id."""
    return simhash.drop_similar(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack_best_fit", pack_sequences),
]

#: The stages aren't SQL; their operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between stages lie in the folder that spark.checkpoint.dir names."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
