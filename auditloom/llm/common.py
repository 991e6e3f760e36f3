"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import shared_folder

#: Rows in one Arrow batch of texts. Spark also closes a batch at spark.sql.execution.arrow.maxBytesPerBatch.
TEXT_BATCH_ROWS = 1000
#: Bytes of texts that numpy works on at once.
BYTES_AT_ONCE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session already sets its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set to shared_folder() if it has none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in checkpoint_folder()."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def groups_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BYTES_AT_ONCE bytes, or of one longer text; one empty run of none."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BYTES_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    yield group


def as_bytes(col: Column) -> Column:
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches of a bounded number of rows."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Arrow types of the columns that the operators return.
ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
    "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<tinyint>": pa.list_(pa.int8()),
}


def batch(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of the columns for a schema such as 'a bigint, b string'."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in a new folder under the checkpoint folder: smaller than a checkpoint where rows are many."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of written() that no plan reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find shuffles that no live plan needs; it only looks after the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()
