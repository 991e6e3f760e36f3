"""Reading uploaded files, office items, findings and tables; writing reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..folders import file_system
from ..operators.layout import compact_rows

# Suffixes that can be read, and encodings in the order that they are tried.
READABLE = ["xlsx", "xls", "chm", "pdf", "docx", "pptx", "md"]
ENCODINGS = ["utf-8", "gbk", "gb2312", "big5", "latin1"]
FINDING_SCHEMA = "finding_id bigint, task_id bigint, seq bigint, file_name string, problem_type string, scan_item string, sentence string, suggestion string, strategy string"
#: Column names at the edges, as reports have them.
REPORT_NAMES = {"file_name": "文档名称", "problem_type": "问题类型", "sentence": "问题所在句子", "suggestion": "修改建议"}


def route_files(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds the reader for each file by its suffix; others have a reason for being rejected."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    kind = F.when(suffix.isin("xlsx", "xls"), "sheets").when(suffix == "pptx", "slides").when(suffix.isin(*READABLE), suffix)
    return files.withColumns({"reader": kind, "reason": F.when(kind.isNull(), F.concat(F.lit("cannot read ."), suffix))})


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text files under a path whole, as (path, file_name, text), and rejected files with a reason. CRLF becomes LF; Spark gives no row for an empty file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1))
    routed = route_files(files)
    text = F.col("content").cast("string")
    routed = routed.withColumn("_good", F.coalesce(F.col("reader") == "md", F.lit(False)) & F.is_valid_utf8(text))
    good = routed.filter("_good").select("path", "file_name", F.replace(text, F.lit("\r\n"), F.lit("\n")).alias("text"))
    reason = F.coalesce("reason", F.when(F.col("reader") == "md", "not UTF-8").otherwise(F.concat(F.lit("needs extracted rows: "), "reader")))
    return good, routed.filter("not _good").select("path", "file_name", reason.alias("reason"))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each content of (name, content binary) as a file of that name under a folder that all executors see, and returns how many. A task that runs again writes the same files anew; null contents are empty files."""
    root = folder if "://" in folder else re.sub("^(file:)?/*", "file:///", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(*b.columns, strict=True):
                with store.open_output_stream(f"{base}/{name.as_py()}") as out:
                    out.write(content.as_py() or b"")
            yield b.select(["name"])

    return files.select("name", "content").mapInArrow(run, "name string").count()


def read_stored_table(spark: SparkSession, url: str, table: str, key: str, rows_a_part: int = 1_000_000, **properties: str) -> DataFrame:
    """A table of a database, read in ranges of an integer key by as many connections as its span of keys asks for, one a task. An empty table has one range; rows with a null key are in the first."""
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = spark.read.jdbc(url, f"(SELECT min({quoted}) AS low, max({quoted}) AS high FROM {table}) ends", properties=properties).toDF("low", "high").first()
    if ends.low is None:
        return spark.read.jdbc(url, table, properties=properties)
    low, high = int(ends.low), int(ends.high)
    parts = -(-(high - low + 1) // rows_a_part)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=properties)


@F.pandas_udf(StringType())
def decode_chain(raw: pd.Series) -> pd.Series:
    """Text under the first encoding that fits; the last always does."""

    def one(b: bytes | None) -> str | None:
        for name in ENCODINGS if b is not None else ():
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return raw.map(one)


def in_order(order: list[str], value: Column, by: list[str], rows: DataFrame, name: str = "text") -> DataFrame:
    """Values joined by line breaks in order, one row for each `by`."""
    parts = F.sort_array(F.collect_list(F.struct(*order, value.alias("_v"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["_v"]), "\n").alias(name), F.count("*").alias("parts"))


def decode_html_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, text, parts): the files (doc_id, path, content) of a help archive, decoded and joined by path. Tags stay."""
    return in_order(["path"], F.col("_text"), ["doc_id"], files.withColumn("_text", decode_chain("content")))


def assemble_sheet_text(cells: DataFrame) -> DataFrame:
    """(doc_id, text, sheets) of (doc_id, sheet_idx, col_idx, row_idx, value): column by column, without the header row 0 and empty cells."""
    sheets = cells.groupBy("doc_id").agg(F.count_distinct("sheet_idx").alias("sheets"))
    text = in_order(["sheet_idx", "col_idx", "row_idx"], F.col("value"), ["doc_id"], cells.filter("row_idx > 0 and value is not null"))
    return sheets.join(text.drop("parts"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def item_text(items: DataFrame) -> DataFrame:
    """Items (kind, text, rows) with what they say: a stripped paragraph, or a table as one line of JSON; empty ones go."""
    said = F.when(F.col("kind") == "table", compact_rows(F.col("rows"))).otherwise(F.trim("text"))
    return items.withColumn("said", said).filter("said <> ''")


def assemble_slide_text(items: DataFrame) -> DataFrame:
    """(doc_id, text, parts) of slide items, in order of slide, shape and place."""
    return in_order(["slide", "shape", "pos"], F.col("said"), ["doc_id"], item_text(items))


def assemble_docx_text(items: DataFrame) -> DataFrame:
    """(doc_id, text, parts) of word-processor items: all paragraphs first, then all tables."""
    late = (F.col("kind") == "table").cast("int")
    return in_order(["_late", "pos"], F.col("said"), ["doc_id"], item_text(items).withColumn("_late", late))


def load_sensitive_words(*lists: DataFrame, keep_nan: bool = False) -> DataFrame:
    """Different words of one-column lists as text. Blank cells go, or become the word 'nan'."""
    words = None
    for x in lists:
        column = x.select(F.col(x.columns[0]).cast("string").alias("word"))
        words = column if words is None else words.unionByName(column)
    words = words.withColumn("word", F.coalesce("word", F.lit("nan"))) if keep_nan else words.filter("word is not null and trim(word) <> ''")
    return words.distinct()


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of findings with their schema given."""
    return spark.read.schema(FINDING_SCHEMA).json(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Appends JSON lines under a folder for each task and check."""
    findings.write.partitionBy("task_id", "scan_item").mode("append").json(path)


def commit_findings(findings: DataFrame, path: str, unit: str) -> bool:
    """Appends the findings of one unit of work, a name, once: False if they are there already.

    An attempt writes to a folder of its own, which readers don't look at until a note of the unit names it. The note is
    made only if there is none, so an attempt that dies leaves nothing to be read, and of two attempts one counts.
    """
    spark = findings.sparkSession
    fs, at = file_system(spark, f"{path}/_manifest/{unit}")
    if unit in committed_units(spark, path):
        return False
    attempt = f"{unit}-{uuid.uuid4().hex}"
    findings.write.partitionBy("task_id", "scan_item").json(f"{path}/attempt={attempt}")
    if fs.exists(at) and not fs.getFileStatus(at).getLen():
        fs.delete(at, False)  # cut off by an attempt that died
    try:
        out = fs.create(at, False)
    except Py4JJavaError:
        if not fs.exists(at):
            raise
        return False
    out.write(bytearray(attempt.encode()))
    out.close()
    return True


def committed_units(spark: SparkSession, path: str) -> dict[str, str]:
    """The attempt that counts for each unit."""
    fs, at = file_system(spark, f"{path}/_manifest")
    if not fs.exists(at):
        return {}
    out = {}
    for f in fs.listStatus(at):
        if f.getLen():  # a note without a word was cut off: its unit has not been committed
            note = fs.open(f.getPath())
            out[f.getPath().getName()] = bytes(note.readNBytes(int(f.getLen()))).decode()
            note.close()
    return out


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The findings of all units that were committed."""
    attempts = committed_units(spark, path).values()
    schema = FINDING_SCHEMA + ", attempt string"
    if not attempts:
        return spark.createDataFrame([], schema).drop("attempt")
    return spark.read.schema(schema).option("basePath", path).json([f"{path}/attempt={a}" for a in sorted(attempts)]).drop("attempt")


def export_report(findings: DataFrame, path: str) -> None:
    """CSV with a header and the reports' own column names, in as many files as there are partitions."""
    named = findings.select(*[F.col(c).alias(REPORT_NAMES.get(c, c)) if t != "struct" else F.to_json(c).alias(c) for c, t in findings.dtypes])
    named.write.mode("overwrite").csv(path, header=True, escape='"')


def load_task_tables(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """Tasks with their materials: a row for each material, and one with nulls for a task without any. Columns of the same name are the task's."""
    extra = [c for c in materials.columns if c == "task_id" or c not in tasks.columns]
    return tasks.join(materials.select(*extra), "task_id", "left")


def document_summary(docs: DataFrame) -> DataFrame:
    """Characters and parts of each document and, with doc_id null, of each task: (task_id, doc_id, text, parts)."""
    sizes = docs.select("task_id", "doc_id", F.length("text").cast("bigint").alias("words"), F.col("parts").cast("bigint").alias("parts"))
    return sizes.groupingSets([["task_id", "doc_id"], ["task_id"]], "task_id", "doc_id").agg(F.sum("words").alias("words"), F.sum("parts").alias("parts"))


def batches_of(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames cut to at most `rows` rows."""
    for f in frames:
        for k in range(0, len(f), rows):
            yield f.iloc[k : k + rows]
