"""The audit by rules alone: documents under their strategies → chunks → each check's rule → counts → states of files and tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..folders import saved
from ..operators import chunking, detect, fanout, rollup, scoring

#: What a finding keeps of its document, and of its chunk.
DOCUMENT = ["task_id", "doc_id", "file_name"]
PLACE = [*DOCUMENT, "chunk_idx", "strategy", "scan_item"]
SAID = ["problem_type", "sentence", "suggestion", "term"]
SPELLING, TYPOS, TERMS, SIGNS, GARBLED = "scanItem5001", "scanItem5002", "scanItem6001", "scanItem6002", "scanItem12009"
SENTENCES = r"(?<=[。？！.?!\n])"


@dataclass
class Knowledge:
    """What the rules go by: sensitive words (word), known English words (word), wrong and right forms (wrong, right), spellings of terms (term, variant), exempt terms (term)."""

    words: DataFrame
    lexicon: DataFrame
    pairs: DataFrame
    variants: DataFrame
    exempt: DataFrame


def chunks_of(docs: DataFrame, renditions: DataFrame, size: int = catalog.CHUNK_SIZE, archive_size: int = catalog.ARCHIVE_CHUNK_SIZE, split_lines: bool = True) -> DataFrame:
    """Chunks of documents (task_id, doc_id, file_name, scan_items, base_name, suffix, strategy, text), each under its own strategy, with what a finding keeps."""
    key = F.struct(*DOCUMENT, "scan_items").alias("doc_id")
    chunks = chunking.dispatch(docs.select(key, "base_name", "suffix", "strategy", "text"), renditions, size, archive_size, split_lines=split_lines)
    return chunks.select("doc_id.*", "chunk_idx", "chunk", "strategy")


def _said(rows: DataFrame, sentence: Column, suggestion: Column, term: Column, problem: Column | None = None) -> DataFrame:
    names = catalog.scan_items(rows.sparkSession).select(F.col("code").alias("scan_item"), F.col("name").alias("_name"))
    named = rows.join(F.broadcast(names), "scan_item") if problem is None else rows.withColumn("_name", problem)
    return named.select(*PLACE, F.col("_name").alias("problem_type"), sentence.alias("sentence"), suggestion.alias("suggestion"), term.alias("term"))


def rule_findings(work: DataFrame, known: Knowledge) -> DataFrame:
    """Findings of work items (…PLACE, chunk): every live check and the sensitive words by their rules; other checks find nothing.

    Spellings of a term are compared within a document, so such a finding has no chunk. Findings whose term is exempt, that
    suggest what is there already, or that are an address or a legal line, go.
    """
    of = lambda item: work.filter(F.col("scan_item") == item)
    none = F.lit(None).cast("string")
    key = F.struct(*PLACE).alias("doc_id")
    words = detect.detect_spelling(of(SPELLING).select(key, F.col("chunk").alias("text")), known.lexicon)
    spelling = _said(words.select("doc_id.*", "word"), F.col("word"), F.lit(""), F.col("word"))
    typos = _said(detect.detect_typos(of(TYPOS), known.pairs), F.col("wrong"), F.col("right"), F.col("wrong"))
    whole = F.struct(*[F.lit(-1).alias(c) if c == "chunk_idx" else F.lit("").alias(c) if c == "strategy" else F.col(c) for c in PLACE]).alias("doc_id")
    forms = detect.detect_term_variants(of(TERMS).select(whole, F.col("chunk").alias("text")), known.variants)
    terms = _said(forms.select("doc_id.*", F.col("term").alias("_term"), "variants"), F.col("variants"), F.lit(""), F.col("_term"))
    sentences = of(SIGNS).select(*PLACE, F.explode(F.split("chunk", SENTENCES)).alias("sentence"))
    signs = _said(detect.detect_unpaired(sentences).withColumnRenamed("sentence", "_s"), F.col("_s"), F.col("signs"), none)
    runs = detect.detect_garbled(of(GARBLED)).select(*PLACE, F.explode(F.array_distinct("runs")).alias("run"))
    garbled = _said(runs, F.col("run"), F.lit(""), F.col("run"))
    sensitive = detect.scan_sensitive_words(of(catalog.SENSITIVE_ITEM).drop("scan_item"), known.words)
    sensitive = _said(sensitive.withColumnsRenamed({"sentence": "_s", "suggestion": "_g"}), F.col("_s"), F.col("_g"), F.col("word"), F.lit(detect.SENSITIVE))
    every = spelling
    for part in (typos, terms, signs, garbled, sensitive):
        every = every.unionByName(part)
    told = detect.filter_exempt(every, known.exempt)
    return scoring.normalize(told).select(*PLACE, *SAID)


def states(found: DataFrame, tasks: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(materials, tasks): the counts of findings merged into the files (…, problem_counts) and summed into the tasks (…, status), with their messages. Findings in other tasks or files change no state."""
    files = rollup.material_status(rollup.merge_counts(materials, rollup.count_by_file(found)))
    of_task = files.groupBy(F.col("task_id").alias("_task")).agg(F.sum("problem_count").alias("_n"))
    counted = tasks.join(of_task, F.col("task_id").eqNullSafe(F.col("_task")), "left").withColumn("problem_count", F.coalesce("_n", F.lit(0))).drop("_n", "_task")
    return files, rollup.task_status(counted)


def rule_audit(docs: DataFrame, renditions: DataFrame, known: Knowledge, tasks: DataFrame, materials: DataFrame, folder: str | None = None, split_lines: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, materials, tasks): what the rules find, saved under `folder` if given, and states() by it. `split_lines` is chunks_of()'s."""
    work, _ = fanout.fan_out(chunks_of(docs, renditions, split_lines=split_lines), live_only=True)
    work = saved(work.select(*PLACE, "chunk"))  # six rules read it
    found = saved(rule_findings(work, known), folder and f"{folder}/findings")
    return found, *states(found, tasks, materials)
