"""Requests to a model, its answers, and the review of findings. The model is a callable of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog

BATCH, TRIES, MOST_TOKENS = 20, 3, 8192
THINK_PREFIX = "<think>\n\n<think>\n\n"
ANSWER = "array<struct<`文档名称`:string,`问题类型`:string,`问题所在句子`:string,`修改建议`:string>>"


def build_requests(work: DataFrame, exempt_terms: list[str] | None = None) -> DataFrame:
    """Adds system, prompt and settings to work items (file_name, scan_item, instruction, chunk). The rule comes from the catalogue."""
    rules = F.broadcast(catalog.scan_items(work.sparkSession).select(F.col("code").alias("scan_item"), "rule"))
    prompt = F.concat_ws("\n", F.concat(F.lit("file: "), "file_name"), F.concat(F.lit("check: "), "scan_item"), F.concat(F.lit("rule: "), "rule"), F.concat(F.lit("instruction: "), "instruction"), F.lit("exempt: " + ", ".join(exempt_terms or [])), F.lit("answer: JSON array; [] if there is nothing"), F.col("chunk"))
    settings = F.to_json(F.struct(F.lit(0.1).alias("temperature"), F.lit(1).alias("top_p"), F.lit(MOST_TOKENS).alias("max_tokens")))
    return work.join(rules, "scan_item").withColumns({"system": F.lit("You report only errors that are certain."), "prompt": prompt, "settings": settings})


def score(requests: DataFrame, fn: Callable[[pd.DataFrame], list[str]], partitions: int | None = None, batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """Adds content and error by calling fn on batches of rows; a batch that fails `tries` times has null content.

    `partitions` bounds how many calls run at once. Save the result before using it twice: a lost stage calls again.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in [*requests.dtypes, ("content", "string"), ("error", "string")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch].copy()
                content, error = [None] * len(part), None
                for _ in range(tries):
                    try:
                        content, error = list(fn(part)), None
                        break
                    except Exception as e:  # the user's callable may fail in any way
                        error = f"{type(e).__name__}: {e}"
                yield part.assign(content=content, error=error)

    spread = requests.repartition(partitions) if partitions else requests
    return spread.mapInPandas(run, schema)


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of answers (…, content), and the answers that are no JSON array. Prefix and code fence go first; an empty answer gives nothing."""
    prefix = F.when(F.startswith("content", F.lit(THINK_PREFIX)), F.substring("content", len(THINK_PREFIX) + 1, 1 << 30)).otherwise(F.col("content"))
    bare = F.trim(F.regexp_replace(prefix, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    read = responses.withColumn("_bare", bare).filter("_bare is not null and _bare <> ''")
    read = read.withColumn("_list", F.when(F.startswith("_bare", F.lit("[")), F.from_json("_bare", ANSWER)))
    bad = F.col("_list").isNull() | F.exists("_list", lambda x: x.isNull())
    good = read.filter(~bad).withColumn("_f", F.explode("_list"))
    names = {"problem_type": "问题类型", "sentence": "问题所在句子", "suggestion": "修改建议"}
    found = good.withColumns({n: F.col("_f").getField(c) for n, c in names.items()}).drop("_f", "_list", "_bare", "content")
    return found, read.filter(bad).drop("_list", "_bare")


def normalize(findings: DataFrame) -> DataFrame:
    """Missing texts become ''; the strategy of chunks without one is the fixed one."""
    empty = {c: F.coalesce(c, F.lit("")) for c in ("problem_type", "sentence", "suggestion")}
    return findings.withColumns(empty | {"strategy": F.coalesce("strategy", F.lit("baseline_fixed"))})


def build_review_requests(findings: DataFrame) -> DataFrame:
    """A request for each finding that is no sensitive word: what was found, under which rule."""
    rules = F.broadcast(catalog.scan_items(findings.sparkSession).select(F.col("code").alias("scan_item"), F.col("name").alias("item_name"), "rule"))
    kind = F.when(F.col("strategy").contains("adaptive_markdown"), "markdown").otherwise("extraction")
    prompt = F.concat_ws("\n", F.concat(F.lit("check: "), "item_name"), F.concat(F.lit("rule: "), "rule"), F.concat(F.lit("instruction: "), kind), F.concat(F.lit("sentence: "), F.coalesce("sentence", F.lit(""))), F.concat(F.lit("suggestion: "), F.coalesce("suggestion", F.lit(""))), F.lit("decision: True or False"))
    return findings.filter(F.col("scan_item") != catalog.SENSITIVE_ITEM).join(rules, "scan_item").withColumn("prompt", prompt)


def apply_review(findings: DataFrame, verdicts: DataFrame, mode: str = "dual-agent") -> DataFrame:
    """Adds review to the findings that stay: confirmed by exactly 'True', unreviewed without a verdict, bypassed for sensitive words. Other verdicts drop them."""
    if mode == "detector-only":
        return findings.withColumn("review", F.lit("skipped"))
    sensitive = F.col("scan_item") == catalog.SENSITIVE_ITEM
    said = verdicts.select("finding_id", F.struct("decision").alias("_v"))
    judged = findings.filter(~sensitive).join(said, "finding_id", "left")
    kept = judged.filter(F.col("_v").isNull() | (F.col("_v.decision") == "True")).withColumn("review", F.when(F.col("_v").isNull(), "unreviewed").otherwise("confirmed")).drop("_v")
    return kept.unionByName(findings.filter(sensitive).withColumn("review", F.lit("bypassed")))
