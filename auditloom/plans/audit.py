"""The audit run: documents → chunks → work items → findings → counts, with and without a model that detects and reviews."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..folders import saved
from ..operators import answers, chunking, detect, fanout, rollup, scoring
from ..sources import readers
from . import rules

#: What a finding keeps of its work item, and what it says.
PLACE = ["task_id", "doc_id", "file_name", "chunk_idx", "scan_item", "strategy"]
SAID = ["problem_type", "sentence", "suggestion"]
#: What tells requests to the detector apart.
REQUEST = ("model", "system", "prompt", "settings")
Scorer = Callable[[pd.DataFrame], list[str]]


def sensitive_findings(docs: DataFrame, words: DataFrame, size: int = catalog.CHUNK_SIZE, overlap: int = catalog.OVERLAP) -> DataFrame:
    """Sensitive words of documents (task_id, doc_id, file_name, scan_items, text), in chunks, for those that ask for the check."""
    chunks = chunking.chunk_sliding(docs, size, overlap)
    work, _ = fanout.fan_out(chunks.filter(F.array_contains("scan_items", catalog.SENSITIVE_ITEM)), live_only=True)
    return detect.scan_sensitive_words(work.filter(F.col("scan_item") == catalog.SENSITIVE_ITEM).drop("scan_item"), words)


def audit_run(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Counts of findings by task, check and file, with totals."""
    return rollup.problem_totals(sensitive_findings(docs, words))


def detected_findings(docs: DataFrame, words: DataFrame, models: DataFrame, detector: Scorer, folder: str, renditions: DataFrame | None = None, known: rules.Knowledge | None = None, ruled: tuple[str, ...] = (), split_lines: bool = True, **bounds) -> DataFrame:
    """Findings (finding_id, …) of every check that a document asks for: sensitive words by rule, live checks by `detector`.

    With `renditions` each document is cut under its own strategy, as rules.chunks_of() does with `split_lines`, else in windows. With
    `known` the checks named in `ruled` go by their rules and not to the detector.
    Answers stay in the store under `folder`/answers: a run that is begun again in the same folder asks only for what has
    no answer. Requests without one, and answers that can't be read, are a table under `folder`/rejects with a reason.
    Equal findings of one chunk have equal ids.
    """
    chunks = chunking.chunk_sliding(docs) if renditions is None else rules.chunks_of(docs, renditions, split_lines=split_lines)
    work, _ = fanout.fan_out(chunks.withColumn("language", fanout.detect_language(F.col("file_name"))), live_only=True)
    sensitive = F.col("scan_item") == catalog.SENSITIVE_ITEM
    by_rule = F.col("scan_item").isin(*ruled) if known else F.lit(False)
    asked = scoring.build_requests(fanout.route(work.filter(~sensitive & ~by_rule), models))
    answers.ask(asked, detector, f"{folder}/answers", REQUEST, **bounds)
    got = saved(answers.answered(asked, f"{folder}/answers", REQUEST, tuple(PLACE)), f"{folder}/responses")
    found, unreadable = scoring.parse_responses(got)
    silent = got.filter("content is null").withColumn("reason", F.concat(F.lit("no answer: "), F.coalesce("error", F.lit("null"))))
    saved(silent.unionByName(unreadable.withColumn("reason", F.lit("no JSON array"))).drop("error"), f"{folder}/rejects")
    of_words = detect.scan_sensitive_words(work.filter(sensitive).drop("scan_item"), words)
    every = found.select(*PLACE, *SAID).unionByName(of_words.select(*PLACE, *SAID))
    if known:
        every = every.unionByName(rules.rule_findings(work.filter(by_rule & ~sensitive).select(*PLACE, "chunk"), known).select(*PLACE, *SAID))
    every = scoring.normalize(every)
    return saved(every.withColumn("finding_id", F.sha2(F.to_json(F.struct(*PLACE, *SAID)), 256)), f"{folder}/detected")


def reviewed_findings(detected: DataFrame, reviewer: Scorer, folder: str, **bounds) -> DataFrame:
    """The findings that stay after `reviewer` has answered a JSON object with a decision for each, and why (review).

    Equal findings are asked for once. Where the reviewer gave no answer at all the finding stays, unreviewed. Answers stay
    in a store as those of the detector do.
    """
    asked = scoring.build_review_requests(detected.dropDuplicates(["finding_id"]))
    answers.ask(asked, reviewer, f"{folder}/reviews", ("finding_id", "prompt"), **bounds)
    said = saved(answers.answered(asked, f"{folder}/reviews", ("finding_id", "prompt"), ("finding_id",)), f"{folder}/verdicts")
    verdicts = said.filter("content is not null").select("finding_id", F.from_json("content", "decision string, reason string").getField("decision").alias("decision"))
    return scoring.apply_review(detected, verdicts)


def reviewed_audit(docs: DataFrame, words: DataFrame, models: DataFrame, detector: Scorer, reviewer: Scorer, folder: str, **bounds) -> tuple[DataFrame, DataFrame]:
    """(findings before review, findings that stay) of documents (task_id, doc_id, file_name, scan_items, text).

    `folder` is seen by all executors, and is new or that of the same run that died. It gets both reports as CSV and, by
    task and check, what stays as JSON lines, once. `bounds` are those of answers.ask().
    """
    detected = detected_findings(docs, words, models, detector, folder, **bounds)
    final = saved(reviewed_findings(detected, reviewer, folder, **bounds), f"{folder}/final")
    readers.export_report(detected, f"{folder}/detected-csv")
    readers.export_report(final, f"{folder}/final-csv")
    readers.commit_findings(final, f"{folder}/final-json", "final")
    return detected, final
