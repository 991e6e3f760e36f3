"""Quality of chunks and of detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import contained_pairs
from .reports import dedupe_findings

#: Size of a sketch of lengths, and the rank error that goes with it.
SKETCH, RANK_ERROR = 1000, 0.005
MARKERS = ["# ", "<table>", "<tr>", "- ", "!["]
# Signs that end a sentence, and signs that no chunk should begin with.
ENDS, NO_START = r"[。？！.?!\"…]", r"[,.;:!?，。；：！？、)\]}）】》」』”’a-z]"


def marker_density(text: Column, markers: list[str] | None = None, empty: float = 0.0) -> Column:
    """Structure markers in a thousand characters; an empty text has the value `empty`, a null one null."""
    total = F.lit(0.0)
    for m in markers or MARKERS:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    return F.when(F.length(text) > 0, total / F.length(text) * 1000).when(F.length(text) == 0, empty)


def information_density(text: Column, empty: float = 0.0, white: str = r"(?U)\s") -> Column:
    """Share of characters that aren't `white` space; an empty text has the value `empty`, a null one null."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, white, "")) / F.length(text)).when(F.length(text) == 0, empty)


def valid_end(text: Column) -> Column:
    return text.rlike(rf"(?U)(?:{ENDS}|</table>)\s*$")


def valid_start(text: Column) -> Column:
    return text.rlike(r"(?U)\S") & ~text.rlike(rf"(?U)^\s*{NO_START}")


def fragmented(text: Column) -> Column:
    """Whether tables open and close a different number of times."""
    count = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    return count("<table") != count("</table>")


def chunk_quality(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """One row for each strategy: densities, rates of whole chunks and tables, and lengths. Partial aggregates, then as many rows as strategies meet."""
    c, share = F.col("chunk"), lambda cond: F.avg(cond.cast("double"))
    median = F.percentile("length", 0.5) if exact else F.percentile_approx("length", 0.5).cast("double")
    return chunks.groupBy("strategy").agg(
        F.count("*").alias("chunks"), F.avg("length").alias("mean_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), median.alias("median_length"),
        F.avg(marker_density(c)).alias("marker_density"), F.avg(information_density(c)).alias("information_density"),
        share(valid_start(c)).alias("valid_start"), share(valid_end(c)).alias("valid_end"), share(valid_start(c) & valid_end(c)).alias("intact"), share(fragmented(c)).alias("fragmented"),
    )


def length_sketches(chunks: DataFrame, by: tuple[str, ...] = ("strategy",), k: int = SKETCH) -> DataFrame:
    """(…by, sketch): the lengths of each group as a sketch of bounded size, which can be stored and merged."""
    return chunks.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col("length").cast("bigint"), F.lit(k)).alias("sketch"))


def length_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), by: tuple[str, ...] = ("strategy",), k: int = SKETCH) -> DataFrame:
    """(…by, n, quantile, length) of merged sketches: a length whose rank is within RANK_ERROR of the quantile, for about 99 of 100."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))
    asked = F.array(*[F.lit(q) for q in quantiles])
    each = F.explode(F.arrays_zip(asked.alias("quantile"), F.kll_sketch_get_quantile_bigint("sketch", asked).alias("length")))
    return merged.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), each.alias("x")).select(*by, "n", "x.quantile", "x.length")


def match_ground_truth(truth: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("experiment", "file_name")) -> DataFrame:
    """(…keys, gt_id, finding_id): the injected text lies in the sentence, and the correction, or one of the keywords, in the suggestion.

    Which text lies in which sentence is found once for different texts, by a join on the text's rarest gram. Null keys,
    texts and sentences match nothing.
    """
    keys = list(keys)
    lies = contained_pairs(truth.withColumnRenamed("injected_text", "needle"), findings.withColumnRenamed("sentence", "text"), keys)
    lies = lies.select(*keys, F.col("needle").alias("injected_text"), F.col("text").alias("sentence"))
    keywords = F.coalesce(F.col("keywords") if "keywords" in truth.columns else F.lit(None), F.array().cast("array<string>")).alias("_keywords")
    sought = truth.select(*keys, "injected_text", "gt_id", F.col("expected_correction").alias("_correction"), keywords)
    given = findings.select(*keys, "sentence", "finding_id", F.col("suggestion").alias("_suggestion"))
    said = F.contains("_suggestion", F.col("_correction")) | F.exists("_keywords", lambda w: F.contains(F.col("_suggestion"), w))
    return sought.join(lies, [*keys, "injected_text"]).join(given, [*keys, "sentence"]).filter(said).select(*keys, "gt_id", "finding_id")


def detection_metrics(truth: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("experiment", "file_name")) -> DataFrame:
    """Recall, precision, F1 and false positive rate of each experiment; precision over findings without repetitions. Nothing to divide by gives 0."""
    report = dedupe_findings(findings, ("experiment", "file_name", "scan_item", "sentence", "suggestion"))
    matches = match_ground_truth(truth, report, keys).groupBy("experiment").agg(F.count_distinct("gt_id").alias("found"), F.count_distinct("finding_id").alias("right"))
    wanted = truth.groupBy("experiment").agg(F.count_distinct("gt_id").alias("truth"))
    given = report.groupBy("experiment").agg(F.count("*").alias("reported"))
    all_ = wanted.join(given, "experiment", "full").join(matches, "experiment", "left").na.fill(0, ["truth", "reported", "found", "right"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = all_.withColumns({"recall": ratio(F.col("found"), F.col("truth")), "precision": ratio(F.col("right"), F.col("reported"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumns({"f1": F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0), "fpr": 1 - F.col("precision")})


def redundancy(findings: DataFrame) -> DataFrame:
    """Share of each experiment's findings that repeat others."""
    raw = findings.groupBy("experiment").agg(F.count("*").alias("raw"))
    left = dedupe_findings(findings, ("experiment", "file_name", "scan_item", "sentence", "suggestion")).groupBy("experiment").agg(F.count("*").alias("different"))
    return raw.join(left, "experiment").withColumn("redundancy", (F.col("raw") - F.col("different")) / F.col("raw"))


def parse_experiment(name: Column) -> tuple[Column, Column]:
    """Strategy and mode of a name such as 'adaptive + dual-agent'; a missing mode is ''."""
    parts = F.split(name, r"\s*\+\s*", 2)
    return F.trim(parts[0]), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def best_runs(metrics: DataFrame, by: tuple[str, ...] = ("strategy", "mode")) -> DataFrame:
    """The run with the highest F1 of each configuration, then the first by name; a run without F1 only where no run has one."""
    best = F.min_by(F.struct(*metrics.columns), F.struct(F.col("f1").isNull(), -F.col("f1"), F.col("experiment").isNull(), "experiment")).alias("_best")
    return metrics.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(best).select("_best.*")


def dataset_stats(docs: DataFrame) -> DataFrame:
    """Pages, characters and errors of each file, and of all with file_name null."""
    return docs.rollup("file_name").agg(F.sum("pages").alias("pages"), F.sum("characters").alias("characters"), F.sum("errors").alias("errors"))


def error_types(truth: DataFrame) -> DataFrame:
    return truth.groupBy("error_type").agg(F.count("*").alias("n"))
