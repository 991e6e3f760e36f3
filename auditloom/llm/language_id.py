"""Language identification by Bayesian evidence fusion.

Evidence of four kinds adds up in log space for each language: the text under byte-trigram models, the language that the
markup declares, and a prior by host. Priors come from grouped counts over all rows and are smoothed by level: a host's
counts lean on those of its address suffix, these on those of the whole table. How far a declaration can be trusted is
counted too, by declared language and what the texts themselves say. A background class of independent bytes competes
with the languages: where it wins, or no language is likely enough, the row isn't accepted.

Models are fitted on all labelled texts, as in the pipeline, or on a hashed sample of them, bounded for each label by
itself, so that no language is lost as the table grows; counts for priors cover every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batch, checkpoint, map_arrow, table
from .html_text import extract_text

BINS = 1 << 14
#: Documents of each label that its model is fitted on, about.
LABEL_DOCS = 5_000
#: Trigrams that count as independent evidence; more of them only sharpen what is already plain.
EVIDENCE_GRAMS = 200
#: Pseudo-counts of the levels: how many rows the level above is worth.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 5.0
LEAST_POSTERIOR = 0.5
#: Prior share of rows in no known language.
BACKGROUND_PRIOR = 0.02

_LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256)], np.uint8)


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte trigrams and the bytes themselves, lower-cased, with runs of other signs as one space."""
    b = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    if len(b) < 3:  # no letters
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    return _bin(b[:-2], b[1:-1], b[2:]), b


def _bin(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint32) * np.uint32(65599) + b) * np.uint32(65599) + c
    return (h ^ (h >> np.uint32(15))) % np.uint32(BINS)


def independent(share: np.ndarray, draws: int = 1 << 21) -> np.ndarray:
    """Log-probabilities of the bins for bytes that follow each other by chance, from a fixed draw, half mixed with even ones for letters never seen."""
    drawn = np.random.default_rng(0).choice(256, (3, draws), p=share)
    seen = np.bincount(_bin(*drawn), minlength=BINS) + 0.1
    return np.log(0.5 * seen / seen.sum() + 0.5 / BINS)


COUNTS = "language string, bin int, n bigint"


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", label_docs: int | None = LABEL_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities of trigrams by language, the same for the background), for every label whose documents have trigrams.

    They are fitted on about `label_docs` documents of each label, or on all if that is None. The counts come to the driver: BINS numbers a language at most.
    """
    label = F.col(label_col).cast("string")
    labelled = docs.filter(label.isNotNull()).withColumn("_label", label)
    if label_docs is not None:
        shares = labelled.groupBy("_label").agg(F.least(F.lit(1.0), label_docs / F.count("*")).alias("_share"))
        labelled = labelled.join(F.broadcast(shares), "_label")  # a row for each language, as the model has
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000_000)) < F.ceil(F.col("_share") * 1_000_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                bins, raw = trigrams(text.as_py())
                own = sums.setdefault(label, np.zeros(BINS + 256, np.int64))
                own[:BINS] += np.bincount(bins, minlength=BINS)
                own[BINS:] += np.bincount(raw, minlength=256)
            for label, own in sums.items():
                at = np.flatnonzero(own)
                yield batch(COUNTS, [[label] * len(at), at.astype(np.int32), own[at]])

    counted = map_arrow(labelled.select("_label", as_bytes(F.col(text_col))), run, COUNTS)
    rows = checkpoint(counted.groupBy("language", "bin").agg(F.sum("n").alias("n")))
    languages = sorted(r.language for r in rows.select("language").distinct().collect())
    counts, place = np.zeros((len(languages), BINS + 256)), {x: k for k, x in enumerate(languages)}
    for r in rows.toLocalIterator():
        counts[place[r.language], r.bin] = r.n
    grams, single = counts[:, :BINS] + 0.1, counts[:, BINS:].sum(axis=0) + 0.1
    return languages, np.log(grams / grams.sum(axis=1, keepdims=True)), independent(single / single.sum())


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """`rows` without the text, with `scores` (mean log-likelihood of a trigram by language, then background) and `grams`."""
    sent = rows.sparkSession.sparkContext.broadcast(np.vstack([model[1], model[2]]).astype(np.float32))  # BINS numbers a language
    others = [f for f in rows.schema.fields if f.name != text_col]
    schema = T.StructType([*others, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = sent.value
        for b in batches:
            scores, n = [], []
            for text in b.column(b.schema.get_field_index(text_col)):
                bins, _ = trigrams(text.as_py() or b"")
                n.append(len(bins))
                seen = np.bincount(bins, minlength=BINS)
                at = np.flatnonzero(seen)
                scores.append(((table_of[:, at] @ seen[at]) / max(1, len(bins))).tolist())
            kept = [b.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.list_(pa.float64())), pa.array(n, pa.int64())], names=schema.names)

    return map_arrow(rows.withColumn(text_col, as_bytes(F.col(text_col))), run, schema)


def _counts(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """For each value of `by`, an array of rows by what their text says."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("_said") == k, 1.0).otherwise(0.0)) for k in range(n)]).alias(name))


def _smoothed(counts: Column, above: Column, weight: float) -> Column:
    """Shares of an array of counts that lean on the shares above with a pseudo-count."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(above, lambda a, k: (F.coalesce(counts[k], F.lit(0.0)) + weight * a) / (F.coalesce(total, F.lit(0.0)) + weight))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keys: list[str]) -> DataFrame:
    """keys, declared, language, posterior and accepted for rows of (keys, text, declared, host, suffix).

    Nulls count as empty, in keys they stay; an empty declaration, host or suffix is a value like any other for the
    counts, so it carries the evidence that such rows have shown. A text without letters is not accepted and has language
    null. A tie goes to the language first in the alphabet. Without any model every text with letters is accepted, with
    language null: nothing speaks against it.
    """
    languages = model[0]
    n = len(languages)
    if not n:
        scored = text_scores(rows.select(*keys, "declared", "text"), model)
        return scored.select(*keys, "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), (F.col("grams") > 0).alias("accepted"))
    plain = rows.select(*keys, "text", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("declared", "host", "suffix")])
    plain = plain.withColumn("declared", F.regexp_extract("declared", "^[a-z]*", 0))
    scored = text_scores(plain, model)
    spoken = F.slice("scores", 1, n)
    scored = checkpoint(scored.withColumn("_said", F.when(F.col("grams") > 0, F.array_position(spoken, F.array_max(spoken)).cast("int") - 1)))
    known = scored.filter("_said is not null")
    overall = [x or 0.0 for x in _counts(known, [], n, "_all").first()._all]
    base = F.array(*[F.lit((x + 1) / (sum(overall) + n)) for x in overall])
    hosts = _counts(known, ["host", "suffix"], n, "_host")
    suffixes = _counts(known, ["suffix"], n, "_suffix")
    priors = hosts.join(suffixes, "suffix").select("host", "suffix", _smoothed(F.col("_host"), _smoothed(F.col("_suffix"), base, SUFFIX_WEIGHT), HOST_WEIGHT).alias("_prior"))
    priors = checkpoint(priors)  # so that the join below shuffles both sides, and a hot host can be split
    # What the rows with this declaration say, against what all rows say: how much it speaks for each language.
    trust = _counts(known, ["declared"], n, "_declared").select("declared", _smoothed(F.col("_declared"), base, DECLARED_WEIGHT).alias("_trust"))
    joined = scored.join(priors, ["host", "suffix"], "left").join(trust, "declared", "left")
    strength = F.least(F.col("grams"), F.lit(EVIDENCE_GRAMS)).cast("double")
    fused = F.transform(base, lambda b, k: strength * F.col("scores")[k] + F.log(F.coalesce(F.col("_prior")[k], b)) + F.log(F.coalesce(F.col("_trust")[k], b) / b) + math.log(1 - BACKGROUND_PRIOR))
    background = strength * F.col("scores")[n] + math.log(BACKGROUND_PRIOR)
    out = joined.select(*keys, "declared", "grams", F.concat(fused, F.array(background)).alias("_f"))
    best = F.array_max("_f")
    sums = F.aggregate(F.transform("_f", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    at = F.array_position("_f", best).cast("int")
    out = out.withColumns({"_at": at, "posterior": F.round(1 / sums, 6)})
    seen = (F.col("grams") > 0) & (F.col("_at") <= n)
    language = F.when(seen, F.element_at(F.array(*map(F.lit, languages)), F.least("_at", F.lit(n))))
    return out.select(*keys, "declared", language.alias("language"), F.when(F.col("grams") > 0, F.col("posterior")).otherwise(0.0).alias("posterior"), (seen & (F.col("posterior") >= LEAST_POSTERIOR)).alias("accepted"))


def document_evidence(docs: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Documents declare their `lang`; their `source` is the host."""
    return docs.select(*keys, "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare the html element's lang; host and suffix come from the address."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return extract_text(pages).select("page_id", "text", "declared", host.alias("host"), F.regexp_extract(host, "[^.]*$", 0).alias("suffix"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, each with the models fitted on documents and with priors of their own table."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    of_docs = identify(document_evidence(docs), model, ["doc_id"]).withColumn("page_id", F.lit(None).cast("bigint"))
    of_pages = identify(page_evidence(table(spark, sf_dir, "pages")), model, ["page_id"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    return of_docs.unionByName(of_pages).select("doc_id", "page_id", "declared", "language", "posterior", F.col("accepted").alias("kept"))
