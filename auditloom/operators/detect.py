"""Rule checks on chunks and documents: words, pairs, spelling, variants, punctuation, garbling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from . import patterns

#: Words up to which they become part of the expression; words and bytes of a table that is sent to every worker.
INLINE_WORDS, TABLE_WORDS, TABLE_BYTES = 48, 1_000_000, 32 << 20
#: Words of a lexicon up to which it is broadcast.
BROADCAST_WORDS = 2_000_000
SENSITIVE = "敏感词"
# Pairs of opening and closing signs, signs that stand for themselves, and signs of broken encodings.
PAIRS = [("“", "”"), ("‘", "’"), ("《", "》"), ("(", ")"), ("（", "）")]
SAME = ['"']
GARBLED = r"(Åäö|\?{2,}|â‚¬|□{2,}|锟斤拷|\x{FFFD}+)"


def contained_words(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each chunk and different word that it contains, case counting; empty words are ignored.

    Few words are matched by an expression, many by a table that each worker builds once, in one scan of the chunks.
    More than such a table may hold are told by a bitmap of their hashes, and joined with what it lets pass.
    """
    usable = words.select("word").filter("word is not null and word <> ''").distinct()
    first = usable.limit(INLINE_WORDS + 1).collect()
    if len(first) <= INLINE_WORDS:
        listed = F.array(*[F.lit(r.word) for r in sorted(first)]) if first else F.array().cast("array<string>")
        return chunks.withColumn("word", F.explode(F.filter(listed, lambda w: F.contains(F.col("chunk"), w))))
    size = usable.agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    if size.n <= TABLE_WORDS and size.bytes <= TABLE_BYTES:
        return _by_table(chunks, [r.word for r in usable.collect()])
    return _by_filter(chunks, usable, size.n)


def scan_sensitive_words(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """A finding for each chunk and word that it contains."""
    return contained_words(chunks, words).withColumns({
        "problem_type": F.lit(SENSITIVE), "scan_item": F.lit(catalog.SENSITIVE_ITEM), "sentence": F.concat(F.lit("检测到敏感词："), "word"), "suggestion": F.lit("请确认是否需要替换或删除"),
    })


#: The table of the last broadcast in this worker.
_tables: dict[int, patterns.WordTable] = {}


def _by_table(chunks: DataFrame, words: list[str]) -> DataFrame:
    sent = chunks.sparkSession.sparkContext.broadcast(sorted(words))
    name = sent._jbroadcast.id()
    at = chunks.columns.index("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:
            _tables.clear()
            _tables[name] = patterns.WordTable(sent.value)
        given = pa.array(sent.value, pa.string())
        for b in batches:
            row, word = patterns.find_words(b.column(at), _tables[name])
            found = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*found.columns, given.take(pa.array(word))], names=[*found.schema.names, "word"])

    return chunks.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*chunks.dtypes, ("word", "string")]))


def _by_filter(chunks: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Each chunk's runs that may be words, joined with `n` different words. The driver holds no more than the bitmap."""
    lengths = sorted(r[0] for r in words.select(F.octet_length("word")).distinct().collect())
    bits = patterns.filter_bits(n)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = patterns.word_places(b.column(0), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> patterns.SHARE).astype("int32")), pa.array(at & (1 << patterns.SHARE) - 1)], names=["share", "place"])

    bitmap, each = bytearray(1 << bits - 3), 1 << patterns.SHARE - 3
    for r in words.mapInArrow(places, "share int, place bigint").groupBy("share").agg(F.bitmap_construct_agg("place").alias("bits")).collect():
        bitmap[r.share * each : (r.share + 1) * each] = r.bits
    sent = chunks.sparkSession.sparkContext.broadcast((lengths, bits, bytes(bitmap)))
    at = chunks.columns.index("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = patterns.WordFilter(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, patterns.possible_words(b.column(at), table)], names=[*b.schema.names, "word"])

    possible = chunks.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*chunks.dtypes, ("word", "array<string>")]))
    return possible.withColumn("word", F.explode("word")).join(words, "word").select(*chunks.columns, "word")


def detect_typos(chunks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A finding for each wrong form that a chunk contains, with the right one."""
    pairs = catalog.typo_pairs(chunks.sparkSession) if pairs is None else pairs
    found = contained_words(chunks, pairs.select(F.col("wrong").alias("word"))).withColumnRenamed("word", "wrong")
    return found.join(pairs, "wrong")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def detect_spelling(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, word, n): English words not in the lexicon (word, lower case). Mixed case, capitals, digits and underscores are exempt."""
    plain = F.filter(_words(F.col("text")), lambda w: w.rlike("^[A-Za-z]?[a-z]+$") & (F.length(w) > 1))
    used = docs.select("doc_id", F.explode(F.transform(plain, F.lower)).alias("word"))
    known = lexicon.select("word").distinct()
    if known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:  # then only unknown words are shuffled
        return used.join(F.broadcast(known), "word", "left_anti").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return used.groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(known, "word", "left_anti")


def detect_term_variants(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """(doc_id, term, variants): terms (term, variant) that a document spells in more than one way."""
    found = contained_words(docs.select("doc_id", F.col("text").alias("chunk")), variants.select(F.col("variant").alias("word")))
    hits = found.select("doc_id", F.col("word").alias("variant")).join(variants, "variant")
    return hits.groupBy("doc_id", "term").agg(F.array_join(F.sort_array(F.collect_set("variant")), ",").alias("variants"), F.count_distinct("variant").alias("_n")).filter("_n > 1").drop("_n")


def occurrences(text: Column, sign: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / len(sign)).cast("int")


def unpaired(text: Column) -> Column:
    """The signs of `text` that open and close a different number of times, joined; code between back quotes is exempt."""

    def odd(bare: Column) -> Column:
        pairs = [F.when(occurrences(bare, a) != occurrences(bare, b), F.lit(a + b)) for a, b in PAIRS]
        return F.concat_ws(" ", *pairs, *[F.when(occurrences(bare, s) % 2 == 1, F.lit(s)) for s in SAME])

    # The one-element array binds the text without code, so that it is made once; most texts have no sign at all.
    signed = text.rlike(f"[{''.join(a + b for a, b in PAIRS)}{''.join(SAME)}]")
    return F.when(signed, F.transform(F.array(F.regexp_replace(text, "`[^`]*`", "")), odd)[0]).otherwise("")


def detect_unpaired(sentences: DataFrame) -> DataFrame:
    """Sentences (…, sentence) with signs whose partner is missing."""
    return sentences.withColumn("signs", unpaired(F.col("sentence"))).filter("signs <> ''")


def detect_garbled(chunks: DataFrame) -> DataFrame:
    """Chunks with runs that look like a broken encoding; the runs as an array."""
    return chunks.withColumn("runs", F.regexp_extract_all("chunk", F.lit(GARBLED), F.lit(1))).filter(F.size("runs") > 0)


def filter_exempt(findings: DataFrame, exempt: DataFrame) -> DataFrame:
    """Findings whose suggestion says something else, whose term isn't exempt, and which are no address or legal line."""
    told = findings.filter(~F.col("sentence").eqNullSafe(F.col("suggestion")) & ~F.coalesce("sentence", F.lit("")).rlike(r"https?://|www\.|©"))
    return told.join(exempt.select("term"), "term", "left_anti")
