"""Token counts of documents without their token ids.

A model's pieces never join text across certain places (`PRE_TOKEN`), so a text's count is the sum over its pre-tokens:

1. each task adds up its pre-tokens, and a shuffle of these sums gives every distinct pre-token once;
2. the model cuts each distinct pre-token once, and only the number of its pieces is kept;
3. each document's pre-token frequencies meet these numbers: the HOT_PRE_TOKENS most frequent ones from a broadcast of
   bounded size, within the task; the rest by a shuffled join, of which a document gets back one sum.

Where a model has pieces that reach across these places, a whole text is one pre-token, which is slower and as right.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, map_arrow, table, written
from .packing import public_vocabulary

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: The sign that the model writes for a space; it takes a space in front of every text that isn't empty.
SPACE_SIGN = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Spaces with the letters or the other signs behind them, spaces alone, single digits and line breaks. Where it cuts depends on the two characters beside the cut only.
PRE_TOKEN = re.compile(f" *[{_LETTERS}]+| *[^{_LETTERS}0-9 \n\t]+| +|[0-9\n\t]")
#: A place where PRE_TOKEN always cuts, and the characters of a text that are cut up at once.
_BREAK, SLICE = re.compile(r"(?<=[^ \n\t])[ \n\t]"), 1 << 20
#: Different pre-tokens that a task holds before it hands out their sums.
HELD = 200_000
#: Entries of the broadcast, each at most a name of NAME_CHARS and a number: some megabytes whatever the input.
HOT_PRE_TOKENS, NAME_CHARS = 250_000, 24
#: Stands in front of a pre-token for the model: the model's own space falls before it, and no piece joins it to anything.
GUARD = "\n"


def load(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def cuts_hold(model) -> bool:
    """Whether no piece of the model reaches across a place where PRE_TOKEN cuts."""
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
    pieces = (model.id_to_piece(k) for k in range(model.vocab_size()) if not special(k))
    whole = all(len(PRE_TOKEN.findall(p.replace(SPACE_SIGN, " "))) == 1 for p in pieces)
    return whole and len(model.encode(GUARD + "a")) == len(model.encode(GUARD)) + 1 and model.encode("a", out_type=str) == [SPACE_SIGN + "a"]


def frequencies(text: str, cut: bool = True) -> Counter:
    """How often each pre-token occurs in a text as the model sees it. Long texts are cut up in slices."""
    if not text:
        return Counter()
    text = " " + text.replace(SPACE_SIGN, " ")
    if not cut:
        return Counter([text])
    out: Counter = Counter()
    begin = 0
    while len(text) - begin > SLICE and (at := _BREAK.search(text, begin + SLICE)):
        out.update(PRE_TOKEN.findall(text[begin : at.start()]))
        begin = at.start()
    out.update(PRE_TOKEN.findall(text[begin:] if begin else text))
    return out


def name_of(pre_token: str) -> str:
    """A short pre-token itself, or a 128-bit digest of a long one, which is longer than any short one."""
    return pre_token if len(pre_token) <= NAME_CHARS else hashlib.blake2b(pre_token.encode(), digest_size=16).hexdigest()


def distinct_pre_tokens(docs: DataFrame, text: str, cut: bool = True) -> DataFrame:
    """(pre_token, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(frequencies(t.as_py(), cut))
                if len(held) > HELD:
                    yield batch("pre_token string, n bigint", [list(held), list(held.values())])
                    held.clear()
        yield batch("pre_token string, n bigint", [list(held), list(held.values())])

    return map_arrow(docs.select(text), run, "pre_token string, n bigint").groupBy("pre_token").agg(F.sum("n").alias("n"))


def count_pieces(pre_tokens: DataFrame, path: str, cut: bool = True) -> DataFrame:
    """(name, n, pieces) of distinct pre-tokens."""
    schema = "name string, n bigint, pieces bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            texts = b.column(0).to_pylist()
            if cut:
                own = len(model.encode(GUARD))
                pieces = [len(ids) - own for ids in model.encode([GUARD + t for t in texts], num_threads=1)]
            else:
                pieces = [len(model.encode(t[1:])) for t in texts]
            yield batch(schema, [[name_of(t) for t in texts], b.column(1), pieces])

    return map_arrow(pre_tokens.select("pre_token", "n"), run, schema)


def hot_pre_tokens(pieces: DataFrame, hot: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens by name, at most `hot`: those above a frequency that the counts by its logarithm tell."""
    level = F.floor(F.log2("n") * 16).alias("level")
    left, least = hot, None
    for r in sorted(pieces.groupBy(level).count().collect(), reverse=True):  # about a thousand rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    if least is None:
        return {}
    return {r.name: r.pieces for r in pieces.filter(F.floor(F.log2("n") * 16) >= least).select("name", "pieces").collect()}


def token_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, limit: int = LIMIT, hot: int = HOT_PRE_TOKENS) -> DataFrame:
    """(…keys, n_bytes, n_tokens, over_limit), a row for each row of `docs`; other columns are ignored.

    A null text counts as empty and has no tokens. Rows that repeat, and rows without a key, each have a row of their
    own. An empty table gives no rows. A text of any length is cut up in slices; one without any place to cut is one
    pre-token. `path` is the model's file on every executor.
    """
    path = path or public_vocabulary(MODEL)
    cut = cuts_hold(load(path))
    pieces = written(count_pieces(distinct_pre_tokens(docs, text, cut), path, cut))
    sent = docs.sparkSession.sparkContext.broadcast(hot_pre_tokens(pieces, hot))
    rows = docs.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("keys"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text).alias("text"))
    schema = T.StructType([*rows.drop("text").schema.fields, *[T.StructField(n, t) for n, t in (("n_hot", T.LongType()), ("rare", T.ArrayType(T.StringType())), ("times", T.ArrayType(T.LongType())))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for b in batches:
            sums, rare, times = [], [], []
            for t in b.column(2):
                total, names, counts = 0, [], []
                for p, n in frequencies(t.as_py(), cut).items():
                    name = p if len(p) <= NAME_CHARS else name_of(p)
                    if (of_one := numbers.get(name)) is None:
                        names.append(name)
                        counts.append(n)
                    else:
                        total += of_one * n
                sums.append(total)
                rare.append(names)
                times.append(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=["keys", "n_bytes", "n_hot", "rare", "times"])

    counted = written(map_arrow(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))
    each = counted.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("name"), F.col("x.times").alias("times"))
    sums = each.join(pieces.select("name", "pieces"), "name").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rare"))
    out = counted.select("row", "keys", "n_bytes", "n_hot").join(sums, "row", "left")
    n = F.col("n_hot") + F.coalesce("n_rare", F.lit(0))
    return out.select(*[F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)], "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
