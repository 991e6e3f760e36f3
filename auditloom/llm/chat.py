"""Chat formatting by token-level assembly.

Each turn is assembled from separately encoded segments: reserved ids for the template's marks, byte-level BPE ids for
the text. Texts never yield reserved ids: control strings inside them are escaped before encoding (a backslash goes
behind the first character; a string that already has n of them gets n + 1), so unescaping is exact. The loss mask is the
prefix sum of +1 and -1 at the ends of the assistant's segments.

Turns are formatted and read back as they lie, in any task; only then do the rows of a conversation meet, sorted, and a
stream folds them. A conversation of any length needs one batch of memory, and its one task only feeds digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, table

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]"]
#: What opens and closes the turn of a role; other roles are written out.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
FIRST_RESERVED = 50_257
RESERVED = {c: FIRST_RESERVED + k for k, c in enumerate(CONTROLS)}
TRAINED_ROLE = "assistant"
#: Characters that are encoded at once, so that no text makes the tokenizer's work long.
SLICE = 1 << 16

_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\+(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


_ENCODINGS: dict = {}


def encoding(path: str):
    """The byte-level vocabulary, read once by a worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, whether it is a control, whether it is trained on) of a turn in order."""
    if role in MARKS:
        opens, closes = MARKS[role]
        return [(opens, True, False), (escape(text), False, role == TRAINED_ROLE), (closes, True, False)]
    return [(OTHER[0], True, False), (escape(role), False, False), (OTHER[1], True, False), (escape(text), False, False), (OTHER[2], True, False)]


def assemble(role: str, text: str, encode) -> tuple[np.ndarray, np.ndarray, str]:
    """Token ids, loss mask and formatted text of a turn."""
    parts = segments(role, text)
    ids = [[RESERVED[s]] if control else list(chain.from_iterable(encode(s[i : i + SLICE]) for i in range(0, len(s), SLICE))) for s, control, _ in parts]
    ends = np.cumsum([len(x) for x in ids])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    for (_, _, trained), end, x in zip(parts, ends, ids, strict=True):
        if trained:
            np.add.at(steps, [end - len(x), end], [1, -1])
    return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), np.cumsum(steps[:-1], dtype=np.int8), "".join(s for s, _, _ in parts)


def read_back(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[str, str, str]:
    """Role, text, and the text under the mask, of an assembled turn."""
    at = np.flatnonzero(ids >= FIRST_RESERVED)
    between = [unescape(decode(ids[a + 1 : b].tolist()).decode("utf-8")) for a, b in zip(at, at[1:], strict=False)]
    opens = CONTROLS[ids[0] - FIRST_RESERVED]
    role = between[0] if opens == OTHER[0] else next(r for r, m in MARKS.items() if m[0] == opens)
    return role, between[-1], unescape(decode(ids[mask == 1].tolist()).decode("utf-8"))


TURNS = "conv_id bigint, turn bigint, role string, input_ids array<int>, loss_mask array<tinyint>, formatted string"


def format_turns(rows: DataFrame, vocabulary: str) -> DataFrame:
    """A formatted row for each row of (conv_id, turn, role, text). Null text and role count as empty; no row is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            made = [assemble(r, t, encode) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield batch(TURNS, [b.column(0), b.column(1), b.column(2), *([m[k] for m in made] for k in range(3))])

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return map_arrow(rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), empty("role"), empty("text")), run, TURNS)


def with_token_starts(turns: DataFrame) -> DataFrame:
    """Adds token_start: where a turn's ids begin in its conversation, by a running sum of the lengths before it; ties go by role, then formatted text."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "formatted").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("token_start", F.coalesce(F.sum(F.size("input_ids").cast("bigint")).over(before), F.lit(0)))


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"


class _Fold:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = 0

    def add(self, role: str, text: str, loss: str | None, chars: int, tokens: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        loss = text if loss is None else loss
        self.loss.update(loss.encode())
        self.n_turns, self.loss_chars, self.chars, self.tokens = self.n_turns + 1, self.loss_chars + len(loss), self.chars + chars, self.tokens + tokens

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


READ = "conv_id bigint, turn bigint, role string, text string, loss string, chars bigint, tokens bigint"


def read_turns(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Role, text and loss text (null where it is the whole text) of the rows of format_turns(), read back from their ids and masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(vocabulary).decode_bytes
        for b in batches:
            ids = [x.values.to_numpy() for x in b.column(2)]
            made = [read_back(i, x.values.to_numpy(), decode) for i, x in zip(ids, b.column(3), strict=True)]
            loss = [None if trained == text else trained for _, text, trained in made]
            yield batch(READ, [b.column(0), b.column(1), [m[0] for m in made], [m[1] for m in made], loss, b.column(4), list(map(len, ids))])

    return map_arrow(turns.select("conv_id", "turn", "input_ids", "loss_mask", F.length("formatted").cast("bigint")), run, READ)


def conversation_digests(turns: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each conversation of format_turns(); turns that tie are taken by role, then by text, both as read back. Rows without a conv_id are one conversation; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            done = []
            for conv_id, _, *turn in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at is None or at.conv_id != conv_id:
                    done += [at.row()] if at else []
                    at = _Fold(conv_id)
                at.add(*turn)
            yield batch(DIGEST, list(zip(*done, strict=True)) or [[]] * 7)
        if at:
            yield batch(DIGEST, list(zip(at.row(), strict=True)))

    together = read_turns(turns, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(together, run, DIGEST)


def byte_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: A conversation that says control strings of the template itself.
HARD_CASE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(HARD_CASE, "conv_id bigint, turn bigint, role string, text string"))
    path = byte_vocabulary()
    return conversation_digests(format_turns(rows, path), path).drop("n_tokens")


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 18 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(/?INST|/?SYS|/?ROLE|OUT|END)\]')) END + length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(/?INST|/?SYS|/?ROLE|OUT|END)\]'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
