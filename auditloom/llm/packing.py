"""Best-fit packing of token sequences by patterns.

A document's tokens and an end id make its run; runs over `size` tokens are cut into pieces. Packing needs only the
histogram of piece lengths, which has `size` entries however large the corpus is:

1. lengths are rounded up to classes, and all patterns of up to `parts` classes that fill a sequence are enumerated;
2. non-negative least squares fits how often each pattern should be used to the class histogram;
3. the counts are rounded down to what is there, and each pattern draws lengths from its classes, longest first;
4. the residual goes by best fit, longest first, into the room that is really left, or into new sequences.

The plan is a list of runs (length, first rank, how many, ...) of bounded size. Pieces get a rank within their length
from salted row numbers plus counted offsets, in parts whose number follows the rows of the length, and a broadcast join
with the plan gives each its sequence and place. Pieces that fill a sequence need no rank. No token travels in a shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpoint, map_arrow, table

SIZE, END_ID = 2048, 0
#: Entries of a worker's word cache before it is begun anew.
CACHE_WORDS = 300_000
#: Pieces of one length that are numbered together, about.
RANKED_ROWS = 500_000
#: Classes of length that patterns are made of.
CLASSES = 128


#: What plain text falls into: letters, single digits, runs of other signs.
_PARTS = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Signs side by side, which are one part.
_TOUCHING = re.compile(r"[^\w\s][^\w\s]|_")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PartIds(dict):
    """Little-endian 32-bit token ids of each lower-case word of plain text, found once and kept. A word is its parts in turn."""

    def __init__(self, tokenizer):
        self.of_part, self.letters = tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        parts = _PARTS.findall(word)
        if len(parts) > 1:
            out = b"".join([self[p] for p in parts])
        else:
            out = b"".join([t.id.to_bytes(4, "little") for t in self.of_part(word.encode().decode("latin-1").translate(self.letters))])
        self[word] = out
        return out


class WordIds(dict):
    """The same for any text between white space, by the whole tokenizer. Exact because that drops white space and never joins text across it."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = out
        return out


# The settings of a vocabulary file that the quick ways below reproduce.
KNOWN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _is_known(path: str) -> bool:
    """Whether a vocabulary file lower-cases, drops white space and splits as the quick ways do."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        return (
            spec["normalizer"]["normalizers"] == KNOWN_NORMALIZERS and split == {"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True}
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        )
    except (KeyError, TypeError, ValueError):
        return False


class TextIds:
    """Token ids of whole texts.

    A vocabulary with other settings than the known ones gets each text whole. With these, texts of Latin letters, digits and signs fall into parts as the tokenizer's own splitting has it, and the parts'
    vocabulary is small. Any other text (with apostrophes, special tokens, other scripts and numerals, marks) goes word
    by word through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        self.known = _is_known(path)
        self.parts, self.words = PartIds(tokenizer), WordIds(tokenizer)
        usual = [chr(c) for c in range(0x21, 0x250) if chr(c) != "'" and not 0x7F <= c <= 0xA0 and c != 0x130 and (c < 0x80 or not chr(c).isnumeric())]
        self.plain = frozenset([*usual, *" \t\n\r\f\v"])

    def clear(self) -> None:
        self.parts.clear()
        self.words.clear()

    def __call__(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.plain.issuperset(set(text)) and "<|" not in text:
            parts, text = self.parts, text.lower()
            if not _TOUCHING.search(text):  # then stops and commas are parts of their own, and words vary less without them
                text = text.replace(".", " . ").replace(",", " , ")
            return b"".join([parts[w] for w in text.split()])
        words = self.words
        return b"".join([words[w] for w in raw.split()])


_IDS: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One for each worker process."""
    if path not in _IDS:
        _IDS[path] = TextIds(path)
    return _IDS[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenize_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, and `ids` (binary) if asked for.

    A null or empty text is the end id alone. A long text gives as many pieces as it fills.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = text_ids(vocabulary), END_ID.to_bytes(4, "little")
        try:
            for b in batches:
                out = [[] for _ in schema.split(", ")]
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    run = ids_of(text.as_py()) + end
                    for k in range(0, len(run), 4 * size):
                        ids = run[k : k + 4 * size]
                        row = (doc_id, k // (4 * size), k // 4, len(ids) // 4, zlib.crc32(ids), ids)
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                yield batch(schema, out)
        finally:  # a worker goes on with other work, for which it should not hold the words of this
            ids_of.clear()

    return map_arrow(docs.select(F.col(id_col).cast("bigint"), as_bytes(F.col(text_col))), run, schema)


def patterns(total: int, parts: int) -> list[tuple[int, ...]]:
    """All multisets of up to `parts` positive numbers with this sum, largest first."""
    if parts == 1:
        return [(total,)]
    out = [(total,)]
    for first in range(total - 1, 0, -1):
        rest = total - first
        if first * (parts - 1) < rest:
            break
        out += [(first, *p) for p in patterns(rest, parts - 1) if p[0] <= first]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by active sets: x >= 0 that brings a @ x near b."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(target).max())):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            found = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (found > 1e-12).all():
                x[:] = 0
                x[at] = found
                break
            bad = found <= 1e-12
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - found[bad], 1e-30))
            x[at] += step * (found - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_packing(histogram: dict[int, int], size: int = SIZE, parts: int = 3) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, how often), ...], number of sequences)] for a histogram of lengths."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    groups: list[tuple[list[tuple[int, int]], int]] = []
    if left[size]:
        groups.append(([(size, 1)], int(left[size])))
        left[size] = 0
    width = max(1, size // CLASSES)
    classes = size // width
    if classes >= 2:
        counts = np.array([left[(c - 1) * width + 1 : c * width + 1].sum() for c in range(1, classes + 1)], float)
        kinds = [p for p in patterns(classes, parts) if len(p) > 1 and all(counts[c - 1] for c in p)]
        if kinds:
            a = np.zeros((classes, len(kinds)))
            for k, p in enumerate(kinds):
                np.add.at(a[:, k], np.array(p) - 1, 1)
            scale = max(counts.max(), 1.0)
            uses = nnls(a, counts / scale) * scale
            for k in np.argsort(-uses, kind="stable"):
                if uses[k] >= 1:
                    groups += _drawn(left, kinds[k], int(uses[k]), width)
    return _best_fit(groups, left, size)


def _drawn(left: np.ndarray, pattern: tuple[int, ...], uses: int, width: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of sequences of one pattern; the lengths come from their classes, longest first."""
    out = []
    while uses > 0:
        lengths, need = [], defaultdict(int)
        for c in pattern:
            length = next((x for x in range(c * width, (c - 1) * width, -1) if left[x] > need.get(x, 0)), 0)
            if not length:
                return out
            need[length] += 1
            lengths.append(length)
        n = min(uses, *(int(left[x] // m) for x, m in need.items()))
        for x, m in need.items():
            left[x] -= n * m
        out.append((sorted(need.items(), reverse=True), n))
        uses -= n
    return out


def _best_fit(groups: list[tuple[list[tuple[int, int]], int]], left: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Adds what is left, longest first, where the room is least but enough."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for content, n in groups:
        rooms[size - sum(x * m for x, m in content)].append((content, n))
    open_rooms = sorted(rooms)
    for length in range(size, 0, -1):
        while left[length]:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                room, content, there = size, [], int(left[length])
            else:
                room = open_rooms[at]
                content, there = rooms[room].pop()
                if not rooms[room]:
                    open_rooms.pop(at)
            each = room // length
            full, rest = divmod(int(left[length]), each)
            used = min(there, full)
            if used:
                _put(rooms, open_rooms, room - each * length, ([*content, (length, each)], used))
                left[length] -= used * each
            if used < there and content:
                if used == full and rest:
                    _put(rooms, open_rooms, room - rest * length, ([*content, (length, rest)], 1))
                    left[length] -= rest
                    used += 1
                if used < there:
                    _put(rooms, open_rooms, room, (content, there - used))
            elif not content and used == full and rest:
                _put(rooms, open_rooms, room - rest * length, ([(length, rest)], 1))
                left[length] -= rest
    return [g for room in sorted(rooms) for g in rooms[room]]


def _put(rooms: dict, open_rooms: list[int], room: int, group: tuple) -> None:
    if not rooms[room]:
        insort(open_rooms, room)
    rooms[room].append(group)


def _slots(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, how many side by side, first sequence, offset) of each run in the plan."""
    out, sequence, rank = [], 0, defaultdict(int)
    for content, n in plan:
        offset = 0
        for length, m in content:
            out.append((length, rank[length], n * m, m, sequence, offset))
            rank[length] += n * m
            offset += length * m
        sequence += n
    return out


def pack(pieces: DataFrame, size: int = SIZE, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """`pieces` (doc_id, piece, length, ids_crc32, ...), a checkpoint or table, with sequence_id and offset; sequences hold at most `size` tokens, without gaps.

    Pieces of `size` tokens have sequences of negative numbers to themselves.
    """
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    part = pieces.filter(F.col("length") < size)
    per_length = {r.length: -(-r["count"] // ranked_rows) for r in part.groupBy("length").count().collect()}  # at most size rows
    salts = F.broadcast(spark.createDataFrame(list(per_length.items()), "length bigint, _salts bigint"))
    part = part.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int"))
    counted = part.groupBy("length", "_salt").count().collect()  # at most size rows, and one for each ranked_rows pieces
    histogram, offsets = defaultdict(int), []
    for r in sorted(counted, key=lambda r: (r.length, r._salt)):
        offsets.append((r.length, r._salt, histogram[r.length]))
        histogram[r.length] += r["count"]
    slots = _slots(plan_packing(histogram, size))
    before = spark.createDataFrame(offsets, "length bigint, _salt int, _before bigint")
    runs = spark.createDataFrame(slots, "length bigint, _first bigint, _ranks bigint, _side bigint, _sequence bigint, _offset bigint")
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = part.withColumn("_nth", nth).join(F.broadcast(before), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    place = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(runs), "length").filter((place >= 0) & (place < F.col("_ranks")))
    whole = lambda x: F.expr(f"{x} div _side")
    placed = placed.withColumns({"sequence_id": F.col("_sequence") + whole("(_rank - _first)"), "offset": F.col("_offset") + (place % F.col("_side")) * F.col("length")})
    columns = [*pieces.columns, "sequence_id", "offset"]
    return placed.select(*columns).unionByName(full.select(*columns))


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, **columns) -> DataFrame:
    """Pieces of all documents with their places. An empty table gives no rows; documents that repeat are all packed."""
    pieces = tokenize_pieces(docs, vocabulary or public_vocabulary(), size=size, **columns)
    return pack(checkpoint(pieces), size)


def op6_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
