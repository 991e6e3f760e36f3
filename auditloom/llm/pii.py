"""Personal data by candidate gradient boosting.

Exact patterns with validators give the base spans. Beside them, generators with high recall propose overlapping
candidates of more forms; boosted trees score each by its format and context, and a threshold for each kind, set on
held-out candidates for a wanted precision, selects what is added. Base spans always stay.

All work on a document happens where it lies: no shuffle. The trees are fitted on a bounded sample of candidates with
weak labels (the validators' verdicts), drawn by hash over all documents, and on written-out examples of further forms.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batch, map_arrow, table

#: Order of kinds where spans start together. The first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "secret", "id"]
#: Documents, drawn by hash of their ids, whose candidates may be fitted on; most labelled candidates used, and the share held out.
SAMPLE_DOCS, SAMPLE_ROWS, HELD_OUT_SHARE = 100_000, 4000, 0.25
WANTED_PRECISION = 0.99

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """The base validators."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(s)) <= 15
    return True


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of the base patterns' leftmost matches."""
    at, free = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield "email", start, domain.end(), True
                free = domain.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end(), valid(kind, m[0])


_AT_WORD = re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?[\[(](?:at|AT)[\])] ?[\w-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[\w-]{2,63})+|(?<![\w.+-])[\w.+-]{1,64} at [\w-]{1,63}(?: dot [\w-]{2,63})+")
_NUMBER = re.compile(r"[0-9][0-9 ()./:-]*")
_DIGITS = re.compile(r"[0-9]+")
#: Digits of a number that is proposed.
LEAST_DIGITS, MOST_DIGITS = 9, 19
_KEYED = re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})")
_KEY_WORDS = ("token", "passw", "pwd", "secret", "key")
_LONG = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![A-Za-z0-9_/+-])")
_ID = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])")


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every run of neighbouring digit groups with a wanted number of digits; at most MOST_DIGITS for each start."""
    for m in _NUMBER.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
        for k, (start, _) in enumerate(groups):
            n = 0
            for s, end in groups[k : k + MOST_DIGITS]:
                n += end - s
                if n > MOST_DIGITS:
                    break
                if n >= LEAST_DIGITS:
                    yield start, end, n


def candidates(text: str) -> Iterator[Span]:
    """Overlapping proposals; each generator is cheap to rule out for a text without its signs."""
    if "@" in text:
        for m in re.finditer(r"(?<![^\s<>\"',;:()\[\]])[^\s@<>\"',;:()\[\]]{1,64}@[^\s@<>\"',;:()\[\]]{2,255}", text):
            yield "email", m.start(), m.end()
    if "(at)" in text or "[at]" in text or " dot " in text or "[AT]" in text or "(AT)" in text:
        for m in _AT_WORD.finditer(text):
            yield "email", m.start(), m.end()
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in _KEY_WORDS):
        for m in _KEYED.finditer(text):
            yield "secret", m.start(1), m.end(1)
    if _DIGIT.search(text):
        for first, end, n in numbers(text):
            start = first
            while start and text[start - 1] in "+(" and first - start < 2:
                start -= 1
            if text.count(".", first, end) >= 3:
                yield "ip", first, end
            if n <= 15:
                yield "phone", start, end
            if n >= 12 and luhn(digits_of(text[first:end])):
                yield "card", first, end
        for m in _LONG.finditer(text):
            if _DIGIT.search(m[0]) and not m[0].isdecimal():
                yield "secret", m.start(), m.end()
        for m in _ID.finditer(text):
            yield "id", m.start(), m.end()


_CONTEXT = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobil"), "secret": _KEY_WORDS, "id": ("ssn", "iban", "social", "account", "tax")}
#: Another number right beside.
_BESIDE_BEFORE, _BESIDE_AFTER = re.compile(r"[0-9][ ()./:-]+\+?\Z"), re.compile(r"[ ()./:-]+[0-9]")
N_FEATURES = 27


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and the characters around it."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    d, groups = digits_of(s), _DIGITS.findall(s)
    n, letters, upper = len(s), sum(c.isalpha() for c in s), sum(c.isupper() for c in s)
    share = [s.count(c) / n for c in set(s)]
    parts = [p for p in s.split(".") if p]
    low = before.lower()
    return [
        KINDS.index(kind), n, len(d), letters, upper, n - letters - len(d), len(share) / n, -sum(p * math.log2(p) for p in share), float(len(d) > 1 and luhn(d)),
        float(s[0] == "+" or before[-1:] == "+"), s.count("."), s.count("-"), s.count(" "), float("@" in s), max((len(p) for p in parts), default=0),
        float(len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts)), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(any(w in low for w in _CONTEXT[kind])), float(before[-1:] in "\"'=:"), float(before[-1:].isalnum()), float(after[:1].isalnum()), float("(" in s or "(at" in s.lower() or " at " in s),
        max(map(len, groups), default=0), len(groups), s.count(":") + s.count("/"), float(_BESIDE_BEFORE.search(before) is not None), float(_BESIDE_AFTER.match(after) is not None),
    ]


def _written(n: int = 2400, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates of forms that the corpus may lack, and of look-alikes."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(a, b)))
    code = lambda k, chars="0123456789abcdef": "".join(r.choice(chars) for _ in range(k))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    yes = [
        ("email", lambda: f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'net'])}"), ("email", lambda: f"{word()} (at) {word()} (dot) com"), ("email", lambda: f"{word()}[at]{word()}.org"), ("email", lambda: f"{word()} at {word()} dot com"),
        ("ip", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))), ("card", card), ("phone", lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"+{digits(2)} {digits(3)} {digits(7)}"),
        ("secret", lambda: code(r.choice([16, 18, 24, 32, 40]))), ("secret", lambda: code(24, "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789")), ("id", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"), ("id", lambda: "DE" + digits(20)),
    ]
    no = [
        ("email", lambda: f"{word()}@{word()}"), ("ip", lambda: f"{r.randint(256, 999)}.{digits(3)}.{digits(4)}.{digits(2)}"), ("ip", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}.{digits(4)}.{digits(1)}"), ("phone", lambda: f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}"),
        ("phone", lambda: f"{digits(4)}.{digits(8)}"), ("phone", lambda: digits(r.randint(9, 15))), ("card", lambda: f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}"), ("secret", lambda: "-".join(word() for _ in range(5)) + digits(1)), ("secret", lambda: "/".join(word() for _ in range(4)) + "/" + digits(2)), ("secret", lambda: word(6, 8)), ("id", lambda: f"{word().upper()[:2]}{digits(2)} {word(4, 4).upper()} {word(4, 4).upper()} {word(4, 4).upper()}"),
    ]
    x, y = [], []
    for k in range(n):
        kind, make = r.choice((no, yes)[k % 2])
        before = " ".join(word() for _ in range(3)) + " "
        if k % 2 and r.random() < 0.5:
            before += r.choice(_CONTEXT[kind]) + r.choice([": ", " "])
        if kind == "secret" and k % 2:
            before += r.choice(['token = "', "password=", 'api_key: "'])
        s = make()
        if kind == "card" and not luhn(digits_of(s)):  # never proposed
            continue
        x.append(features(before + s + " " + word(), kind, len(before), len(before) + len(s)))
        y.append(k % 2)
    # Numbers beside each other: runs of groups that are parts of times, tables and decimals, and whole numbers in a row.
    def row(seps: str) -> str:
        return "".join(digits(r.randint(1, 5)) + r.choice(seps) for _ in range(r.randint(6, 10)))[:-1]

    def times() -> str:
        return " ".join(r.choice([f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(2)}/{digits(2)}/{r.randint(1900, 2030)}"]) for _ in range(r.randint(2, 4)))

    ones = [("card", card), ("phone", lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"+{digits(2)} {digits(3)} {digits(7)}")]
    for k in range(n // 2):
        head, tail = " ".join(word() for _ in range(3)) + " ", " " + word()
        if k % 2:
            kind, make = r.choice(ones)
            s, other = make(), r.choice([make, lambda: digits(16), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))])()
            text, start = (head + s + " " + other + tail, len(head)) if r.random() < 0.5 else (head + other + " " + s + tail, len(head) + len(other) + 1)
            spans = [(kind, start, start + len(s))]
        else:
            text = head + r.choice([times, lambda: row(" "), lambda: row(" .-:/"), lambda: row(". "), lambda: row(" -")])() + tail
            kind = r.choice(["card", "phone"])
            spans = [(kind, a, b) for a, b, m in numbers(text) if (12 <= m and luhn(digits_of(text[a:b])) if kind == "card" else m <= 15)]
            spans = r.sample(spans, min(2, len(spans)))
        x += [features(text, *span) for span in spans]
        y += [k % 2] * len(spans)
    return np.array(x, float), np.array(y, float)


class Trees:
    """Gradient boosting for a yes-or-no label: small trees on binned features, fitted to the gradient of the log loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[list[int], list[float], list[float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            score += np.array(tree[2])[leaf]
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        """A full binary tree by levels: a feature and a cut for each inner node, a value for each leaf."""
        cut_feature, cut_bin, node = [], [], np.zeros(len(g), int)
        for level in range(self.depth):
            for k in range(2**level):
                rows = np.flatnonzero(node == k)
                f, b = self._best_cut(binned[rows], g[rows], h[rows], edges)
                cut_feature.append(f)
                cut_bin.append(b if b >= 0 else self.bins + 1)  # without a good cut all rows go left
            at = 2**level - 1 + node
            node = 2 * node + (binned[np.arange(len(g)), np.array(cut_feature)[at]] > np.array(cut_bin)[at])
        cut_at = [float(edges[f][b]) if b <= self.bins else math.inf for f, b in zip(cut_feature, cut_bin, strict=True)]
        leaves = 2**self.depth
        value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
        return (cut_feature, cut_at, value.tolist()), node

    def _best_cut(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int]:
        best, at = 1e-6, (0, -1)
        total = g.sum() ** 2 / (h.sum() + self.ridge)
        for f, e in enumerate(edges):
            if len(g) and len(e):
                gl, hl = np.cumsum(np.bincount(binned[:, f], g, len(e) + 1))[:-1], np.cumsum(np.bincount(binned[:, f], h, len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - total
                if gain.max() > best:
                    best, at = gain.max(), (f, int(gain.argmax()))
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for cut_feature, cut_at, value in self.trees:
            node, fs, cuts = np.zeros(len(x), int), np.array(cut_feature), np.array(cut_at)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, fs[at]] > cuts[at])
            out += np.array(value)[node]
        return 1 / (1 + np.exp(-out))


def thresholds(scores: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = WANTED_PRECISION) -> list[float]:
    """For each kind, half way between the last held-out score that keeps the precision and the next; at least a half."""
    out = []
    for k in range(len(KINDS)):
        s, t = scores[kinds == k], y[kinds == k]
        order = np.argsort(-s, kind="stable")
        good = np.flatnonzero(np.cumsum(t[order]) / np.arange(1, len(s) + 1) >= precision)
        ranked = np.append(s[order], 0.0)
        out.append(max(0.5, float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2) if len(good) else 0.9)
    return out


def weak_labels(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Candidates that a validator speaks for or against, with features; digits that fail Luhn are no card, so they aren't candidates."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc_id, s, int(ok), features(text, kind, s, e)) for kind, s, e, ok in base_matches(text) if ok or kind != "card"]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.float64()))], names=schema.names)

    signs = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).filter(F.col(text_col).rlike("[0-9@]"))
    return map_arrow(signs, run, schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Trees, list[float]]:
    """Trees and thresholds. At most `sample_rows` labelled candidates of about SAMPLE_DOCS documents come to the driver, the same ones every time."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < round(share * 1_000_000))
    rows = weak_labels(drawn, id_col, text_col).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(sample_rows).collect()
    x, y = _written()
    if rows:
        x = np.concatenate([x, np.array([r.features for r in rows], float)])
        y = np.concatenate([y, np.array([r.label for r in rows], float)])
    held = np.random.default_rng(0).random(len(y)) < HELD_OUT_SHARE
    model = Trees().fit(x[~held], y[~held])
    return model, thresholds(model.score(x[held]), y[held], x[held, 0].astype(int))


class _Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in spans:  # in order of start
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def find_spans(text: str, model: Trees, limits: list[float]) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, each in order of start. Added spans meet no base span and not each other; the higher score wins."""
    place = lambda x: (x[1], KINDS.index(x[0]))
    base = sorted(((k, s, e) for k, s, e, ok in base_matches(text) if ok), key=place)
    taken, added = _Taken(base), []
    found = [c for c in dict.fromkeys(candidates(text)) if not taken.meets(c[1], c[2])]
    if found:
        scores, taken = model.score(np.array([features(text, *c) for c in found])), _Taken()
        for score, c in sorted(zip(scores.tolist(), found, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2])):
            if score >= limits[KINDS.index(c[0])] and not taken.meets(c[1], c[2]):
                taken.add(c[1], c[2])
                added.append(c)
    return base, sorted(added, key=place)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


REPORT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of base spans, a digest of them, all spans, and how many are added and in all, for each row; a null text has none. Offsets are code points."""
    model, limits = fit(docs, id_col, text_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, added = find_spans(raw.as_py().decode("utf-8", "replace"), model, limits)
                spans = sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))
                out.append((doc_id, *(sum(k == kind for k, _, _ in base) for kind in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(added), len(spans)))
            yield batch(REPORT, list(zip(*out, strict=True)) or [[]] * 9)

    return map_arrow(docs.select(F.col(id_col).cast("bigint"), as_bytes(F.col(text_col))), run, REPORT)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with each span in the text replaced by its kind in angle brackets; where spans overlap, one mark with the first kind stands for all."""
    model, limits = fit(docs, id_col, text_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = [None if t is None else _replaced(t, sorted(sum(find_spans(t, model, limits), []), key=lambda x: (x[1], KINDS.index(x[0])))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return map_arrow(docs, run, docs.schema)


def _replaced(text: str, spans: list[Span]) -> str:
    out, free = [], 0
    for kind, start, end in spans:
        if start >= free:
            out += [text[free:start], f"<{kind}>"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
