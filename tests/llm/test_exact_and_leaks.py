"""Exact dedup and benchmark decontamination against brute force, and their edge cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from auditloom.llm import decontaminate as d
from auditloom.llm import exact_dedup as x

DOCS = "doc_id bigint, text string, extra string"
WHITE = re.compile(r"[\x20\x09-\x0D]+")


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        norm = WHITE.sub("", t or "")
        keep = min(groups[norm])[1]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def random_docs(n, seed=1):
    r = random.Random(seed)
    return [(k, r.choice([None, "", " ", "\t\n"] + ["".join(r.choice("ab \né") for _ in range(r.randint(0, 6))) for _ in range(4)])) for k in range(n)]


def test_exact_dedup(spark):
    rows = random_docs(300)
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], DOCS).repartition(7)
    assert sorted(map(tuple, x.exact_dedup(df, salts=3).collect())) == brute_dedup(rows)


def test_exact_dedup_with_clashing_digests(spark):
    rows = random_docs(200, 2)
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], DOCS).repartition(5)
    got = x.exact_dedup(df, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).drop("text_sha256")
    assert sorted(map(tuple, got.collect())) == [r[:4] for r in brute_dedup(rows)]


def test_exact_dedup_edges(spark):
    assert x.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a"), (5, "a "), (6, "x" * 100_000), (6, "x" * 100_000), (None, "z")], "doc_id bigint, text string").withColumn("kept", F.lit(1)).withColumn("_norm", F.lit(1))
    got = sorted(map(repr, x.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == sorted(["Row(doc_id=None, keep_id=5, group_size=3, kept=False)"] * 2 + ["Row(doc_id=5, keep_id=5, group_size=3, kept=True)"] + ["Row(doc_id=6, keep_id=6, group_size=2, kept=True)"] * 2 + ["Row(doc_id=None, keep_id=None, group_size=1, kept=True)"])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items, window):
    windows = {}
    for i, t in items:
        w = brute_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = brute_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_case(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(["a", "B", "é", "7", " ", ", ", "\n", "A ", "\x7f"]) for _ in range(r.randint(0, n)))
    return [(k, r.choice([None, text(80)])) for k in range(60)], [(k, r.choice([None, "", text(12), text(30)])) for k in range(12)]


def test_leaks(spark):
    for seed in range(3):
        docs, items = leak_case(seed)
        df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        for block_bytes in (1 << 20, 25):  # one block, and several
            found = d.find_leaks(df, bench, window=4, block_bytes=block_bytes)
            assert sorted(map(tuple, d.leak_report(found).collect()), key=repr) == brute_leaks(docs, items, 4)


def test_decontaminate_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1), (2, None, 2), (3, "clean", 3)], "doc_id bigint, text string, leak_spans int")
    bench = spark.createDataFrame([(1, "B, C d!")], "item_id bigint, text string")
    out = d.decontaminate(df, bench)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert d.decontaminate(df, bench.limit(0)).count() == 3 and d.decontaminate(df.limit(0), bench).count() == 0


def test_leaks_of_long_and_repeated(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(r.choice([3, 12, 80])))) for k in range(30)]
    items += [(100, items[0][1].upper()), (0, items[0][1]), (0, items[0][1]), (None, items[1][1])]
    long = [word() for _ in range(120_000)]
    for k in range(12):
        long[9000 * k : 9000 * k] = items[k][1].split()
    docs = [(1, " ".join(long)), (1, " ".join(long)), (2, items[5][1]), (None, items[0][1] + " " + items[0][1]), (3, "")]
    df = spark.createDataFrame([(*x, "mine", 5) for x in docs], "doc_id bigint, text string, leak_items string, k int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute_leaks(docs, [("" if i is None else i, t) for i, t in items], 10), key=repr)
    for block_bytes, few in ((1 << 20, 10), (900, 10), (900, 0)):
        d.BROADCAST_HITS = few
        found = d.find_leaks(df, bench, block_bytes=block_bytes)
        assert set(found.columns) == {*df.columns, "leak_spans"} and dict(found.dtypes)["leak_items"] == "array<string>"
        assert sorted(map(tuple, d.leak_report(found).collect()), key=repr) == want


def test_table_size():
    r = random.Random(3)
    items = [(str(k), " ".join(str(r.getrandbits(30)) for _ in range(80)).encode()) for k in range(4000)]
    built = d.Tables(items, 10)
    arrays = [built.first, built.after, built.begins] + [a for s in built.searches for a in (s.shift, s.suffix, s.whole, s.starts)]
    assert sum(a.nbytes for a in arrays) + len(built.raw) < 7 * sum(len(t) for _, t in items)
