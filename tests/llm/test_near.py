"""SimHash groups, similar documents, line dedup and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from auditloom.llm import common, components, line_dedup, repeats, simhash
from auditloom.llm.words import Runs

DOCS = "doc_id bigint, text string"


def connected(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark, monkeypatch):
    r = random.Random(1)
    for links in ([(k, k + 1) for k in range(60)], [(r.randint(0, 80), r.randint(0, 80)) for _ in range(70)], [(0, k) for k in range(1, 40)], []):
        df = spark.createDataFrame(links, "a bigint, b bigint")
        want = connected({n for x in links for n in x}, links)
        for most in (100_000, 0):  # in one task, and by joins
            monkeypatch.setattr(components, "ONE_TASK_LINKS", most)
            got = {r.node: r.root for r in components.components(components.spanning_forest(df)).collect()}
            assert got == {n: w for n, w in want.items() if n in got} and all(n == want[n] for n in set(want) - set(got))


def brute_print(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["ab ", "É", "x", "\n", "C\x0b", "\x1c"]) for _ in range(r.randint(0, 40)))
        assert simhash.fingerprint(text.encode()) == brute_print(text, 4)


def test_grid_finds_every_pair(spark, monkeypatch):
    r, prints = random.Random(5), []
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(4):
            x = base
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
            prints.append(x)
    prints += [0, 1, 3, (1 << 64) - 1, (1 << 64) - 2]
    rows = [(k, int(np.uint64(x).view(np.int64))) for k, x in enumerate(prints)]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = connected(range(len(prints)), links)
    for held in (16, 1e-4, 1e-9):  # six, seven and eight groups
        monkeypatch.setattr(simhash, "CELL_NODES", held)
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, fp bigint")).collect()}
        assert got == want


def test_cells():
    r = random.Random(6)
    simhash_masks = {bits: [simhash.cell_masks(bits, n) for n in (10, 10**6, 10**10)] for bits in (0, 1, 3, 4, 5)}
    for bits, kinds in simhash_masks.items():
        for masks in kinds:
            for _ in range(300):
                a = r.getrandbits(64)
                b = a
                for k in r.sample(range(64), bits):
                    b ^= 1 << k
                x, y = (sum(((v >> 2 * s) & 3).bit_count() * (1 if (v >> 2 * s) & 3 in (1, 2) else 0) << 2 * s | (3 << 2 * s if (v >> 2 * s) & 3 == 3 else 0) for s in range(32)) for v in (a, b))
                assert any(x & m == y & m for m in masks)
    assert [len(simhash.cell_masks(4, n)) for n in (1000, 10**7, 10**11)] == [15, 35, 70]


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(5, None), (3, ""), (9, " \n"), (None, ""), (None, "lonely words of no id"), (4, "a b c"), (4, "a b c")], DOCS).withColumn("fp", F.lit(1))
    got = sorted(map(repr, (tuple(r)[::2] for r in simhash.near_duplicates(simhash.fingerprints(docs)).collect())))
    assert got == sorted(map(repr, [(5, 3), (3, 3), (9, 3), (None, 3), (None, None), (4, 4), (4, 4)]))
    assert simhash.near_duplicates(simhash.fingerprints(docs.limit(0))).count() == 0


def test_similar_documents(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    docs = []
    for _ in range(25):
        base = [word() for _ in range(150)]
        docs.append(base)
        for _ in range(3):
            copy = list(base)
            for k in r.sample(range(150), r.randint(0, 4)):
                copy[k] = word()
            docs.append(copy)
    docs = [(k, " ".join(w)) for k, w in enumerate(docs)] + [(900, ""), (901, None), (None, "x y")]
    sets = {i: shingle_set(t) for i, t in docs if i is not None}
    links = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == connected(sets, links) | {None: None}


def shingle_set(text, words=5):
    """Shingles as strings; a shorter text is one."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def test_short_texts(spark):
    r, docs = random.Random(21), []
    for _ in range(60):  # texts of 1 to 100 words of a small vocabulary, and edited copies
        base = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(1, 100))]
        docs.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "new" + r.choice("abc")
            docs.append(copy[r.randint(0, 1) :])
    got, want = similar_case(spark, [(k, " ".join(w)) for k, w in enumerate(docs)])
    assert got == want and len(set(want.values())) < len(want) - 40


def test_drop_similar(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(4, text, 1), (4, text, 1), (4, text, 2), (2, text.upper(), 3), (2, "other words here", 4), (2, text + " end", 5), (None, "other  words here", 6), (None, "alone", 7), (None, "alone", 7), (8, None, 8), (7, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `row` int")
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    got = sorted(x.row for x in kept.collect())
    assert got in ([3, 4, 7, 9], [4, 5, 7, 9])  # of doc_id 2 one of two similar texts, told apart by their keys
    repeated = spark.createDataFrame([(4, text, 1), (4, text, 1), (4, text, 2)], "doc_id bigint, text string, `row` int")
    assert simhash.drop_similar(repeated).count() == 1
    assert simhash.drop_similar(docs.limit(0)).count() == 0 and simhash.similar_documents(docs.limit(0)).count() == 0


def test_long_texts(spark, monkeypatch):
    r = random.Random(31)
    base = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:-3000])), (3, " ".join(r.sample(base, len(base)))), (4, "x " * 40_000)]
    got, want = similar_case(spark, docs)
    assert got == want == {1: 1, 2: 1, 3: 3, 4: 4}
    monkeypatch.setattr(common, "BYTES_AT_ONCE", 60)
    prints = {x.doc_id: x.fp & (1 << 64) - 1 for x in simhash.fingerprints(spark.createDataFrame(docs[1:], DOCS)).collect()}
    assert prints == {i: brute_print(t, 4) for i, t in docs[1:]}


def similar_case(spark, docs):
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(docs, DOCS)).collect()}
    return got, connected(sets, links)


def test_star_and_boilerplate(spark, monkeypatch):
    r = random.Random(12)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, docs = text(200), {}
    for k in range(60):  # each 0.8 to the base in the middle and less to each other
        copy = list(base)
        for at in r.sample(range(0, 200, 5), 4):
            copy[at] = text(1)[0]
        docs[k + (k >= 30)] = copy
    docs[30] = base
    shared = text(120)  # three quarters of unrelated documents, and of two that are alike
    for k in range(100, 140):
        docs[k] = text(r.randint(30, 50)) + shared
    docs[150] = [*docs[110][:-8], *text(8)]
    docs = [(k, " ".join(w)) for k, w in docs.items()]
    got, want = similar_case(spark, docs)
    assert got == want and len({want[k] for k in range(61)}) == 1 and want[150] == want[110] and want[111] != want[110]
    monkeypatch.setattr(simhash, "ORDERED_ROWS", 3)  # the way of shingles with very many documents
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    assert similar_case(spark, docs) == (want, want)


def test_shingles_are_counted_on_all_documents(spark):
    # More documents than a sample would have held, and more of one shingle than 16 bits hold.
    docs = spark.range(66_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, F.concat(F.lit("v w x y z a"), "id")).otherwise("a b c d e f").alias("text")).repartition(3)
    want = np.zeros(simhash.COUNTERS, np.int64)
    for text, n in [("a b c d e f", 66_000 - 66), *[(f"v w x y z a{k}", 1) for k in range(7, 66_000, 1000)]]:
        want[(Runs([text.encode()]).shingles(5)[0] % np.uint64(simhash.COUNTERS)).astype(np.int64)] += n
    got = simhash.shingle_frequencies(docs, text_col="text", words=5)
    assert (got == want).all() and got.sum() == 132_000
    for counts in (got, np.arange(70_000)[::-1] * 10**6):
        assert (np.diff(simhash.ranks(counts).astype(np.int64)) > 0).tolist() == (np.diff(counts) > 0).tolist()
    assert simhash.ranks(got).dtype == np.uint16 and simhash.shingle_frequencies(docs.limit(0), text_col="text", words=5).sum() == 0


def test_far_fingerprints(spark):
    r = random.Random(13)
    docs = []
    for k in range(6):  # a short phrase many times in one copy: nearly the same shingles, another fingerprint
        base = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:100] + base[97:100] * 400 + base[100:]))]
        # As far from both, and one more of the first's fingerprint.
        docs += [(10 * k + 2, " ".join(base + base[5:8] * 400)), (10 * k + 3, " ".join(base[100:] + base[:100]))]
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in docs}
    assert any((prints[10 * k] ^ prints[10 * k + 1]).bit_count() > simhash.FAR_BITS for k in range(6))
    got, want = similar_case(spark, docs)
    assert got == want and all(want[10 * k + 1] == 10 * k for k in range(6))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, n, letters="abc"):
    b = list(a)
    for _ in range(n):
        k, kind = r.randint(0, len(b)), r.random()
        if kind < 0.4 or k == len(b):
            b.insert(k, r.choice(letters))
        elif kind < 0.7:
            b.pop(k)
        else:
            b[k] = r.choice(letters)
    return "".join(b)


def test_banded_distance_and_filters():
    r = random.Random(4)
    for _ in range(6000):
        a = "".join(r.choice("abcé") for _ in range(r.randint(0, 14)))
        b, e = edited(r, a, r.randint(0, 5)), r.randint(1, 3)
        near = edit_distance(a, b) <= e
        assert line_dedup.within(a, b, e) == near
        if near:
            (x,), (y,) = line_dedup.signatures(a.encode(), [len(a.encode())]), line_dedup.signatures(b.encode(), [len(b.encode())])
            assert int(x ^ y).bit_count() <= 2 * e
            if min(len(a), len(b)) > e:
                short, long = sorted((a, b), key=len)
                index = {(len(short), k, short[s : s + n]) for k, (s, n) in enumerate(line_dedup.segments(len(short), e))}
                assert any((m, k, long[s : s + n]) in index for m, k, s, n in line_dedup.probes(len(long), e))


def test_line_dedup(spark):
    r = random.Random(6)
    lines = ["".join(r.choice("abcdef é") for _ in range(r.randint(8, 16))).strip() + "." for _ in range(40)] + ["", "ab", " "]
    docs = [(k, "\n".join(edited(r, r.choice(lines), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randint(0, 6)))) for k in range(60)]
    first, order = {}, []
    for i, t in docs:
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                order.append((i, k, line))
                first.setdefault(line, (i, k))
    links = [(a, b) for a in first for b in first if a < b and min(len(a), len(b)) >= 8 and edit_distance(a, b) <= 2]
    roots, keep = connected(first, links), {}
    for line, place in first.items():
        keep[roots[line]] = min(place, keep.get(roots[line], place))
    gone = collections.defaultdict(list)
    for i, k, line in order:
        if (i, k) != keep[roots[line]]:
            gone[i].append(k)
    out = line_dedup.line_dedup(spark.createDataFrame(docs, DOCS).withColumn("gone_lines", F.lit("x")), edits=2, least_chars=8).collect()
    assert {x.doc_id: x.gone_lines for x in out} == {i: gone[i] for i, _ in docs}
    assert all(x.text == "\n".join(y for k, y in enumerate(x.text_before.split("\n")) if k not in x.gone_lines) for x in out)


def test_line_dedup_edges(spark):
    rows = [(2, "same line that is long enough to compare"), (None, "same line that is long enough to compare"), (3, None), (4, "\n\n"), (5, "x" * 50_000), (5, "x" * 50_000)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()
    got = sorted(repr((x.doc_id, x.text if x.text is None else len(x.text))) for x in out)
    assert got == sorted(map(repr, [(2, 0), (None, 40), (3, None), (4, 2), (5, 50_000), (5, 50_000)]))
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        on = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                on[i : i + length] = [True] * length
        kept = bytes(b for b, o in zip(t, on, strict=True) if not o)
        out.append((len(t), sum(on), sum(o and not (k and on[k - 1]) for k, o in enumerate(on)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    r = random.Random(5)
    for _ in range(150):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(12, 60))) for _ in range(r.randint(1, 8))]
        parts += [parts[0][3:40] + b"zzz"] * (r.random() < 0.5)
        for spans, want in zip(repeats.SuffixArray(parts, 12).covered(12), brute_repeats(parts, 12), strict=True):
            assert (sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2) == want[1:3]


def repeat_case(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [text(300), text(220)]
    docs = [(k, text(r.randint(0, 300)) + r.choice(["", *shared, shared[0][40:290]]) + text(r.randint(0, 300))) for k in range(40)]
    docs += [(100, docs[0][1]), (101, "short"), (102, "short"), (103, None), (104, ""), (105, "a" * 700), (106, shared[0] + shared[0][:210])]
    return docs


def test_repeats(spark, monkeypatch):
    docs = repeat_case(1)
    want = sorted((i, *x) for (i, _), x in zip(docs, brute_repeats([(t or "").encode() for _, t in docs], 200), strict=True))
    df = spark.createDataFrame(docs, DOCS).withColumn("tid", F.lit(1))
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == want
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 2)  # the way of anchors with very many contexts
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == want


def test_repeats_edges(spark):
    a, b = "".join(random.Random(2).choice("abcdefgh") for _ in range(400)), "q" * 10
    rows = [(1, a), (1, b + a[:250]), (None, a[100:] + b), (None, a[100:] + b), (2, b)]
    got = sorted(x.n_removed for x in repeats.remove_repeats(spark.createDataFrame(rows, DOCS), with_kept=True).collect())
    assert got == sorted(x[1] for x in brute_repeats([t.encode() for _, t in rows], 200))
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
