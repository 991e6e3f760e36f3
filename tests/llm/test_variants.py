"""Spelling variants against a comparison of all pairs, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from auditloom.llm import variants as v


def brute_words(docs, slips, least_chars, least_count):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_count}


def edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(words):
    near = {w: [x for x in words if edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: best[w] if w in best and words[best[w]] >= 2 * words[w] else None for w in words}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def documents(n, seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeß") for _ in range(r.randint(4, 9))) for _ in range(40)]

    def word():
        w = r.choice(stems[: r.choice([3, 40])])
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÀ×÷") + w[k:], w[:k] + r.choice("abÿ") + w[k + 1 :], w.upper().replace("SS", "ß")])
            w = w or "a"
        return w

    return [(k, None if k % 17 == 0 else r.choice([" ", ", ", "9", "\n", "Ā"]).join(word() for _ in range(r.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize(("slips", "tile_words", "block"), [(97, 20_000, 512), (3, 5, 4), (2, 30, 7), (0, 1, 2)])
def test_groups(spark, monkeypatch, slips, tile_words, block):
    docs = documents(60, slips)
    words = v.count_words(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), slips=slips, least_chars=3, least_count=2)
    want = brute_words(docs, slips, 3, 2)
    assert {r.word: r.n for r in words.collect()} == want
    near = v.near_words
    monkeypatch.setattr(v, "near_words", lambda w: near(w, tile_words, block))
    got = [tuple(r) for r in v.spelling_variants(words).collect()]
    assert len(want) > 100
    assert sorted(got, key=repr) == brute_groups(want)


@pytest.mark.parametrize("parts", [3, 4, 5, 6])
def test_any_number_of_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(v, "PARTS", ())
    monkeypatch.setattr(v, "MOST_PARTS", parts)
    words = brute_words(documents(50, 11), 0, 3, 1)
    found = v.spelling_variants(spark.createDataFrame(list(words.items()), v.WORDS))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_groups(words)


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    words = {long: 9, long[:-1]: 4, long[:10] + "é" + long[11:]: 2, "aaaaa": 64, "aaaab": 32, "aaabb": 16, "aabbb": 8, "abbbb": 4, "bbbbb": 2, "zzzzz": 3}
    found = v.spelling_variants(spark.createDataFrame(list(words.items()), v.WORDS))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute_groups(words)
    assert {g[2] for g in got if g[0] == "bbbbb"} == {"aaaaa"}


def test_runs_of_long_texts(monkeypatch):
    text = "".join(t or "" for _, t in documents(30, 4))
    whole = v.runs_of(text)
    monkeypatch.setattr(v, "SLICE", 13)
    assert v.runs_of(text) == whole


def test_edges(spark):
    schema = "doc_id bigint, text string, word string, n bigint, cell bigint, choice int"
    assert v.group_variants(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "hello helo Hello"), (None, "hello helo Hello"), (1, None), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000), (3, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], schema)
    got = [tuple(r) for r in v.group_variants(df, slips=0, least_chars=4, least_count=2).collect()]
    assert sorted(got) == [("hello", None, "hello", 4, 1, None), ("helo", "hello", "hello", 2, 1, 4), ("x" * 200_000, None, "x" * 200_000, 3, 0, None)]
