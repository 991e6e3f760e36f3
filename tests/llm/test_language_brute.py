"""Language identification against the same fusion written out with plain loops, over random tables."""

import math
import random
from collections import Counter, defaultdict

import pytest

from auditloom.llm import language_id as li

STEMS = {"aa": "the and with river stone", "bb": "und der mit fluss stein", "cc": "le et avec pierre été"}


def letters(text):
    out = " "
    for b in (text or "").encode() + b" ":
        c = b + 32 if 65 <= b <= 90 else b
        c = " " if c < 97 or 122 < c < 128 else c
        if c != " " or out[-1:] != " ":
            out += chr(c) if c != " " else " "
    return [ord(c) for c in out]


def grams(text):
    b = letters(text)
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        h = ((x * 65599 + y) * 65599 + z) % (1 << 32)
        out.append((h ^ (h >> 15)) % li.BINS)
    return out


def rows_of(seed, n=60):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(STEMS[k].split()) for _ in range(r.randint(1, 12)))
    out = []
    for i in range(n):
        k = r.choice(sorted(STEMS))
        said = r.choice([k, k, k, "bb", None, "", "xx-YY", k.upper() + "-ch"])
        body = r.choice([text(k), text(k), text(k), text("aa") + " " + text(k), "12 ..", "", None, "q" * 40, "zxqj kvwp " * 3])
        out.append((r.choice([i, i, None]), body, said, r.choice(["h1.aa", "h2.aa", "h3.bb", "", None]), r.choice(["aa", "bb", "", None]), k))
    return out + out[:5]


def brute(rows, model):
    languages, table, background = model
    n = len(languages)
    low = lambda x: (x or "").lower()
    seen = []
    for _, text, said, host, suffix, _ in rows:
        g = grams(text)
        mean = [sum(table[k][b] for b in g) / max(1, len(g)) for k in range(n)] + [sum(background[b] for b in g) / max(1, len(g))]
        declared = ""
        for c in low(said):
            if not "a" <= c <= "z":
                break
            declared += c
        seen.append((g, mean, declared, low(host), low(suffix), mean[:n].index(max(mean[:n])) if g else None))
    counts = defaultdict(Counter)
    for g, _, declared, host, suffix, best in seen:
        if best is not None:
            for key in (("all",), ("host", host, suffix), ("suffix", suffix), ("declared", declared)):
                counts[key][best] += 1
    total = sum(counts[("all",)].values())
    base = [(counts[("all",)][k] + 1) / (total + n) for k in range(n)]

    def lean(key, above, weight):
        c = counts.get(key, Counter())
        return [(c[k] + weight * above[k]) / (sum(c.values()) + weight) for k in range(n)]

    out = []
    for g, mean, declared, host, suffix, _ in seen:
        prior = lean(("host", host, suffix), lean(("suffix", suffix), base, li.SUFFIX_WEIGHT), li.HOST_WEIGHT) if ("host", host, suffix) in counts else base
        trust = lean(("declared", declared), base, li.DECLARED_WEIGHT) if ("declared", declared) in counts else base
        strength = min(len(g), li.EVIDENCE_GRAMS)
        f = [strength * mean[k] + math.log(prior[k]) + math.log(trust[k] / base[k]) + math.log(1 - li.BACKGROUND_PRIOR) for k in range(n)] + [strength * mean[n] + math.log(li.BACKGROUND_PRIOR)]
        best = max(f)
        posterior = 1 / sum(math.exp(x - best) for x in f)
        k = f.index(best)
        known = bool(g) and k < n
        out.append((declared, languages[k] if known else None, posterior if g else 0.0, known and posterior >= li.LEAST_POSTERIOR))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fusion(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "n bigint, doc_id bigint, text string, declared string, host string, suffix string, lang string, scores string").repartition(3)
    model = li.fit(df)
    got = {r.n: r for r in li.identify(df, model, ["n", "doc_id"]).collect()}
    assert len(got) == len(rows)
    for k, (declared, language, posterior, accepted) in enumerate(brute(rows, model)):
        assert (got[k].declared, got[k].language) == (declared, language)
        assert got[k].posterior == pytest.approx(posterior, abs=1e-4)
        assert got[k].accepted == accepted or abs(posterior - li.LEAST_POSTERIOR) < 1e-4


def test_trigram_counts_of_the_fit(spark):
    rows = rows_of(9)
    df = spark.createDataFrame([(k, r[1], r[5]) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    languages, table, _ = li.fit(df)
    for k, language in enumerate(languages):
        n = Counter(b for r in rows if r[5] == language for b in grams(r[1]))
        whole = sum(n.values()) + 0.1 * li.BINS
        assert all(table[k][b] == pytest.approx(math.log((n[b] + 0.1) / whole)) for b in [*n, 0, 1, 2])
