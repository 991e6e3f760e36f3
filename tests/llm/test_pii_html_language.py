"""Personal data, HTML text and language identification."""

import hashlib
import random
import re

import numpy as np
import pytest

from auditloom.llm import html_text, language_id, pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans():
    r, bits = random.Random(3), [*"ab.@-+ 0123456789()%é", "a@b.c", "1.2.3.4", "4111111111111111", "+1 (555) 123-4567", "0000255.1.1.1"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        got = sorted(((k, s, e) for k, s, e, ok in pii.base_matches(text) if ok), key=lambda x: (x[1], pii.KINDS.index(x[0])))
        assert got == brute(text), text


@pytest.fixture(scope="module")
def model():
    x, y = pii._written()
    held = np.random.default_rng(0).random(len(y)) < 0.25
    trees = pii.Trees().fit(x[~held], y[~held])
    scores = trees.score(x[held])
    assert ((scores > 0.5) == y[held]).mean() > 0.97  # held-out accuracy
    return trees, pii.thresholds(scores, y[held], x[held, 0].astype(int))


def test_added_spans(model):
    texts = {'my token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok': "secret", "write to john (at) mail (dot) com now": "email", "call (555) 123-4567 now": "phone"}
    for text, kind in texts.items():
        base, added = pii.find_spans(text, *model)
        assert not base and [k for k, _, _ in added] == [kind], (text, added)
    for clean in ["plain words only.", "", "on 2024-01-02 10:11:12", "version 1.2", "x" * 50_000, "1" * 30_000]:
        assert pii.find_spans(clean, *model) == ([], []), clean[:40]
    base, added = pii.find_spans("a@b.org " * 300, *model)
    assert len(base) == 300 and not added


def test_numbers_side_by_side_and_long_tokens(model):
    found = lambda text: [(k, text[s:e]) for k, s, e in pii.find_spans(text, *model)[1]]
    assert found("pay 7536784127813050 4845168114407329 now") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert found("Des +1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081")]
    assert not any(k == "card" for k, _ in found("card 4111 1111 1111 1112 now"))  # fails Luhn
    text, token = "1 22 333 4444 55555 666666", "a1B2c3D4" * 50
    got = {text[s:e] for s, e, _ in pii.numbers(text)}
    groups = text.split()
    assert got == {x for i in range(6) for j in range(i, 6) for x in [" ".join(groups[i : j + 1])] if 9 <= len(x.replace(" ", "")) <= 19}
    for text in (f"see {token} end", f'token = "{token}" end'):
        assert ("secret", text.index(token), text.index(token) + len(token)) in set(pii.candidates(text))
    assert max(map(len, (list(pii.numbers(t)) for t in ("1 " * 20_000, "1" * 40_000)))) <= 20_000 * 19


def test_pii_rows(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd 1.2.3.4"), (2, None), (3, "no"), (None, "+1 (555) 123-4567")], "doc_id bigint, text string").withColumn("spans", pii.F.lit(1))
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert got[1].spans.split(",")[:2] == ["email:2:8", "ip:9:16"] and got[1].n_email == got[1].n_ip == 1
    assert [got[k].n_spans for k in (1, 2, 3, None)] == [2, 0, 0, 1]
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_phone == 1
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["<phone>", "é <email> <ip>", None, "no"]
    assert pii.find_pii(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z", "- one\n- two\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>apple pie<td>3<tr><td>x<td>10</table>after", "Name      | N\napple pie | 3\nx         | 10\n\nafter"),
        ("<pre>a\n  b</pre>x  y<br>z<br><br>w", "a\n  b\n\nx y\nz\n\nw"),
        ("<title>t</title><div hidden>no</div><span style='color:red; display:none'>no</span>yes<script>1<2</script>", "yes"),
        ("a &amp; b&nbsp;<b>c</b> <i> d</i>", "a & b\xa0c d"),
        ("<table><tr><td>a<table><tr><td>in1<td>in2</table><td>b</table>", "a         | b\n          |\nin1 | in2 |"),
        ("", ""),
        ("<div>" * 3000 + "deep", "deep"),
        ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html)[0] == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b", "<html lang=en><p>x"), (2, None, None), (None, "u", "y")], "page_id bigint, url string, html string").withColumn("text", html_text.F.lit(1))
    got = {r.page_id: (r.text, r.declared, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert got == {1: ("x", "en", 1), 2: ("", "", 0), None: ("y", "", 1)}
    assert html_text.extract_text(pages.limit(0)).count() == 0


WORDS = {"en": "the and with from this that house water".split(), "de": "der und mit von dieser haus wasser über wort".split(), "fr": "le et avec de cette maison eau élève wort".split()}


def labelled(n, seed):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang, f"h{k % 3}") for k in range(n) for lang in [r.choice(list(WORDS))]]


def test_language(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    model = language_id.fit(spark.createDataFrame(labelled(300, 1), schema))
    assert model[0] == ["de", "en", "fr"]
    held = labelled(200, 2)
    odd = [(900, None, "en", None), (901, "123 !!", None, "h1"), (902, "zqxjk vwxyz qqqq kkjjx " * 20, "en", "h1"), (None, "the house with water and this", "de", "h0")]
    got = {r.doc_id: r for r in language_id.identify(language_id.document_evidence(spark.createDataFrame(held + odd, schema)), model, ["doc_id"]).collect()}
    assert np.mean([got[i].language == lang for i, _, lang, _ in held]) > 0.98  # held-out accuracy
    assert np.mean([got[i].accepted for i, *_ in held]) > 0.98
    assert not any(got[k].accepted for k in (900, 901, 902)) and got[900].language is None and got[None].language == "en"
    assert language_id.identify(language_id.document_evidence(spark.createDataFrame([], schema)), model, ["doc_id"]).count() == 0
    assert language_id.identify(language_id.document_evidence(spark.createDataFrame(odd, schema)), language_id.fit(spark.createDataFrame([], schema)), ["doc_id"]).count() == 4


def test_priors_decide_short_texts(spark):
    model = language_id.fit(spark.createDataFrame(labelled(300, 1), "doc_id bigint, text string, lang string, source string"))
    rows = [(k, " ".join(WORDS["de"]), "de", "h.de", "de") for k in range(60)] + [(100, "wort", "", "h.de", "de"), (101, "wort", "", "h.fr", "fr")] + [(200 + k, " ".join(WORDS["fr"]), "fr", "h.fr", "fr") for k in range(60)]
    got = {r.k: r.language for r in language_id.identify(spark.createDataFrame(rows, "k int, text string, declared string, host string, suffix string"), model, ["k"]).collect()}
    assert got[100] == "de" and got[101] == "fr"


def test_every_label_has_a_model(spark):
    r, schema = random.Random(21), "doc_id bigint, text string, lang string, source string"
    words = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(12)] for k in range(70)}
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(40))
    rare = [(k, text(lang), lang, "h") for k, lang in enumerate(words)]
    often = [(1000 + k, text("l00"), "l00", "h") for k in range(400)] + [(5000 + k, text("l00"), None, "h") for k in range(400)]
    docs = spark.createDataFrame(rare + often, schema)
    model = language_id.fit(docs, label_docs=20)
    assert model[0] == sorted(words)
    got = {x.doc_id: x for x in language_id.identify(language_id.document_evidence(docs), model, ["doc_id"]).collect()}
    assert all(got[k].language == lang and got[k].accepted for k, _, lang, _ in rare)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words here", None, "h"), (2, "123 !!", None, "h"), (3, None, None, None)], "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: (x.language, x.accepted) for x in language_id.identify(language_id.document_evidence(docs), language_id.fit(docs), ["doc_id"]).collect()}
    assert got == {1: (None, True), 2: (None, False), 3: (None, False)}


def test_html_tables_and_visibility():
    text = lambda html: html_text.extract(html)[0]
    assert text("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A | b\n  | c\nd | e"
    assert text("<table><tr><td>x<td rowspan=0>y<tr><td>p<tr><td>q<td>r</table>") == "x | y\np\nq |   | r"
    assert text("<table><tr><td colspan=2 rowspan=2>wide<td>1<tr><td>2<tr><td>a<td>b<td>c</table>") == "wide  | 1\n  |   | 2\na | b | c"
    assert text('<div style="visibility:hidden">no <b style="visibility: visible">yes</b><p>no<p style="x:y; VISIBILITY:visible">shown</div>after') == "yes\n\nshown\n\nafter"
    assert text('<table style="visibility:hidden"><tr><td>no<td style="visibility:visible">yes</table>') == " | yes"
    assert text('<p style="display:none">no <b style="visibility:visible">no</b></p>ok') == "ok"


def test_html_long_pages():
    long_cell = "y" * 20_000
    page = f"<table><tr><td>{long_cell}<td>z" + "<tr><td>a<td>b" * 5000 + "</table>"
    found = html_text.extract(page)[0]
    assert long_cell in found and found.count("\n") == 5000 and len(found) < 12 * len(page)
    wide = "<table><tr>" + "<td rowspan=9999 colspan=100>" * 300 + "<tr><td>k" * 8000 + "</table>"
    assert len(html_text.extract(wide)[0]) < 24 * len(wide)
    import time

    began = time.time()
    html_text.extract("<div><b>" * 100_000 + "<p>" * 50_000 + "end")
    assert time.time() - began < 20


def test_html_against_a_plain_renderer():
    """Random trees of well-formed markup: the visible words in order, by recursion."""
    r = random.Random(40)
    names = iter(range(10**9))

    def tree(depth):
        kind = r.choice(["text", "text", "div", "p", "span", "ul", "table", "hidden", "unseen", "seen", "script"]) if depth else "text"
        if kind == "text":
            return ("text", f"w{next(names)}")
        if kind == "table":
            return (kind, [[("td", [tree(0) for _ in range(r.randint(0, 2))]) for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 3))])
        return (kind, [tree(0 if kind in ("p", "script") else depth - 1) for _ in range(r.randint(0, 3))])

    def markup(node):
        kind, x = node
        if kind == "text":
            return x + " "
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join("<td>" + "".join(map(markup, cell)) + "</td>" for _, cell in row) + "</tr>" for row in x) + "</table>"
        inside = "".join("<li>" + markup(c) + "</li>" if kind == "ul" else markup(c) for c in x)
        tag, style = {"hidden": ("div", " style='display:none'"), "unseen": ("div", " style='visibility:hidden'"), "seen": ("div", " style='visibility:visible'")}.get(kind, (kind, ""))
        return f"<{tag}{style}>{inside}</{tag}>"

    def words(node, seen):
        kind, x = node
        if kind == "text":
            return [x] if seen else []
        if kind in ("hidden", "script"):
            return []
        if kind == "table":
            return [w for row in x for _, cell in row for c in cell for w in words(c, seen)]
        seen = {"unseen": False, "seen": True}.get(kind, seen)
        return [w for c in x for w in words(c, seen)]

    for _ in range(400):
        nodes = [tree(4) for _ in range(3)]
        assert re.findall(r"w[0-9]+", html_text.extract("".join(map(markup, nodes)))[0]) == [w for n in nodes for w in words(n, True)]


def test_html_rows(spark):
    rows = [(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (2, None, None, 2), (None, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted((repr(x.page_id), x.text) for x in html_text.extract_text(pages).collect())
    assert got == [("1", "a"), ("1", "a"), ("2", ""), ("None", "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0
