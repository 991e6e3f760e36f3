"""HTML text of deep, wide and large pages, and the layout of lists and tables against a plain rendering."""

import random

import pytest

from auditloom.llm import html_text as h


def text(html):
    return h.extract(html)[0]


@pytest.mark.parametrize("deep", [1, 600, 30_000])
def test_depth_changes_nothing(deep):
    for tag in ("b", "div", "span"):
        assert text(f"<{tag}>" * deep + "<script>var secret=1;</script><span style='display:none'>hid</span>ok<p hidden>no</p>") == "ok"
        assert text(f"<{tag}>" * deep + "<ul><li>a<li>b</ul><table><tr><td>x<td>y</table>") == "- a\n- b\n\nx | y"
        assert text(f"<{tag} style='visibility:hidden'>" * deep + "no<i style='visibility:visible'>yes</i>") == "yes"


def test_deep_lists_have_a_bounded_indent():
    got = text("<ul><li>x" * 2000)
    assert got.count("x") == 2000
    assert max(map(len, got.split("\n"))) <= h.MOST_INDENT + 1


def test_unclosed_tags_do_not_slow_later_ones_down():
    assert text("<p><button>" + "<span>" * 40_000 + "<div>" * 40_000 + "y") == "y"


def test_padding_stays_in_proportion():
    page = "<table><tr>" + ("<td>" + "x" * 60) * 64 + "<tr><td colspan=64><td>y" * 4000 + "</table>"
    assert len(text(page)) < 2_000_000
    assert text(page).count("y") == 4000
    many = "<table><tr><td colspan=64><td>y</table>" * 3000
    assert len(text(many)) < 20 * len(many)
    rows = "<tr>" + "<td rowspan=0>a" * 64 + "<tr><td>b" * 3000
    assert len(text(f"<table>{rows}</table>")) < 40 * len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_tables_and_lists_against_a_plain_rendering(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé漢") for _ in range(r.randint(0, 9)))
    html, want = "", []
    for _ in range(8):
        if r.random() < 0.5:
            rows = [[word() for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 5))]
            html += "<table>" + "".join("<tr>" + "".join(f"<{r.choice(['td', 'th'])}>{c}" for c in row) for row in rows) + "</table>"
            wide = lambda c: sum(2 if x == "漢" else 1 for x in c)
            widths = [max(wide(row[k]) for row in rows if k < len(row)) for k in range(max(map(len, rows)))]
            want.append([" | ".join(c + " " * (widths[k] - wide(c)) for k, c in enumerate(row)).rstrip() for row in rows])
        else:
            kind, start = r.choice(["ul", "ol"]), r.randint(1, 12)
            items = [word() or "z" for _ in range(r.randint(1, 4))]
            html += f"<{kind} start={start}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>"
            want.append([("- " if kind == "ul" else f"{start + k}. ") + x for k, x in enumerate(items)])
    expected = [x for block in want for x in ([*block, None])]
    got = [x for x in text(html).split("\n") if x]
    assert got == [x for x in expected if x]


def test_large_texts_of_one_batch_are_given_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(h, "CHARS_AT_ONCE", 5000)
    pages = spark.createDataFrame([(k, "u", f"<p>{'ab ' * 1000}{k}" if k % 3 else None) for k in range(30)], "page_id bigint, url string, html string").coalesce(1)
    got = {r.page_id: r.n_chars for r in h.extract_text(pages).collect()}
    assert got == {k: 3000 + len(str(k)) if k % 3 else 0 for k in range(30)}
