"""Layout-aware text of HTML pages.

A tree builder makes elements of the tag stream: it opens what may be implied (html, body, table bodies and rows), closes
what another tag ends (paragraphs, list items, cells, options), skips void elements and forgives stray end tags. The
renderer walks the tree without recursion and drops what isn't shown (head, scripts, templates, hidden attributes,
display:none); visibility is handed down, so a visible child of a hidden element shows. Blocks stand on lines of their own, with an empty line where margins would be; lists
carry bullets or numbers and indents; table cells are padded so that columns line up, over rows and columns that others
span; preformatted text keeps its white space. Padding is bounded: a column is padded to the greatest of WIDTHS with which
a table's padding stays in proportion to its text and rows, and only the first PADDED_COLUMNS of a row; longer cells and
further ones stand whole, without padding. Lines are indented by MOST_INDENT at most. Elements may be nested to any depth.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = frozenset("head title script style template noscript iframe object svg math audio video canvas datalist meta link base param source track area map".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption ul tr tbody thead tfoot select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir hr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
ENDS_PARAGRAPH = BLOCK - frozenset("html body option optgroup tr tbody thead tfoot caption li dd dt legend select".split())
#: A start tag of the key closes an open element of the value, unless one of the stops stands between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
}
STOPS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
SPACE = re.compile(r"[ \t\n\f\r]+")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Columns are padded to so many characters, the first of these that a table can afford, and so many of them.
WIDTHS, PADDED_COLUMNS = (60, 30, 15, 7, 0), 64
#: Spaces that a table may be padded with: for each character of its text, for each of its rows, and in any case.
PADDING_A_CHAR, PADDING_A_ROW, PADDING = 20, 200, 2000
MOST_INDENT = 80
#: Characters of texts that are given out at once.
CHARS_AT_ONCE = 4 << 20


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements by tag, without the first

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.root.attrs = dict(attrs) | self.root.attrs
            return
        if tag == "body" and self.at["body"]:
            return
        if self.at["head"] and tag not in HEAD_ONLY and tag != "head":
            self._close("head", ())
        if tag in ENDS_PARAGRAPH:
            self._close("p", ("table", "td", "th", "button", "caption"))
        if tag in CLOSES:
            for other in CLOSES[tag]:
                self._close(other, STOPS.get(tag, ("table",)))
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        self._push(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, the slash of other elements means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self.at["p"]:
            self.handle_starttag("p", [])
            self._close("p", ())
        else:
            self._close(tag, () if tag == "table" else ("table",))

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.at[tag].append(len(self.open))
        self.open.append(node)

    def _pop(self) -> None:
        self.at[self.open.pop().tag].pop()

    def _close(self, tag: str, stops: tuple) -> None:
        """Closes the last open element of a tag, unless a stop has been opened since."""
        if not self.at[tag]:
            return
        last = self.at[tag][-1]
        if not any(self.at[s] and self.at[s][-1] > last for s in stops):
            while len(self.open) > last:
                self._pop()


def displayed(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in NOT_SHOWN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() in ("hidden", "checkbox", "radio", "password")) or ("style" in a and NO_DISPLAY.search(a["style"])))


def visible(node: Node, above: bool) -> bool:
    """What the element says of its visibility, else what holds above it."""
    said = VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else []
    return said[-1].lower() == "visible" if said else above


class Lines:
    """Text under construction: inline white space collapses, blocks begin lines, margins become one empty line."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.indent, self.mark, self.gap = 0, "", False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.expandtabs(8).split("\n")
            self.line.append(first)
            for part in rest:
                self.end(keep=True)
                self.line.append(part)
            return
        s = SPACE.sub(" ", s)
        if s[:1] == " " and (not self.line or self.line[-1][-1:] in (" ", "")):
            s = s[1:]
        if s:
            self.line.append(s)

    def end(self, keep: bool = False) -> None:
        """Ends the line, if it has anything or is kept."""
        s = "".join(self.line).rstrip(" ")
        self.line = []
        if s or keep:
            if self.gap and self.done and self.done[-1]:
                self.done.append("")
            self.gap = False
            lead = " " * max(0, min(self.indent, MOST_INDENT) - len(self.mark)) + self.mark
            self.done.append((lead + s).rstrip(" ") if s or self.mark else "")
            self.mark = ""

    def space(self) -> None:
        self.gap = bool(self.done)

    def whole(self, lines: list[str]) -> None:
        for x in lines:
            self.line.append(x)
            self.end(keep=True)

    def result(self) -> str:
        self.end()
        return "\n".join(self.done).strip("\n")


def _number(node: Node, counts: dict[int, int], parent: Node | None) -> str:
    if parent is None or parent.tag != "ol":
        return "- "
    n = counts.get(id(parent), _integer(parent.attrs.get("start"), 1) - 1) + 1
    counts[id(parent)] = n = _integer(node.attrs.get("value"), n)
    return f"{n}. "


def _integer(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"-?[0-9]{1,9}", s.strip()) else default


def _width(s: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def render(root: Node) -> tuple[str, int]:
    """Visible text and the number of tables. A stack of steps stands in for recursion; nested tables render into their cells."""
    top = Lines()
    counts: dict[int, int] = {}
    tables = 0
    #: (what, node or text, lines, preformatted, list parent, visible); cells collect their texts for the end of their table.
    steps: list[tuple] = [("node", root, top, False, None, True)]

    def push(children: list, out: Lines, pre: bool, parent: Node | None, seen: bool) -> None:
        steps.extend(("text" if isinstance(c, str) else "node", c, out, pre, parent, seen) for c in reversed(children))

    while steps:
        what, x, out, pre, parent, seen = steps.pop()
        if what == "text":
            if seen:
                out.text(x, pre)
            continue
        if what == "end":
            out.end()
            out.indent -= parent
            out.mark = ""
            if x:
                out.space()
            continue
        if what == "cells":
            rows, captions = x
            out.whole([line for c in captions if (got := c.result()) for line in got.split("\n")] + _aligned([[(c.result(), span, down) for c, span, down in r] for r in rows]))
            out.space()
            continue
        if not displayed(x):
            continue
        seen = visible(x, seen)
        if x.tag == "br":
            out.end(keep=seen)
        elif x.tag == "hr":
            out.end()
            out.whole(["-" * 8] if seen else [])
        elif x.tag == "img":
            out.text(x.attrs.get("alt", "") if seen else "", False)
        elif x.tag == "input":
            out.text((x.attrs.get("value") or x.attrs.get("placeholder", "")) if seen else "", False)
        elif x.tag == "table":
            tables += 1
            out.end()
            out.space()
            rows, captions = _cells(x, seen)
            texts: list[list[tuple[Lines, int, int]]] = [[(Lines(), span, down) for _, _, span, down in r] for r in rows]
            heads = [Lines() for _ in captions]
            steps.append(("cells", (texts, heads), out, pre, None, seen))
            for r, row in zip(texts, rows, strict=True):
                for (lines, _, _), (cell, shows, _, _) in zip(r, row, strict=True):
                    push(cell.children, lines, False, cell, shows)
            for lines, (c, shows) in zip(heads, captions, strict=True):
                push(c.children, lines, False, c, shows)
        elif x.tag in BLOCK:
            spaced = x.tag in SPACED and not (x.tag in ("ul", "ol") and parent is not None and parent.tag == "li")
            out.end()
            if spaced:
                out.space()
            deeper = 0
            if x.tag == "li":
                mark = _number(x, counts, parent)
                deeper = len(mark)
                out.indent += deeper
                out.mark = mark if seen else ""
            elif x.tag in ("blockquote", "dd"):
                deeper = 4
                out.indent += deeper
            steps.append(("end", spaced, out, pre, deeper, seen))
            push(x.children, out, pre or x.tag == "pre", x, seen)
        else:
            push(x.children, out, pre or x.tag == "textarea", parent, seen)
    return top.result(), tables


def _cells(root: Node, seen: bool) -> tuple[list[list[tuple[Node, bool, int, int]]], list[tuple[Node, bool]]]:
    """Rows of (cell, whether it is visible, columns and rows it spans; 0 rows: all that follow) and captions of a table, not those of tables inside."""
    rows: list[list[tuple[Node, bool, int, int]]] = []
    captions: list[tuple[Node, bool]] = []
    stack = [(c, None, seen) for c in reversed(root.children)]
    while stack:
        x, row, seen = stack.pop()
        if isinstance(x, str):
            if x.strip():
                if row is None:
                    captions.append((_holder(x), seen))
                else:
                    row.append((_holder(x), seen, 1, 1))
            continue
        if not displayed(x):
            continue
        seen = visible(x, seen)
        if x.tag in ("td", "th"):
            if row is None:
                rows.append(row := [])
            row.append((x, seen, min(max(_integer(x.attrs.get("colspan"), 1), 1), 100), max(_integer(x.attrs.get("rowspan"), 1), 0)))
        elif x.tag == "tr":
            rows.append(own := [])
            stack += [(c, own, seen) for c in reversed(x.children)]
        elif x.tag in ("tbody", "thead", "tfoot"):
            stack += [(c, None, seen) for c in reversed(x.children)]
        elif x.tag not in ("col", "colgroup"):
            captions.append((x, seen))
    return rows, captions


def _holder(text: str) -> Node:
    node = Node("td", {})
    node.children.append(text)
    return node


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table of (text, columns, rows): a column is as wide as its widest single-column cell, up to one of WIDTHS; cells of several lines take several.

    Columns that a cell from above spans are left blank. Rows without cells give no line.
    """
    placed: list[list[tuple[int, list[str], int]]] = []
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # rows that a cell from above still spans, by column
    for row in rows:
        at, cells, new = 0, [], []
        for text, span, down in row:
            while taken.get(at, 0):
                at += 1
            lines = text.split("\n")
            cells.append((at, lines, span))
            if span == 1 and at < PADDED_COLUMNS:
                widths[at] = max([widths.get(at, 0), *(min(WIDTHS[0], _width(x)) for x in lines)])
            if down != 1:
                new += [(c, down - 1 if down else len(rows)) for c in range(at, min(at + span, PADDED_COLUMNS))]
            at += span
        cells += [(c, [""], 1) for c in taken if c < at]
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | dict(new)
        placed.append(sorted(cells))
    placed = [cells for cells, given in zip(placed, rows, strict=True) if given]
    allowed = PADDING_A_CHAR * sum(len(text) for row in rows for text, _, _ in row) + PADDING_A_ROW * len(placed) + PADDING
    rooms: list[list[int]] = []
    for widest in WIDTHS:
        rooms = [[_room(widths, at, span, widest) for at, _, span in cells] for cells in placed]
        if sum(max(map(len, (lines for _, lines, _ in cells))) * sum(room) for cells, room in zip(placed, rooms, strict=True)) <= allowed:
            break
    out = []
    for cells, room in zip(placed, rooms, strict=True):
        for k in range(max(len(lines) for _, lines, _ in cells)):
            parts = [lines[k] if k < len(lines) else "" for _, lines, _ in cells]
            out.append(" | ".join(p + " " * max(0, n - _width(p)) for p, n in zip(parts, room, strict=True)).rstrip(" "))
    return out


def _room(widths: dict[int, int], at: int, span: int, widest: int) -> int:
    """Characters that a cell has: its columns, and the bars between those that it spans."""
    if not widest:
        return 0
    return sum(min(widths.get(c, 0), widest) for c in range(at, min(at + span, PADDED_COLUMNS))) + 3 * (min(at + span, PADDED_COLUMNS) - min(at + 1, PADDED_COLUMNS))


def extract(html: str) -> tuple[str, int, dict[str, str]]:
    """Visible text, number of tables, and the attributes of the html element."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    text, tables = render(builder.root)
    return text, tables, builder.root.attrs


TEXTS = "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_tables bigint, declared string, text_sha256 string"


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """A row for each page: its visible text, and the language its html element declares ('' if none).

    Null and empty pages have empty text. Rows that repeat give rows that repeat; an empty table gives none. Other columns
    than these three are left behind, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for page_id, url, html in zip(*b.columns, strict=True):
                text, tables, attrs = extract(html.as_py())
                out.append((page_id.as_py(), url.as_py(), text, len(text), text.count("\n") + 1 if text else 0, tables, attrs.get("lang") or "", hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()))
                held += len(text)
                if held >= CHARS_AT_ONCE:
                    yield batch(TEXTS, list(zip(*out, strict=True)))
                    out, held = [], 0
            yield batch(TEXTS, list(zip(*out, strict=True)) or [[]] * 8)

    return map_arrow(pages.select(F.col(id_col).cast("bigint"), F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))), run, TEXTS)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
