"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

The builder keeps a stack of open elements: start tags close what they imply (a paragraph before a block, a list item
before the next, a cell or row before the next), end tags close down to their element unless a table cell stands between,
void elements hold nothing, and raw text (scripts, styles) is read to its end tag. What a browser doesn't show is
left out: head, scripts, templates and the like, ``hidden``, inline styles with display:none or visibility:hidden,
the same from simple selectors of the page's own style sheets, closed ``details`` and ``dialog``. Of the declarations for
an element the one that wins by importance, layer, selector and order counts. Rules in a block (``@media``, ``@supports`` and
the like, or a sheet's ``media``) hide only where every screen meets it, and show where some screen may.

All other text is emitted. Blocks stand on their own lines, paragraphs and headings apart by an empty line, white space is
collapsed except in ``pre``, list items have marks or numbers and hang under them, and table cells are laid out in
columns as wide as their widest line, with spans over columns and rows.

Rendering follows the stream of tags with explicit stacks: depth is bounded by memory only, and the work is linear in
the page but for the padding of cells. Defined results: a null page and an empty one give an empty text; pages of
any length are read whole; repeated rows give equal texts; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import bounded_batches, table

#: Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object video audio canvas datalist meta link base param source track map area".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu dir".split())
BLOCK = PARAGRAPH | frozenset("html body div section article header footer nav main aside address li dt dd form center details summary figcaption legend dialog option optgroup caption hgroup search".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPE = frozenset("table td th caption html template button".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Up to a quote or the end of the tag; a tag whose quotes don't match, to its end without them.
UNQUOTED, LOOSE = re.compile(r"[^>\"']*"), re.compile(r"[^<>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
#: Of a style sheet: comments, strings, escapes, marks, and what stands between.
CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?|\\.|[{};]|[^{};"'/\\]+|.""", re.S)
MEDIA = re.compile(r"(?:(not|only)\s+)?([a-z][a-z-]*)?\s*(.*)", re.S)
HIDES = {"display": ("none",), "visibility": ("hidden", "collapse"), "content-visibility": ("hidden",)}
VALUE = re.compile(r"[a-z][a-z -]*$|var\(")
#: Blocks of rules that hold under a condition which is not evaluated.
CONDITIONS = frozenset("supports container scope document -moz-document".split())
NEVER, SOMETIMES, ALWAYS = range(3)
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?$")
ORDINAL = re.compile(r"[ \t\n\r\f]*([+-]?)0*([0-9]{1,10})(?![0-9])")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Flow:
    """Lines of text of one block context (the page or a cell)."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # breaks asked for since the last text: 1 a new line, 2 an empty one
        self.space = False
        self.margin: list[list[str]] = []  # of open lists: mark to print once, then blanks

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            if first:
                self._put(first)
            for part in rest:
                self._newline()
                if part:
                    self._put(part)
            return
        words = SPACE.sub(" ", s)
        if words == " " or not words:
            self.space |= bool(words) and bool(self.line)
            return
        if words[0] == " ":
            self.space |= bool(self.line) and not self.gap
            words = words[1:]
        tail = words[-1] == " "
        self._put(words[:-1] if tail else words)
        self.space = tail

    def _put(self, s: str) -> None:
        if self.gap:
            self._newline()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.line:
            self.line.append("".join(m[0] for m in self.margin))
            for m in self.margin:
                m[0] = m[1]
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def _newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif self.gap == 0:
            self.lines.append("")
        self.space = False

    def asks(self, gap: int) -> None:
        if self.line or self.lines:
            self.gap = max(self.gap, gap)
        self.space = False

    def breaks(self) -> None:
        if self.gap:
            self.gap = max(self.gap, 2 if not self.line and self.gap > 1 else self.gap)
        if self.line:
            self._newline()
            self.gap = 0
        else:
            self.lines.append("") if self.lines else None

    def block(self, lines: list[str]) -> None:
        for s in lines:
            self.asks(1)
            self._put(s)

    def done(self) -> list[str]:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


class Grid:
    """Cells of a table in rows and columns."""

    def __init__(self) -> None:
        self.rows: list[dict[int, tuple[list[str], int]]] = []
        self.busy: dict[int, int] = {}  # column: rows that a cell from above still covers
        self.column = 0

    def new_row(self) -> None:
        self.busy = {c: n - 1 for c, n in self.busy.items() if n > 1} if self.rows else {}
        self.rows.append({})
        self.column = 0

    def cell(self, lines: list[str], wide: int, high: int) -> None:
        if not self.rows:
            self.new_row()
        while self.column in self.busy:
            self.column += 1
        self.rows[-1][self.column] = (lines, wide)
        if high > 1:
            for c in range(self.column, self.column + wide):
                self.busy[c] = high
        self.column += wide

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        spans = sorted((wide, c, max(map(len, lines), default=0)) for row in self.rows for c, (lines, wide) in row.items())
        for wide, c, need in spans:
            have = sum(width.get(k, 0) for k in range(c, c + wide)) + 2 * (wide - 1)
            if need > have:
                width[c + wide - 1] = width.get(c + wide - 1, 0) + need - have
        used = [c for c in sorted({c + k for row in self.rows for c, (_, wide) in row.items() for k in range(wide)})]
        start, at = {}, 0
        for c in used:
            start[c] = at
            at += width.get(c, 0) + 2 if width.get(c, 0) else 0
        out = []
        for row in self.rows:
            for i in range(max((len(x) for x, _ in row.values()), default=0)):
                line = ""
                for c in sorted(row):
                    lines = row[c][0]
                    if i < len(lines) and lines[i]:
                        line = line.ljust(start[c]) + lines[i]
                if line or i:
                    out.append(line.rstrip())
        return out


class Element:
    __slots__ = ("hidden", "items", "kind", "mark", "name", "pre", "save")

    def __init__(self, name: str, hidden: bool, pre: bool):
        self.name, self.hidden, self.pre = name, hidden, pre
        self.items = 0
        self.kind = self.save = self.mark = None


def number(s: str | None, default: int, most: int = 1000) -> int:
    return min(int(s), most) if s and s.strip().isascii() and s.strip().isdigit() else default


def ordinal(s: str | None, default: int) -> int:
    """A list number as browsers read it: signed, what follows the digits is ignored, and none beyond 32 bits."""
    m = ORDINAL.match(s or "")
    n = int(m[1] + m[2]) if m else default
    return n if -(1 << 31) <= n < 1 << 31 else default


def screens(query: str) -> int:
    """Of a media query list: ALWAYS if every screen meets it, SOMETIMES if some may, NEVER if none does."""
    if not query.strip():
        return ALWAYS
    best = NEVER
    for q in query.lower().split(","):
        m = MEDIA.match(q.strip())
        holds = (ALWAYS if not m[3] else SOMETIMES) if m[2] in ("screen", "all") else SOMETIMES if not m[2] and m[3] else NEVER
        if m[1] == "not" and m[2]:
            holds = ALWAYS - holds
        best = max(best, holds)
    return best


def declared(text: str) -> tuple[str, bool, bool] | None:
    """(property, whether it hides, whether it is important) of a declaration that decides on visibility."""
    name, _, value = text.partition(":")
    name = name.strip().lower()
    if name not in HIDES:
        return None
    value, mark, _ = value.lower().partition("!")
    value = value.strip()
    return (name, value in HIDES[name], bool(mark)) if VALUE.match(value) else None


def simple(selectors: str) -> list[tuple[str, str, str]]:
    found = [m for x in selectors.split(",") if (m := SIMPLE.match(x.strip())) and (m[1] or m[2])]
    return [((m[1] or "").lower(), m[2] or "", m[3] or "") for m in found]


def sheet(css: str, rules: dict[tuple[str, str, str], dict[str, tuple]], order: Iterator[int], media: str = "") -> None:
    """Adds to ``rules``, by simple selector (tag, mark, name) and property, the declaration that wins: (weight, hides).

    A rule that hides counts only if it holds for every screen; one that shows counts if it may hold for some.
    """
    # Of open blocks: when they hold, whether in a layer, and the selectors that declarations in them are for.
    blocks: list[tuple[int, bool, list[tuple[str, str, str]] | None]] = [(screens(media), False, None)]
    held: list[str] = []

    def declare() -> None:
        when, layered, selectors = blocks[-1]
        d = declared("".join(held)) if selectors and when else None
        held.clear()
        if d is None or (d[1] and when != ALWAYS):
            return
        name, hides, important = d
        for tag, mark, own in selectors:
            weight = (important, important == layered, mark == "#", mark == ".", bool(tag))
            had = rules.setdefault((tag, mark, own), {}).get(name)
            if had is None or weight >= had[0][:-1]:
                rules[tag, mark, own][name] = ((*weight, next(order)), hides)

    for m in CSS.finditer(css):
        token = m[0]
        if token[:2] == "/*":
            continue
        when, layered, selectors = blocks[-1]
        if token == "{":
            head = "".join(held).strip()
            held.clear()
            if head[:1] == "@":
                name, _, rest = re.sub(r"^(@[\w-]+)", r"\1 ", head)[1:].partition(" ")
                name = name.lower()
                own = screens(rest) if name == "media" else ALWAYS if name == "layer" else SOMETIMES if name in CONDITIONS else NEVER
                blocks.append((min(when, own), layered or name == "layer", selectors))
            else:
                blocks.append((when, layered, simple(head) if selectors is None else []))
        elif token == "}" and len(blocks) > 1:
            declare()
            blocks.pop()
        elif token == ";" and selectors is not None:
            declare()
        elif token == ";" and held and held[0][0] == "@":
            held.clear()
        elif token := token if held else token.lstrip():
            held.append(token)
    declare()


class Page:
    """Builds the tree and renders it as its elements open and close."""

    def __init__(self, html: str):
        self.html = html
        self.flow = Flow()
        self.stack = [Element("html", False, False)]
        self.rules: dict[tuple[str, str, str], dict[str, tuple]] = {}
        self.order = itertools.count()
        self.grids: list[Grid] = []
        self.lists: list[Element] = []
        self.open: Counter[str] = Counter()

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at a place, quotes of any length skipped; -1 if they don't match."""
        html = self.html
        while at <= self.last:
            at = UNQUOTED.match(html, at).end()
            if at > self.last or html[at] == ">":
                return at if at <= self.last else -1
            quote = html[at]
            close = html.find(quote, at + 1) if at < self.unmatched[quote] else -1
            if close < 0:
                self.unmatched[quote] = min(at, self.unmatched[quote])
                return -1
            at = close + 1
        return -1

    def text(self) -> str:
        html, at = self.html, 0
        self.last = html.rfind(">")
        #: From where on a quote has no other behind it.
        self.unmatched = {'"': len(html), "'": len(html)}
        while at < len(html):
            mark = html.find("<", at)
            if mark != at:
                self.data(html[at:] if mark < 0 else html[at:mark])
                at = len(html) if mark < 0 else mark
                continue
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(html)
                continue
            if html.startswith(("<!", "<?"), at):
                end = html.find(">", at)
                at = end + 1 if end >= 0 else len(html)
                continue
            m = TAG.match(html, at)
            end = self.tag_end(m.end()) if m else -1
            if m and end < 0:
                loose = LOOSE.match(html, m.end()).end()
                end = loose if html.startswith(">", loose) else -1
            if end < 0:
                self.data("<")
                at += 1
                continue
            name, given, at = m[2].lower(), html[m.end() : end], end + 1
            if m[1]:
                self.end(name)
                continue
            own = dict((k.lower(), unescape(v.strip("\"'")) if v else "") for k, v in reversed(ATTRIBUTE.findall(given)))
            self.start(name, own)
            if name in RAW:
                close = re.compile(rf"</{name}\s*/?>", re.I).search(html, at)
                raw = html[at : close.start()] if close else html[at:]
                at = close.end() if close else len(html)
                if name == "style":
                    if not (self.open["noscript"] or self.open["template"]):
                        sheet(raw, self.rules, self.order, own.get("media", ""))
                elif name == "textarea":
                    self.data(raw)
                self.end(name)
        while len(self.stack) > 1:
            self.close()
        return "\n".join(self.flow.done())

    def data(self, s: str) -> None:
        top = self.stack[-1]
        if top.hidden or top.kind == "closed":
            return
        if top.name in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "html") and not s.strip(" \t\n\r\f"):
            return
        if top.name in ("table", "tbody", "thead", "tfoot", "tr") and self.grids:
            self.start("td" if top.name == "tr" else "tr", {})  # misplaced text is not lost
            return self.data(s)
        self.flow.text(unescape(s), top.pre)

    def unseen(self, name: str, own: dict[str, str]) -> bool:
        if name in UNSEEN or "hidden" in own or (name == "input") or (name == "dialog" and "open" not in own):
            return True
        wins: dict[str, tuple] = {}
        if self.rules:
            marks = [("", "")] + [(".", c) for c in own.get("class", "").split()] + [("#", own.get("id", ""))]
            for found in (self.rules.get((tag, *mark)) for mark in marks for tag in (name, "") if tag or mark[0]):
                for k, rule in (found or {}).items():
                    wins[k] = max(wins.get(k, rule), rule)
        for part in own.get("style", "").split(";"):
            if d := declared(part):
                rule = ((d[2], True, 2), d[1])
                wins[d[0]] = rule if d[0] not in wins or rule[0] >= wins[d[0]][0] else wins[d[0]]
        if any(hides for _, hides in wins.values()):
            return True
        parent = self.stack[-1]
        return parent.kind == "closed" and name != "summary"

    def close_to(self, names: frozenset[str] | set[str], stop: frozenset[str] | set[str]) -> bool:
        """Closes down to the nearest of ``names`` if none of ``stop`` stands before it."""
        if not any(self.open[n] for n in names):
            return False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                while len(self.stack) > i:
                    self.close()
                return True
            if self.stack[i].name in stop:
                return False
        return False

    def start(self, name: str, own: dict[str, str]) -> None:
        if name == "html" or (name == "body" and self.open[name]):
            return
        if name in ("body", "frameset"):
            self.close_to({"head"}, set())
        elif self.stack[-1].name == "head" and name not in UNSEEN:
            self.close()  # the head ends where something else begins
        if name in CLOSES_P:
            self.close_to({"p"}, SCOPE)
        if name == "li":
            self.close_to({"li"}, SCOPE | {"ul", "ol", "menu", "dir"})
        elif name in ("dt", "dd"):
            self.close_to({"dt", "dd"}, SCOPE | {"dl"})
        elif name in ("option", "optgroup"):
            self.close_to({"option"}, {"select"})
        elif name in ("td", "th"):
            self.close_to({"td", "th"}, {"table"})
            if self.grids and self.stack[-1].name != "tr":
                self.start("tr", {})
        elif name in ("tr", "tbody", "thead", "tfoot"):
            self.close_to({"tr", "caption"} if name == "tr" else {"tbody", "thead", "tfoot"}, {"table"}) or self.close_to({"tr", "caption"}, {"table"})
        if name in VOID:
            if not self.stack[-1].hidden and not self.unseen(name, own):
                if name == "br":
                    self.flow.breaks()
                elif name == "hr":
                    self.flow.asks(2)
            return
        parent = self.stack[-1]
        e = Element(name, parent.hidden or self.unseen(name, own), parent.pre or name in ("pre", "textarea"))
        self.stack.append(e)
        self.open[name] += 1
        if name in LISTS:
            self.lists.append(e)
        if name == "details" and "open" not in own:
            e.kind = "closed"
        if e.hidden:
            return
        if name in ("td", "th") and self.grids:
            e.save, self.flow = (self.flow, max(1, number(own.get("colspan"), 1)), number(own.get("rowspan"), 1)), Flow()
        elif name == "tr" and self.grids:
            self.grids[-1].new_row()
        elif name == "table":
            self.flow.asks(2)
            self.grids.append(Grid())
            e.kind = "grid"
        elif name in BLOCK:
            inner = name in ("ul", "ol") and self.open["li"] > 0
            self.flow.asks(1 if inner or name not in PARAGRAPH else 2)
            if name in LISTS:
                e.items = ordinal(own.get("start"), 1) - 1
            elif name == "li":
                if self.lists:
                    lists = self.lists[-1]
                    lists.items = number(own.get("value"), lists.items + 1, 10**9)
                    mark = f"{lists.items}. " if lists.name == "ol" else "- "
                else:
                    mark = "- "
                e.mark = [mark, " " * len(mark)]
                self.flow.margin.append(e.mark)
            elif name in ("dd", "blockquote"):
                e.mark = ["  ", "  "]
                self.flow.margin.append(e.mark)
        elif name == "q":
            self.flow.text('"', True)

    def end(self, name: str) -> None:
        if name in VOID:
            return self.start("br", {}) if name == "br" else None
        if name == "p" and not self.open["p"]:
            return self.start("p", {}) or self.close()
        barrier = set() if name in ("table", "body", "html", "tr", "tbody", "thead", "tfoot", "td", "th") else {"td", "th", "table", "caption"}
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            barrier = {"table"}
        if name in ("html", "body"):
            return None
        self.close_to({name}, barrier)
        return None

    def close(self) -> None:
        e = self.stack.pop()
        self.open[e.name] -= 1
        if e.name in LISTS:
            self.lists.pop()
        if e.hidden:
            return
        if e.save is not None:
            flow, wide, high = e.save
            lines, self.flow = self.flow.done(), flow
            self.grids[-1].cell(lines, wide, high)
        elif e.kind == "grid":
            self.flow.block(self.grids.pop().lines())
            self.flow.asks(2)
        elif e.name in BLOCK:
            if e.mark is not None and self.flow.margin and self.flow.margin[-1] is e.mark:
                self.flow.margin.pop()
            elif e.mark is not None:
                self.flow.margin = [m for m in self.flow.margin if m is not e.mark]
            inner = e.name in ("ul", "ol") and self.open["li"] > 0
            self.flow.asks(1 if inner or e.name not in PARAGRAPH else 2)
        elif e.name == "q":
            self.flow.text('"', True)


def extract(html: str | None) -> str:
    """All visible text of a page, laid out."""
    return Page(html).text() if html else ""


def extracted(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: key, text, n_chars, n_lines, text_sha256."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(x.as_py()) for x in part.column(1)]
                yield pa.record_batch(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())],
                    names=[key, "text", "n_chars", "n_lines", "text_sha256"],
                )

    return pages.select(key, html).mapInArrow(render, f"`{key}` {kind}, text string, n_chars long, n_lines long, text_sha256 string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
