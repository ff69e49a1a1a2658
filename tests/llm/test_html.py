import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tidemark.llm.html import UNSEEN, VOID, extract, extracted

CASES = {
    "implied ends": ("<p>One<p>Two<ul><li>a<li>b</ul>", "One\n\nTwo\n\n- a\n- b"),
    "spaces": ("<p>a  b\n c <b> d</b>e</p>", "a b c de"),
    "nested lists": ("<ul><li>a<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n  3. x\n  4. y\n- c"),
    "table": ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"),
    "rowspan": ("<table><tr><td rowspan=2>tall<td>1<tr><td>2</table>", "tall  1\n      2"),
    "colspan": ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    "colspan 0": ("<table><tr><td colspan=0>alone</table>", "alone"),
    "colspan 0 and a cell": ("<table><tr><td colspan=0>first<td>second<tr><td>1<td>2</table>", "first  second\n1      2"),
    "list start": ("<ol start=2019><li>a<li>b</ol><ol start=-1><li>c<li>d</ol><ol start=99999999999><li>e</ol>", "2019. a\n2020. b\n\n-1. c\n0. d\n\n1. e"),
    "cell lines": ("<table><tr><td>l1<br>l2<td>r</table>", "l1  r\nl2"),
    "misplaced": ("<table>foo<tr><td>z</table>", "foo\nz"),
    "hidden": ("a<span hidden>b</span><i style='display: none'>c</i><template>d</template><script>e</script>f", "af"),
    "style sheet": ("<style>.x, #y {display:none} b{color:red}</style><p class='q x'>no</p><p id=y>no</p><b>yes</b>", "yes"),
    "print only": ("<style>@media print{nav{display:none}.x{display:none}} .y{display:none}</style><nav>a</nav><p class=x>b<p class=y>no", "a\n\nb"),
    "narrow screens": ("<style>@media screen and (max-width:9em){.x{display:none}}@media only screen{.y{display:none}}</style><p class=x>a<p class=y>no", "a"),
    "wide screens": ("<style>.x{display:none}@media (min-width:9em){.x{display:block}}@media print{.y{display:block}}.y{display:none}</style><p class=x>a<p class=y>no", "a"),
    "nested blocks": ("<style>@supports (a:b){@media screen{.x{display:none}}}.y{color:red;@media print{display:none}}@layer l{.z{display:none}}</style><p class=x>a<p class=y>b<p class=z>no", "a\n\nb"),
    "shown again": ("<style>.x{display:none}.y{visibility:hidden!important}</style><style>.x{display:block}.y{visibility:visible}</style><p class=x>a<p class=y>no", "a"),
    "shown by more": ("<style>#i{display:block}.x{display:none}p.y{display:block}.y{display:none}</style><p class=x id=i>a<p class=y>b<p class=x style='display:block'>c", "a\n\nb\n\nc"),
    "sheet's media": ("<style media=print>.x{display:none}</style><noscript><style>.y{display:none}</style></noscript><p class=x>a<p class=y>b", "a\n\nb"),
    "marks in strings": ("<style>@import url(a.css);.a{content:'}.x{display:none}'}.b{backface-visibility:hidden} /* { */ .y{display:none}</style><p class=x>a<p class=b>b<p class=y>no", "a\n\nb"),
    "details": ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    "head": ("<html><head><title>t</title></head><body>x", "x"),
    "no head end": ("<title>t</title><p>x", "x"),
    "entities": ("&lt;b&gt; &eacute;&amp;&#233;&nbsp;z", "<b> é&é\xa0z"),
    "pre": ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    "comment": ("a<!-- > b -->c<!-- open", "ac"),
    "broken": ("a<b>c</i>d</b><a href=\"x", "acd<a href=\"x"),
    "stray": ("1 < 2 </p>x", "1 < 2\n\nx"),
    "textarea": ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
    "long attribute": ('<a title="z' + "z" * 70_000 + 'more</b>">link</a>tail', "linktail"),
    "quote without end": ("<a title='x>b</a>c<i t=\"q>r\">d</i>", "bcd"),
    "none": (None, ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    html, want = CASES[name]
    assert extract(html) == want


def test_deep_and_long_pages():
    assert extract("<div>" * 30_000 + "x") == "x"
    assert extract("<ul><li>" * 2000 + "x").endswith("- x")
    assert extract("<table><tr><td>" * 1000 + "x") == "x"
    assert len(extract("<p>word " * 50_000).split()) == 50_000
    assert extract("<" * 100_000).count("<") == 100_000


def test_long_pages_of_many_kinds_are_read_in_time():
    began = time.perf_counter()
    assert extract("<ul>" * 3000 + "<li>x" * 20_000).count("x") == 20_000
    assert extract("<a '>y" * 30_000).count("y") >= 1
    assert extract("<b class=\"" + "c" * 2_000_000 + "\">z</b>") == "z"
    assert time.perf_counter() - began < 30


class Plain(HTMLParser):
    """Visible words by another parser, without layout: for pages whose rules are inline styles, ``hidden`` and simple selectors."""

    def __init__(self, classes):
        super().__init__(convert_charrefs=True)
        self.classes, self.skip, self.words = classes, [], []

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        if tag in VOID:
            return
        style = own.get("style", "").replace(" ", "").lower()
        gone = tag in UNSEEN or "hidden" in own or "display:none" in style or "visibility:hidden" in style or bool(self.classes & set(own.get("class", "").split()))
        if self.skip or gone:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_no_visible_word_of_the_pages_is_lost_or_added():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    assert len(pages) >= 20
    for p in pages:
        classes = {c for rule in re.findall(r"([^{}]*)\{[^}]*display\s*:\s*none", p["html"] or "") for c in re.findall(r"\.([\w-]+)", rule)}
        other = Plain(classes)
        other.feed(p["html"] or "")
        other.close()
        marks = re.compile(r"^(-|[0-9]+\.)$")
        words = lambda ws: sorted("".join(w for w in ws if not marks.match(w)))
        assert words(extract(p["html"]).split()) == words(other.words), p["page_id"]


def test_rows(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (None, "b")]
    d = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, html string, text string")
    got = extracted(d).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_lines"]) for r in got) == [(0, "b", 1, 1), (1, "a", 1, 1), (1, "a", 1, 1), (2, "", 0, 0)]
    assert extracted(d.limit(0)).count() == 0
