import pytest

from plantpulse.llm.html_text import extract_text, page_text

CASES = {
    "implied paragraph and item ends": (
        "<p>one <b>two</b>\n three<p>four<br>five<ul><li>a<li>b<ul><li>c</ul><li>d</ul>tail",
        "one two three\n\nfour\nfive\n\n- a\n- b\n  - c\n- d\n\ntail",
    ),
    "numbered list": ("<ol start=9><li>a<li>b<p>c<li value=3>d</ol>", "9. a\n10. b\n\n    c\n3. d"),
    "table without end tags": (
        "<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>kiwi, green<td>12</table>",
        "Name         Qty\napple        3\nkiwi, green  12",
    ),
    "spans": (
        "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell<td>d<tr><td>e<td>f<td>g</table>",
        "a  b\n   c\nwide cell  d\ne  f       g",
    ),
    "sections in visual order": (
        "<table><tfoot><tr><td>sum<td>2<tbody><tr><td>x<td>1<thead><tr><td>h<td>n</table>",
        "h    n\nx    1\nsum  2",
    ),
    "lines inside cells": ("<table><tr><td>a<br>b<td>c<tr><td>d<td>e</table>", "a  c\nb\nd  e"),
    "one column is a layout": ("<table><tr><td><p>a<p>b</td></tr><tr><td>c</table>", "a\n\nb\nc"),
    "stray text in a table": ("<table>loose<tr><td>a<td>b</table>", "loose\na  b"),
    "hidden parts": (
        "<head><title>t</title><style>.x,#y{display:none} b.z{visibility:hidden} @media print{p{display:none}}"
        "</style><body><p>a<i class='q x'>b</i><i id=y>c</i><b class=z>d<u style='visibility:visible'>e</u></b>"
        "<script>var s='<p>f</p>'</script><i hidden>g</i><i style='DISPLAY : none !important'>h</i>"
        "<template>i</template><noscript>j</noscript><input type=hidden value=k><input type=submit value=ok>",
        "aeok",
    ),
    "closed and open details": (
        "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>",
        "s\nt\nyes",
    ),
    "preformatted": ("<pre>\n  a\n\tb  c\n</pre>d", "  a\n        b  c\n\nd"),
    "quotations": ("a<blockquote>b<p>c</blockquote><dl><dt>t<dd>d</dl><q>e</q>", 'a\n\n  b\n\n  c\n\nt\n    d\n\n"e"'),
    "entities and comments": ("a&nbsp;&lt;b&gt; &amp;c<!-- d --> &eacute;&#233;", "a\xa0<b> &c éé"),
    "choice": ("<select><option>a<option selected>b<option>c</select>", "b"),
    "misplaced end tags": ("a</div></p>b</span><table><tr><td>c</div></td><td>d</table>e</br>f", "a\n\nb\n\nc  d\n\ne\nf"),
    "unfinished": ("<p>a<b", "a"),
    "wide characters align": ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
}


@pytest.mark.parametrize("name", CASES)
def test_rendering(name):
    html, want = CASES[name]
    assert page_text(html) == want


def test_long_cells_keep_all_words():
    words = [f"w{i}" for i in range(200)]
    text = page_text(f"<table><tr><td>{' '.join(words)}<td>b<tr><td>c<td>d</table>")
    assert [w for w in text.split() if w.startswith("w")] == words
    assert max(map(len, text.split("\n"))) < 70


def test_deep_nesting_loses_nothing():
    deep = "".join(f"<div>{i}" for i in range(5000)) + "</div>" * 5000 + "<p>end"
    assert page_text(deep).split() == [*map(str, range(5000)), "end"]
    tables = "<table><tr><td>" * 400 + "x" + "</table>" * 400
    assert page_text(tables) == "x"


@pytest.mark.parametrize("depth", [200, 20_000])
def test_rules_hold_at_any_depth(depth):
    open_, close = "<font>" * depth, "</font>" * depth
    assert page_text(f"{open_}a<script>var x</script><style>b{{}}</style><div hidden>c</div><template>d</template>e{close}") == "ae"
    assert page_text(f"<div hidden>{open_}<div>a</div></font>b{close}</div>c") == "c"
    assert page_text(f"{open_}<span hidden>a</b></i>b</span>c</p>d{close}e") == "c\n\nde"
    assert page_text(f"{open_}<ul><li>a<li>b</ul><pre>c\n  d</pre><table><tr><td>x<td>y</table>") == (
        "- a\n- b\n\nc\n  d\n\nx  y"
    )


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<p>b"), (4, "   "), (5, "<p>" + "w " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS url")
    got = sorted(map(tuple, extract_text(df).collect()), key=repr)
    want = [(1, ""), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, ""), (5, ("w " * 200_000).strip())]
    assert got == sorted(want, key=repr)
    assert extract_text(df.limit(0)).count() == 0


def test_visible_words_of_the_pages(spark):
    """Words of all text outside scripts, styles and the head come out in order."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    for row in pages.collect():
        walker = Words()
        walker.feed(row["html"])
        found = [w for w in texts[row["page_id"]].split() if w != "-"]
        assert "".join(found) == "".join(w for w in walker.words if w != "-")
