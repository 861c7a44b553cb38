import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacunae.llm.html_text import page_texts, visible_text


@pytest.mark.parametrize("source,text", [
    ("<p>One<p>Two  three\n four", "One\n\nTwo three four"),
    ("a<div>b</div>c", "a\nb\nc"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
    ("<table><tr><td>ab<td>c<tr><th>d</th><th>efg</th></table>", "ab  c\nd   efg"),
    ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>y</table>", "wide cell  x\na  b  y"),
    ("<table><tr><td>1<br>2<td>b</table>", "1  b\n2"),
    ("<script>var t='</p>'</script><style>p{}</style><!-- no --><b>yes</b>", "yes"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<meta charset=x>text <i>in</i>line&nbsp;&amp;&lt;", "text inline &<"),
    ("<div hidden>no</div><p style='display: none'>no<p>yes", "yes"),
    ("<details><summary>s</summary>hidden</details><details open>o</details>", "s\no"),
    ("<pre> a\n   b</pre>c", " a\n   b\n\nc"),
    ("<h1>T</h1>t<blockquote>q</blockquote>", "T\n\nt\n\n  q"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("<p>a <b>b</p> c</b></div>", "a b\n\nc"),
    ("<a href='x>y' title=\"<\">k</a> 1 < 2 <", "k 1 < 2 <"),
    ("<script>never closed", ""),
    ("<!-- never closed", ""),
    ("<table><p>before<tr><td>in</table>", "before\nin"),
    ("", ""),
])
def test_layout(source, text):
    assert visible_text(source) == text


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert visible_text(deep) == "x"
    assert visible_text("<b>" * 5_000 + "y") == "y"
    assert len(visible_text("<p>word " * 50_000).split()) == 50_000
    assert visible_text("<a '" * 20_000 + "z").endswith("z")


@pytest.mark.parametrize("opened", ["<font>", "<a>", "<span>", "<div>", "<b><i>"])
def test_layout_below_many_levels(opened):
    deep = opened * 3_000
    assert visible_text(deep + "<div hidden>secret</div>") == ""
    assert visible_text(deep + "<div hidden>a<div>b</div>c</div>d") == "d"
    assert visible_text(deep + "<ul><li>a<li>b<ol><li>c</ol></ul>") == "- a\n- b\n  1. c"
    assert visible_text(deep + "<table><tr><td>ab<td>c<tr><td>d<td>e</table>") == "ab  c\nd   e"
    assert visible_text(f"<div hidden>{deep}<p>x</p></div>y") == ("" if opened == "<div>" else "y")


def test_deep_lists_and_tables():
    lines = visible_text("<ul><li>x" * 1_000).split("\n")
    assert lines == ["  " * i + "- x" for i in range(1_000)]
    assert visible_text("<table><tr><td>" * 2_000 + "x") == "x"
    assert visible_text("<pre>" + "<b>" * 5_000 + " y") == " y"
    assert visible_text("<table>" + "<colgroup>" * 5_000 + "<tr><td>z") == "z"


@pytest.mark.parametrize("source,text", [
    ("<tr><td rowspan=2>a<td>b<tr><td>c", "a  b\n   c"),
    ("<tr><td>a<td rowspan=2>b<td>c<tr><td>dd<td>e<tr><td>f<td>g<td>h", "a   b  c\ndd     e\nf   g  h"),
    ("<tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>e<td>f<td>g", "ab    c\n      d\ne  f  g"),
    ("<tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d", "a  b\n   c\n   d"),
    ("<tbody><tr><td rowspan=9>a<td>b<tr><td>c<tbody><tr><td>d<td>e", "a  b\n   c\nd  e"),
    ("<tr><td rowspan=x>a<td>b<tr><td>c<td>d", "a  b\nc  d"),
])
def test_rowspan(source, text):
    assert visible_text(f"<table>{source}</table>") == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(
    ["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>",
     "<b>", "</b>", "<br>", "<h2>", "</h2>", "<dl>", "<dd>", "<tbody>", "</body>", "<body>", "<option>", "w1", "w2", "w3"]),
    max_size=30))
def test_no_shown_word_is_lost(parts):
    source = " ".join(parts)
    words = re.findall(r"w\d", source)
    assert sorted(re.findall(r"w\d", visible_text(source))) == sorted(words)


def test_given_pages(spark):
    """The body's words, by plain substitution, in the same order."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in page_texts(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", r.html)
        expected = html.unescape(re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", body))
        expected = re.sub(r"<[^>]*>", " ", expected).split()
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in expected if w != "-"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a", "y"), (2, "", None), (1, "<p>a", "t")],
                               "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in page_texts(df).collect()), key=str)
    assert got == [(1, ""), (1, "a"), (2, ""), (None, "a")]
    assert page_texts(df.limit(0)).collect() == []
