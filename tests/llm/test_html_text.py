import pytest

from twinsieve.llm.html_text import extract, text_of

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple &copy; &unknown; &am", "plain & simple © &unknown; &am"),
    ("<p>one<p>two</p>three<br>four", "one\n\ntwo\n\nthree\nfour"),
    ("<title>t</title><body><h1>H</h1><div>a<div>b</div></div>c", "H\n\na\nb\nc"),
    ("a <b>b </b> <i> c</i>d", "a b cd"),
    ("<ul><li>x<li>y<ol><li>1<li value=7>2</ol><li>z</ul>", "* x\n* y\n    1. 1\n    7. 2\n* z"),
    ("<ol start=3><li><p>a</p><p>b</p></ol>", "3. a\n\n   b"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "name       n\nlong name  1\nx          22"),
    ("<table><caption>C</caption><tr><td colspan=2>wide<td>r<tr><td>a<td>b<td>c</table>", "C\nwide  r\na  b  c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<pre>\n a\n  b</pre>after", " a\n  b\n\nafter"),
    ("<script>var t='</p>';</script>x<style>p{}</style><!-- c --><noscript>no</noscript>", "x"),
    ("<div hidden>h</div><p style='display: none'>n</p><span style='visibility:hidden'>v</span>ok", "ok"),
    ("<p>a</p></div></span></p><p>b", "a\n\nb"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("cut <p>off <a href=", "cut\n\noff"),
    ("<td>stray</td> x", "stray x"),
    ("<textarea>a &lt; b</textarea><dialog>no</dialog><dialog open>yes</dialog>", "a < b\nyes"),
    ("<a title='x > y' href=\"u?a=1&b=2\">link</a>", "link"),
    ("<blockquote>q</blockquote>", "  q"),
    ("5 < 6 and 7 > 2 <3", "5 < 6 and 7 > 2 <3"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_text(page, text):
    assert text_of(page) == text


def test_deep_and_long():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text_of("<table><tr><td>" * 300 + "x") == "x"
    assert len(text_of("<p>word " * 20000).split()) == 20000
    assert text_of("<" * 3000 + "a='" * 2000) is not None


def test_extract(spark):
    rows = [(i, p, 1) for i, (p, _) in enumerate(CASES)] * 2
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(i, t) for i, (_, t) in enumerate(CASES)] * 2)
    assert all(r.n_lines == (len(r.text.split("\n")) if r.text else 0) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
