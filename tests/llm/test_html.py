import pytest

from siltstone.llm import html, queries
from tests.conftest import SF_DIR

CASES = {
    "<p>One <b>bold</b>, two<br>three<p>Next": "One bold, two\nthree\n\nNext",
    "<ul><li>a<li>b<ul><li>b1<li>b2</ul><li>c</ul>": "- a\n- b\n  - b1\n  - b2\n- c",
    "<ol start=3><li>x</li><li>y</li></ol>": "3. x\n4. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>fig<td>12</table>": "Name      | Qty\napple pie | 3\nfig       | 12",
    "<td>no table</td>": "no table",
    "<head><title>t</title><style>p{}</style></head>seen": "seen",
    "<title>t</title><p>seen": "seen",
    "a<script>if (a<b) x('</p>')</script>b": "ab",
    "x<div hidden>no</div>y<span style='color:red; display : none'>no</span>z": "xyz",
    "a &amp; b &#233; &lt;c&gt;": "a & b é <c>",
    "1 < 2 <3 > 4": "1 < 2 <3 > 4",
    '<a title="x>y">link</a>': "link",
    "<pre>a\n  b</pre>": "a\n  b",
    "<!-- c -->t<!-- open": "t",
    "<p>unclosed <b>and <i>nested": "unclosed and nested",
    "<div>one</div><div>two</div>": "one\ntwo",
    '<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no<i style="visibility:collapse">no</i></div>after': "yes\nafter",
    '<div style="visibility:hidden"><p>no<p style="visibility: inherit">no</div><p>yes': "yes",
    '<div hidden><b style="visibility:visible">no</b></div>yes': "yes",
    '<ol><li>a<li style="visibility:hidden">b<li>c<li value=9>d<li>e</ol>': "1. a\n3. c\n9. d\n10. e",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td colspan=2>wide<td>x<tr><td>1<td rowspan='2'>2<td>3<tr><td>4<td>5</table>": "wide |   | x\n1    | 2 | 3\n4    |   | 5",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>": "a | b\n  | c\n  | d\ne | f",
    "<table><tr><td>a<td hidden>no<td>b<tr><td>c<td>d</table>": "a | b\nc | d",
    "<table><tr><td style='visibility:hidden'>no<td>b<tr><td>c<td>d</table>": "  | b\nc | d",
    "Size <select><option>small<option selected>large<option>huge</select> only": "Size large only",
    "<select><option>first<option>second</select>": "first",
    "<select multiple><option>a</option> <option>b</option></select>": "a b",
    "<select hidden><option>a</select>b": "b",
    "<option>alone": "alone",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert html.rendered(page) == CASES[page]


def test_hostile_pages_end():
    for page in ("<div>" * 100_000 + "x", "<p" * 50_000, '<a href="x' * 20_000, "<table><tr><td>" * 2_000, "</p>" * 50_000, "<li>" * 50_000, "&" * 100_000):
        html.rendered(page)


def test_all_visible_words_come_out_once(spark, duck):
    """Against a plain reading: what is left when scripts, styles, head and comments go and tags turn to spaces."""
    import html as entities
    import re

    rows = {r.page_id: r.text for r in queries.queries()["op8_layout_html"](spark, SF_DIR).collect()}
    for page_id, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        seen = re.sub(r"(?is)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<noscript.*?</noscript>", " ", page)
        seen = entities.unescape(re.sub(r"<[^>]*>", " ", seen))
        squeeze = lambda s: re.sub(r"[\s|]|^- |(?<=\n)\s*- |(?<=\n)\s*\d+\. ", "", s)
        assert squeeze(re.sub(r"(?m)^\s*- ", "", rows[page_id])).replace("-", "") == squeeze(seen).replace("-", "")


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", None), (3, "<p>x", "t"), (3, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract(df).collect()) == [(1, ""), (2, ""), (3, "x"), (3, "x")]
    assert html.extract(df.filter("false")).count() == 0


VISIBLE = (
    'title="A hidden gem"', 'class="hidden md:block"', "aria-label='now hidden'", 'data-hidden="1"', "alt=hidden", 'data-style="display:none"',
    'title="style=display:none"', 'style="--x: 1; color: red"', 'style="overflow:hidden"', 'style="display:none; display:block"', "style=\"content:'display:none'\"", 'title="visibility:hidden"', 'style="/* display:none */"', 'style="background:url(a;display:none)"',
)
HIDDEN = ("hidden", "HIDDEN", 'hidden=""', "hidden=until-found", 'class="x"hidden', 'title="a" hidden', "style=display:none", 'style="Display : None !important"', "style='color:red;visibility:hidden'", 'STYLE = "display:none"', 'style="display:none !important; display:block"')


@pytest.mark.parametrize("attributes", VISIBLE)
def test_words_in_values_hide_nothing(attributes):
    assert html.rendered(f"a<div {attributes}>b</div>c") == "a\nb\nc"


@pytest.mark.parametrize("attributes", HIDDEN)
def test_hidden_elements_go(attributes):
    assert html.rendered(f"a<p {attributes}>b</p>c") in ("ac", "a\nc", "a\n\nc")


def test_xmp_is_preformatted_text():
    assert html.rendered("a<xmp>if  x\n <b>&amp;</xmp>c") == "a\n\nif  x\n <b>&amp;\n\nc"
    assert html.rendered("<div hidden><xmp>no</xmp></div>seen<xmp>open <p>") == "seen\n\nopen <p>"


def test_wide_cells_take_no_room():
    page = "<table>" + "<tr><td colspan=1000>a<td>b</tr>" * 2 + "<tr>" + "<td colspan=1000>c" * 300 + "</table>"
    text = html.rendered(page)
    assert text.split("\n")[0] == "a | b" and text.count("c") == 300 and len(text) < 5_000
