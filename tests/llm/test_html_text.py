import html
import re
import time

import pytest

from corpusloom.llm import html_text
from corpusloom.llm.html_text import main_text

CASES = [
    (None, ""),
    ("", ""),
    ("<html><head><title>T</title></head><body></body></html>", ""),
    ("plain text only &amp; more", "plain text only & more"),
    ("<p>one<p>two", "one\ntwo"),
    ("<p>a <b>b</b>c<br>d &nbsp; \n e</p>", "a bc d e"),
    ("a < b & c <!-- never closed", "a < b & c"),
    ("<article>yes</article><script>if (a<b) {", "yes"),
    ("<article><p>x</p><div class='comment-list'>no</div><form>no</form></article><footer>no</footer>", "x"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\nc"),
    ("<article><ul><li>x<li>y</ul><p>z</article>", "x\ny\nz"),
    ("<ARTICLE><P>&#233;&eacute;&#x41;</P></ARTICLE>", "ééA"),
    ("<article><p>t</p><aside>no</aside><div id=cookie-notice>no</div><div class=ad>no</div></article>", "t"),
    (
        "<body><div class='sidebar'><ul><li><a href=x>a</a></ul></div><div id=content><h1>T</h1><div class=txt>"
        "<p>Long text here of many words indeed yes</p><p>Short.</p></div></div>"
        "<div class=comments><p>comment by a reader which is long and longer and longest of all</p></div></body>",
        "T\nLong text here of many words indeed yes\nShort.",
    ),
    (
        "<main><section><h2>A</h2><p>para one is long enough</p></section>"
        "<section><h2>B</h2><p>para two is long enough too</p></section></main>",
        "A\npara one is long enough\nB\npara two is long enough too",
    ),
    (
        "<body><nav><a href=1>x</a></nav><p>First of the paragraphs in the body.</p><p>Second one.</p></body>",
        "First of the paragraphs in the body.\nSecond one.",
    ),
    (
        "<div class='page has-sidebar'><div class=sidebar-content>no</div><div class='wrapper'><div class='article-header'>"
        "<h1>T</h1></div><p>The body of the article is here.</p><p>And it goes on here.</p></div>"
        "<div class='comments-container'><p>no no no no no no no no no no no no no no</p></div></div>",
        "T\nThe body of the article is here.\nAnd it goes on here.",
    ),
    (
        "<article class='post comments-open'><div class=entry-header><h1>T</h1></div><p>x</p><div class=related-posts>no</div>"
        "<article class=comment>no</article><div id=td-ad-slot>no</div><div class=cookieBanner>no</div></article>",
        "T\nx",
    ),
    ("<article><p>t</p><p hidden>no</p><p style='display: none'>no</p><div role=alert>no</div></article>", "t"),
    (
        "<article><h2 id='related-work'>A</h2><p>a</p><h2><span id='Popular_culture'>B</span></h2><p>b</p>"
        "<section id='discussion'><h2 id='search-algorithms'>C</h2><p>c</p></section>"
        "<div id='hidden-markov-models'><p>d</p></div><div id=comments>no</div></article>",
        "A\na\nB\nb\nC\nc\nd",
    ),
    (
        "<main><h2 id=copyright>A</h2><p>para one is long enough</p>"
        "<section id=discussion><h2>B</h2><p>para two is long enough too</p></section></main>",
        "A\npara one is long enough\nB\npara two is long enough too",
    ),
    ("<body><form id=form1 class=search-form><article><p>x</p><form>no</form></article></form></body>", "x"),
    (
        "<body><form id=aspnetForm><input name=state><nav>no</nav><div><h1>T</h1><p>First of the paragraphs in the body.</p>"
        "<p>Second one of them.</p></div><select><option>no</select></form><footer>no</footer></body>",
        "T\nFirst of the paragraphs in the body.\nSecond one of them.",
    ),
    (
        "<body><p>First of the paragraphs in the body.</p><form>no</form><p>Second one.</p></body>",
        "First of the paragraphs in the body.\nSecond one.",
    ),
    (
        "<article><p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow>"
        "<annotation encoding='application/x-tex'>no</annotation></semantics></math> holds</p></article>",
        "so x=1 holds",
    ),
]


@pytest.mark.parametrize("source, want", CASES)
def test_cases(source, want):
    assert main_text(source) == want


def test_depth_and_length_are_not_limited():
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        article = re.sub(r"</?(?:p|h\d)\b[^>]*>", "\n", re.sub(r"<br>", " ", article))
        lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", article).split("\n"))
        want = "\n".join(x for x in lines if x)
        assert found[row.page_id] == (want, len(want))


def test_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x", "t"), (2, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert found == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "v", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_broken_markup_takes_linear_time():
    """Truncated tags with many quotes, and end tags without start, are read once."""
    begin = time.time()
    assert main_text("<p>Hello</p> if a <b then" + ' "x" ' * 10_000).startswith("Hello\nif a <b then")
    assert main_text("<p>Hello</p> if a <b then" + " it's " * 10_001).startswith("Hello\nif a <b then")
    assert main_text("<b>" * 100_000 + "text" + "</i>" * 100_000) == "text"
    assert main_text("<b>" * 20_000 + "<div>x</div>" * 20_000) == "\n".join("x" * 20_000)
    assert main_text('<p title="x>Hello there</p><p>More</p>') == "Hello there\nMore"
    assert time.time() - begin < 10
