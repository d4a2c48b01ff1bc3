"""Furniture by the style tree and by name, odd markup, and deep pages."""

import time

import pytest

from plumbline.llm import htmltree
from plumbline.llm.htmltree import Page, main_text


def texts(spark, rows, **more):
    return {r["page_id"]: r["text"] for r in htmltree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **more).collect()}


def test_repeated_branch_inside_the_article_is_removed(spark):
    page = "<body><article><p>story {0} {1}</p><div class='box'><p>read our best offers</p></div></article></body>"
    rows = [(i, "http://h/x", page.format(i, i * 7)) for i in range(20)]
    rows += [(100 + i, "http://same/x", "<body><main><article>one text</article></main></body>") for i in range(20)]
    want = {i: f"story {i} {i * 7}" for i in range(20)} | {100 + i: "one text" for i in range(20)}
    assert texts(spark, rows) == want
    assert texts(spark, rows, max_broadcast=0) == want
    assert texts(spark, rows, least=0.0) == want | {i: f"story {i} {i * 7}\nread our best offers" for i in range(20)}


def test_importance_equals_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    rows = [(i, "http://h/x", f"<div class='a'><p>{i % 3}</p></div><ul><li>x</li></ul>" + "<p>more</p>" * (i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = defaultdict(Counter)
    for _, _, source in rows:
        for path, own in Page(source).nodes.items():
            for kind in (0, 1):
                seen[path, kind][own[kind]] += 1
    want = {}
    for (path, _), c in seen.items():
        n = sum(c.values())
        e = -sum(v / n * math.log2(v / n) for v in c.values()) / math.log2(n) if n > 1 else 1.0
        want[path] = max(want.get(path, 0), e)
    got = {r["path"] % (1 << 64): r["importance"] for r in htmltree.importance(htmltree.style_nodes(df, "page_id", "url", "html")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("html", "want"), [
    ('<p title="a hidden gem">one</p><div style="overflow: hidden ; x">two</div><div data-id="promo">three</div><p class="legal-analysis">four</p>', "one\ntwo\nthree\nfour"),
    ('<p>Real text <span class="share">x</span> more</p><p>a <button>b</button> c</p>', "Real text more\na c"),
    ("<header><h1>Title</h1><span>by x</span></header><p>text</p>", "Title\ntext"),
    ('<p>a&amp;b &lt;i&gt; &#233;&nbsp;c\n\t d</p><br>e<script>var x = "</p>";</script>', "a&b <i> é c d\ne"),
    ('<div class="site-footer">no</div><div id="cookie_banner">no</div><div class="comments">no</div><form>no</form><p hidden>no</p><p style="display:none">no</p><p>yes', "yes"),
    ("<ul><li>one<li>two</ul><table><tr><td>three<td>four</table></nope></p>", "one\ntwo\nthree\nfour"),
])
def test_blocks_of_an_article(html, want):
    assert main_text(Page(f"<nav>menu</nav><article>{html}</article><footer>f</footer>")) == want


def test_page_that_ends_inside_a_tag():
    assert main_text(Page("<article><p>cut <a href='x")) == "cut"


@pytest.mark.parametrize("source", ["<div>" * 40_000 + "deep", "<div>y" * 40_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<p>text" + "</i></div>" * 40_000, "x" * 2_000_000])
def test_deep_and_long_pages_take_linear_time(source):
    began = time.time()
    page = Page(source)
    assert page.blocks and time.time() - began < 20


def test_edges(spark):
    rows = [(1, None, None), (None, "odd", ""), (2, "http://h", "<p>a</p>"), (2, "http://h", "<p>a</p>")]
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in htmltree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("1", "None", ""), ("2", "http://h", "a"), ("2", "http://h", "a"), ("None", "odd", "")]
