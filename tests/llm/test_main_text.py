"""Main texts of made-up pages, and the choice of a node against a plain recursion over a parsed tree."""

import random
import re
from html import unescape
from math import e, log
from xml.etree import ElementTree

import pytest

from tessella.llm import main_text, queries

NEWS = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site name</h1><div>Motto</div></header><nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, and tell you so at length.</div>
<article class="post"><header><h1>A   title&nbsp;here</h1></header><p>First <b>bold</b>and <a href="x">linked</a>
 text.<p>Second &lt;p&gt; &eacute;&#233;<br>line<script>if (a < b) { document.write("</p>") }</script>
<ul><li>One<li>Two</ul><div class="ad">Buy now</div>Loose end<table><tr><td>1<td>2</table><aside>Aside</aside><form><input value="v"><button>Send</button></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I do not agree with any of this, and say so.</p></article></section><footer>By me</footer></article>
<div id="sidebar"><p>Read this too, it is long and has no links at all in it.</p></div><footer>&copy; 2020</footer></body></html>"""
PAGES = [
    (NEWS, "A title here\nFirst boldand linked text.\nSecond <p> éé line\nOne\nTwo\nLoose end\n1\n2"),
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("only &amp; text", "only & text"),
    ("<p>a<p>b<!-- c", "a\nb"),
    ("a<div></div>b<hr>c<span></span>d", "a\nb\ncd"),
    ("<script>never closed <p>x", ""),
    ("<p title='a>b' class=\"x\">q</p>1 < 2 &notanentity; &am", "q\n1 < 2 ¬anentity; &am"),
    ("<div class=menu><a href=a>Aaa</a> <a href=b>Bbb</a></div><h1>Head</h1><div><p>The text is long.</p><p>It goes on.</p></div><div><a href=z>imprint</a></div>", "Head\nThe text is long.\nIt goes on."),
    ("<body><main><h1>H</h1><div><p>Long enough to be it, one would say.</p></div><p>x</p></main><div>Text of some other kind</div>", "H\nLong enough to be it, one would say.\nx"),
    ("<article><p>word <span class=ad>buy</span>word</p></article>", "word word"),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert main_text.main_text(page or "")[0] == text


def test_long_pages_keep_every_block():
    words = [f"w{i}" for i in range(200_000)]
    page = "<body><article>" + "".join(f"<p>{w}</p>" for w in words) + "</article></body>"
    assert main_text.main_text(page)[0] == "\n".join(words)


def tree(rng, depth):
    name = rng.choice(["div", "section", "p", "a", "b"]) if depth else "body"
    inside = "".join(rng.choice([lambda: "x" * rng.randint(1, 60), lambda: tree(rng, depth + 1) if depth < 4 else "y"])() for _ in range(rng.randint(1, 5))) if name not in ("p", "a", "b") else "z" * rng.randint(1, 90)
    return f"<{name}>{inside}</{name}>"


def counts(node, link=False):
    link |= node.tag == "a"
    own = len((node.text or "").strip())
    c, t, lc, lt = own, 0, own if link else 0, 0
    for x in node:
        a, b, d, f = counts(x, link)
        tail = len((x.tail or "").strip())
        c, t, lc, lt = c + a + tail, t + b + 1, lc + d + (tail if link else 0), lt + f + (x.tag == "a")
    return c, t, lc, lt


def plain_density(node, share, link):
    c, t, lc, lt = counts(node, link)
    if not c:
        return 0.0
    if (base := log(c / max(c - lc, 1) * lc + share * c + e)) <= 1:
        return c / max(t, 1)
    return c / max(t, 1) * log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1) + e) / log(base + e)


def test_sums_against_a_plain_recursion():
    rng = random.Random(2)
    for _ in range(150):
        page = tree(rng, 0)
        body = ElementTree.fromstring(page)
        c, _, lc, _ = counts(body)
        best = []

        def visit(node, path, link):
            link |= node.tag == "a"
            best.append((sum(plain_density(x, lc / max(c, 1), link) for x in node), path))
            for x in node:
                visit(x, f"{path}/{x.tag}", link)

        visit(body, "html/body", False)
        _, path, total, _ = main_text.main_text(page)
        top = max(best)[0]
        chosen = [p for s, p in best if s == pytest.approx(top)]
        # the choice widens upward from the node of the largest sum
        assert any(p.startswith(path) for p in chosen)
        assert any(s == pytest.approx(total) and p == path for s, p in best)


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in queries.op13_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, plain(p.html), len(plain(p.html)))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "u", NEWS, "t", 1), (1, "u", NEWS, "t", 1), (None, None, None, None, None), (2, None, "<p>x</p>" * 5, None, 3)]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int")).collect()
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got if r.page_id != 2) == [(0, None, "", 0)] + [(1, "u", PAGES[0][1], len(PAGES[0][1]))] * 2
    assert [r.text for r in got if r.page_id == 2] == ["\n".join("xxxxx")]
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
