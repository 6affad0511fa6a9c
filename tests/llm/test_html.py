import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import html_extract as H
from geoloom.llm.html_dom import Batch, read
from geoloom.llm.queries import op11_html_extract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return H.train(spark.read.parquet(f"{SF}/pages.parquet"))


def plain(html: str) -> str:
    """The test pages' article by rule: headings and paragraphs are blocks, other marks go."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", html, re.S)[1])
    texts = [" ".join(unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_gives_the_articles_of_all_pages(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        rows = op11_html_extract(spark, sf).collect()
        assert len(rows) == len(pages)
        assert [(r.page_id, r.text) for r in rows if r.text != plain(pages[r.page_id].html)] == []
        assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


def fox(k: int, n: int = 2) -> str:
    return f"The quick brown fox number {k} jumps over the lazy dog, and then it runs home again because the weather has turned rather cold. " * n


PAGES = {
    "blog": f"""<html><head><title>T</title></head><body class="single"><a class="skip-link" href="#c">Skip to content</a>
        <header id="masthead" class="site-header"><p class="site-title"><a href="/">My Blog</a></p><nav class="main-navigation"><ul><li><a href=1>Home</a></li></ul></nav></header>
        <div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-1" class="post hentry"><header class="entry-header"><h1 class="entry-title">KEEP title</h1></header>
        <div class="entry-content"><p>KEEP {fox(1, 3)}</p><div class="ad-slot">Buy now our cheap things</div><p>KEEP {fox(2)}</p><h2>KEEP Second part</h2><ul><li>KEEP one</li><li>KEEP two</li></ul>
        <div class="sharedaddy"><h3>Share this:</h3><ul><li><a>Twitter</a></li></ul></div></div></article>
        <div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I love this, {fox(4, 1)}</p></li></ol><form id="commentform"><textarea></textarea></form></div></main></div>
        <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a>Foo post about things</a></li></ul></section></aside>
        <footer class="site-footer"><p>Copyright 2024 My Blog. All rights reserved.</p></footer><script>x</script></body></html>""",
    "main": f"""<body><div class=cookie-banner><p>We use cookies to make this site better for you.</p><button>OK</button></div><header><h2>Daily News</h2></header><nav><a href=/>Home</a> <a href=/s>Sport</a></nav>
        <main><h1>KEEP Headline of today</h1><p>KEEP {fox(5)}</p><p>KEEP {fox(6)}</p><aside><h3>Related</h3><a href=x>Other story here</a></aside><p>KEEP {fox(7)}</p></main><footer>Imprint | Privacy | Contact</footer></body>""",
    "no names": f"<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Contact</a></div><div><h1>KEEP Title words here</h1><p>KEEP {fox(8)}<p>KEEP {fox(9)}<p>KEEP {fox(10)}</div><div>Copyright 2020 Example corp. <a href=p>Privacy</a></div></body>",
    "table": f"<body><table><tr><td colspan=2><b>Site name</b></td></tr><tr><td><a href=1>Home</a><br><a href=2>Links</a></td><td><h2>KEEP On foxes</h2><p>KEEP {fox(11)}</p><p>KEEP {fox(12)}</p></td></tr></table></body>",
    "inside": f"""<html><body><div class="notice">The site will be down on Monday for maintenance work.</div><nav><ul><li><a href=a>A</a></li></ul></nav><article><h1>KEEP h</h1><p>KEEP {fox(17)}</p>
        <div class="notice"><p>Please note that our opening times have changed.</p></div><p>KEEP {fox(18)}</p><form action=/s><p>Subscribe to our newsletter today</p><input name=e></form></article>
        <section class="comments"><h2>Comments</h2><article class="comment"><p>{fox(19)}</p></article></section><aside class="sidebar"><p>{fox(20)}</p></aside><footer>x y</footer></body></html>""",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_make(model, name):
    got = H.main_texts(model)([PAGES[name]])[0].split("\n\n")
    assert all(b.startswith("KEEP") for b in got) and len(got) == PAGES[name].count("KEEP")


def test_held_out_made_pages(spark, model):
    words = H._sentences([read(r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()])
    made = [H.Maker(words, 77_000_000 + k).page() for k in range(150)]
    hit = got = want = 0
    for html in made:
        page = read(html)
        b = Batch([page])
        state = model.states(b)
        truth = H.text_of(page, H.truths(page)).split("\n\n")
        found = H.text_of(page, state).split("\n\n")
        hit += sum(len(t) for t in found if t in truth)
        got += sum(map(len, found))
        want += sum(map(len, truth))
        above = state[b.parent]
        inner = ~b.root
        assert not ((above == H.JUNK) & (state != H.JUNK) & inner).any()  # nothing contradicts what is above it
        assert not ((above == H.CONTENT) & (state == H.FRAME) & inner).any()
    assert hit / got > 0.98 and hit / want > 0.98


def test_reading_marks():
    def texts(html: str) -> list[str]:
        page = read(html)
        return H.text_of(page, np.full(len(page.parent), H.CONTENT)).split("\n\n")

    assert texts("<p>a &amp; b&#33;<p>c <b>d</b>e<br>f<li>g<li>h") == ["a & b!", "c de f", "g", "h"]
    assert texts("<p>x<script>var a='</p><p>no'</script>y<!-- <p>z --></p>w") == ["xy", "w"]
    assert texts('<div title="a > b" class=\'q\'>one<div>two</div>three</div>four') == ["one", "two", "three", "four"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table><b><p>4</b>5</p>6 < 7 </zz>8") == ["1", "2", "3", "45", "6 < 7 8"]
    assert texts("a\n\t b  c") == ["a b c"]
    assert texts("<title>no</title><style>p{}</style>") == [""]


def test_defined_cases(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", PAGES["main"]), (3, "w", PAGES["main"]), (3, "w", PAGES["main"]), (4, "x", "<div>" * 3000 + "deep"), (5, "y", "<" * 2000 + "a='"), (6, "z", "just some text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("other"), "n_chars": F.lit(-1)})
    out = H.extract(pages, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r.page_id, r.url): r.text for r in out.collect()}
    assert out.count() == len(rows) and got[1, "u"] == got[2, None] == "" and got[None, "v"] == got[3, "w"] and got[3, "w"].startswith("KEEP")
    none = pages.limit(0)
    assert H.extract(none, H.train(none)).count() == 0
