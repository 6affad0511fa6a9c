"""Main text of web pages: boosted trees over nodes, decoded over the tree of the page.

``html_dom`` reads a page into nodes and gives each its features: sums and densities of its subtree, its element, the words
of its class, id and role and of those above and below, depth, place, and what its siblings and parent hold. Two
histogram gradient-boosted models (``quality.fit``) say of each node whether it is main content, and whether nothing below
it is. A node takes one of three states: content, junk, or frame (a node around content, itself not part of it). Junk has only
junk below, content has content and junk below, a frame anything. The best states of a whole page are found bottom up and
read off top down, level by level in numpy, so a node cannot be content below junk or a frame below content.

The models learn from pages whose states are known by construction: at most ``max_pages`` of the given pages, in order of a hash of
their id. Where such a page has one article element, that page is learned from as it is; and the sentences of these pages are set into
SETS pages of other make-up, with the content in other elements and under other class names, or none, and with menus, notices,
adverts, forms, sidebars, comments and footers around and inside it. Every page is then read whole and decoded.

Defined cases: null html counts as empty; a page without text or without content gives '' and 0; a null page_id is read like any
other and is not learned from; repeated rows give equal results; an empty table gives no rows; tags may be missing, nested in any
depth and wrong; other columns are ignored, whatever their names. White space is what Python's ``str.split`` takes for it.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import quality
from geoloom.llm.common import short_batches, text_or_empty
from geoloom.llm.html_dom import Batch, Page, features, read

MAX_PAGES = 200
SETS = 600
AT_ONCE = 128  # pages whose nodes are scored together
CONTENT, JUNK, FRAME = 0, 1, 2


@dataclass(frozen=True)
class Model:
    content: quality.Model
    junk: quality.Model

    def states(self, b: Batch) -> np.ndarray:
        """The best consistent state of each node."""
        x = features(b)
        c, j = (np.clip(m.score(x), 1e-3, 1 - 1e-3) for m in (self.content, self.junk))
        cost = np.log(np.column_stack([c, j, np.clip(1 - c - j, 5e-3, 1)]))
        cost[b.unseen, CONTENT] = cost[b.unseen, FRAME] = -1e9
        best = cost.copy()
        for level in reversed(b.levels[1:]):
            up, own = b.parent[level], best[level]
            either = np.maximum(own[:, CONTENT], own[:, JUNK])
            np.add.at(best, up, np.column_stack([either, own[:, JUNK], np.maximum(either, own[:, FRAME])]))
        state = np.zeros(len(cost), np.int64)
        for k, level in enumerate(b.levels):
            allowed = best[level].copy()
            if k:
                above = state[b.parent[level]]
                allowed[above == JUNK, CONTENT] = -np.inf
                allowed[above != FRAME, FRAME] = -np.inf
            state[level] = allowed.argmax(axis=1)
        return state


def text_of(page: Page, state: np.ndarray) -> str:
    blocks, here = [], []
    for node, text in [*page.pieces, (-1, "")]:
        if node >= 0:
            if state[node] == CONTENT:
                here.append(text)
        elif here:
            block = " ".join("".join(here).split())
            if block:
                blocks.append(block)
            here = []
    return "\n\n".join(blocks)


def truths(page: Page) -> np.ndarray:
    """States by the marks data-truth: content below a mark 'content' until one says 'junk'; frames are what holds content."""
    state = np.full(len(page.parent), JUNK)
    for k in range(1, len(page.parent)):
        up = page.parent[k]
        inside = state[up] == CONTENT
        if (page.truth[k] == "content" or inside) and page.truth[k] != "junk" and not page.unseen[k]:
            state[k] = CONTENT
    for k in range(len(page.parent) - 1, 0, -1):
        if state[k] != JUNK and state[page.parent[k]] == JUNK and page.truth[k] == "content":
            up = page.parent[k]
            while up >= 0 and state[up] == JUNK:
                state[up] = FRAME
                up = page.parent[up]
    return state


class Maker:
    """Pages of known make-up: the words are those of the sample, the mark-up is drawn."""

    HOLD = ("div", "div", "div", "div", "section", "main", "article", "td")
    NAMES = {
        "content": "content|main-content|post|post-content|entry-content|article-body|story|story-body|text|hentry|body-text|blog-post|page-content|single|prose|inhalt|contenido|mw-content-text|maintext|reading|the-article",
        "nav": "nav|navbar|main-menu|menu|navigation|breadcrumb|breadcrumbs|top-nav|pagination|tabs|toc|skip-links",
        "header": "header|site-header|masthead|topbar|branding|page-head|banner",
        "footer": "footer|site-footer|bottom|colophon|copyright|legal|foot",
        "side": "sidebar|side|widget|widget-area|related|related-posts|recommended|trending|popular|more-stories|teasers|rail|secondary|author-bio|tags",
        "ad": "ad|ads|advert|advertisement|ad-slot|banner-ad|sponsored|promo|adsense|sponsor|werbung",
        "notice": "cookie-notice|cookie-banner|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|paywall|site-notice|message",
        "form": "search-form|search|login|signup|contact-form|subscribe-form",
        "talk": "comments|comment-list|discussion|responses|replies|disqus_thread|reader-comments|reviews|feedback",
        "share": "share|social|share-buttons|follow-us|sharing|sharebar|addtoany_share|post-share",
        "wrap": "container|wrapper|row|col-8|inner|page|site|layout|grid|outer|shell|root|app|center|columns|box",
    }

    def __init__(self, sentences: list[str], seed: int) -> None:
        self.draw, self.sentences = random.Random(seed), sentences or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
        self.style = self.draw.random()  # of a page: names told, names missing, names without meaning

    def name(self, kind: str, tell: float = 0.8) -> str:
        x = self.draw.random()
        if self.style < 0.15 or x > tell + 0.12:
            return ""
        word = self.draw.choice(self.NAMES[kind].split("|")) if self.style < 0.85 and x < tell else "".join(self.draw.choices("bcdfghklmnprstvwxz0123456789", k=6))
        return self.draw.choice((f' class="{word}"', f' class="{word}"', f' id="{word}"', f" class='{word} {self.draw.choice(('a1', 'clearfix', 'x-2', 'block'))}'"))

    def words(self, low: int, high: int) -> str:
        want, out = self.draw.randint(low, high), []
        while len(out) < want:
            out += self.draw.choice(self.sentences).split()
        return " ".join(out[:want])

    def link(self) -> str:
        return f'<a href="/{self.draw.randint(1, 9999)}">{self.words(1, 4)}</a>'

    def links(self, tag: str = "ul") -> str:
        each = [self.link() for _ in range(self.draw.randint(2, 14))]
        return f"<{tag}><li>" + "</li><li>".join(each) + f"</li></{tag}>" if self.draw.random() < 0.8 else " | ".join(each)

    def truthful(self, tag: str, kind: str, inside: str, truth: str = "junk", tell: float = 0.8) -> str:
        return f'<{tag}{self.name(kind, tell)} data-truth="{truth}">{inside}</{tag}>'

    def junk(self, kind: str) -> str:
        draw, box = self.draw, self.draw.choice(("div", "div", "section", "aside"))
        if kind == "nav":
            return self.truthful(draw.choice(("nav", "nav", "div", "ul")), "nav", self.links() if draw.random() < 0.8 else " &gt; ".join(self.link() for _ in range(3)))
        if kind == "header":
            return self.truthful(draw.choice(("header", "header", "div")), "header", draw.choice((f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{self.words(2, 8)}</p>")) + draw.choice(("", self.links(), f"<form action='/s'><input name=q><button>{self.words(1, 1)}</button></form>")))
        if kind == "footer":
            return self.truthful(draw.choice(("footer", "footer", "footer", "div")), "footer", draw.choice((f"&copy; {self.words(1, 3)} &middot; {self.words(3, 25)}", f"<p>&copy; 2024 {self.words(2, 20)}</p>", self.links() + f"<p>{self.words(3, 30)}</p>")))
        if kind == "side":
            teasers = "".join(f"<div><h3>{self.link()}</h3><p>{self.words(5, 30)}</p></div>" for _ in range(draw.randint(1, 5)))
            inside = draw.choice((self.links(), f"<h3>{self.words(1, 3)}</h3>{self.links()}", teasers, f"<h2>{self.words(1, 3)}</h2><p>{self.words(8, 60)}</p>", f"<p>{self.words(5, 40)}</p>{self.links()}"))
            return self.truthful(draw.choice(("aside", "aside", "div")), "side", inside, tell=0.9)
        if kind == "ad":
            inside = draw.choice((self.words(3, 25), f"<p>{self.words(3, 30)}</p>", f"<a href='//x'>{self.words(3, 12)}</a>", f"<img src=x><span>{self.words(2, 8)}</span>"))
            return ("<!-- ad -->" if draw.random() < 0.3 else "") + self.truthful(draw.choice(("div", "div", "aside", "section", "ins")), "ad", inside, tell=0.95)
        if kind == "notice":
            return self.truthful(box, "notice", draw.choice((self.words(5, 30), f"<p>{self.words(5, 40)}</p>", f"<p>{self.words(5, 30)} {self.link()}</p>")) + draw.choice(("", f"<button>{self.words(1, 2)}</button>")), tell=0.95)
        if kind == "form":
            inside = f"<p>{self.words(2, 20)}</p><label>{self.words(1, 3)}</label><input type=text><textarea>{self.words(0, 3)}</textarea><button>{self.words(1, 2)}</button>"
            return self.truthful("form", "form", inside)
        if kind == "share":
            return self.truthful(draw.choice(("div", "ul")), "share", f"<h3>{self.words(1, 3)}</h3>" * (draw.random() < 0.6) + "".join(f"<li>{self.link()}</li>" for _ in range(draw.randint(2, 5))), tell=0.9)
        each = "".join(self.truthful(draw.choice(("div", "li", "article", "section")), "talk", f"<b>{self.words(1, 2)}</b>" * (draw.random() < 0.7) + f"<p>{self.words(2, 60)}</p>", tell=0.5) for _ in range(draw.randint(1, 8)))
        return self.truthful(box, "talk", draw.choice(("", f"<h2>{self.words(1, 2)}</h2>")) + each + draw.choice(("", f"<form><textarea></textarea><button>{self.words(1, 1)}</button></form>")), tell=1.0)

    def block(self) -> str:
        draw, x = self.draw, self.draw.random()
        size = (1, 6) if x < 0.2 else (8, 50) if x < 0.7 else (40, 200)
        kind = draw.random()
        if kind < 0.72:
            text = self.words(*size)
            return draw.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p>{text} {self.link()} {self.words(2, 20)}</p>", f"<p><b>{text}.<br>", f"<p>{self.words(2, 8)} <em>{self.words(1, 3)}</em> {text}</p>"))
        if kind < 0.8:
            return f"<h{draw.randint(2, 4)}>{self.words(1, 9)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.words(1, 25)}</li>" for _ in range(draw.randint(1, 8))) + "</ul>"
        if kind < 0.89:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(draw.randint(2, 8))) + "</table>"
        if kind < 0.92:
            return f"<blockquote>{self.words(5, 60)}</blockquote>"
        if kind < 0.94:
            return f"<pre>{self.words(5, 60)}</pre>"
        if kind < 0.96:
            return f"<figure><img src=a.png><figcaption>{self.words(3, 15)}</figcaption></figure>"
        return f"<div>{self.words(*size)}</div>" if kind < 0.98 else f"{self.words(*size)}<br><br>"

    def page(self) -> str:
        draw = self.draw
        if draw.random() < 0.35:  # as good as no text: a title and a line or two
            body = [draw.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>")).format(self.words(1, draw.choice((3, 14)))) for _ in range(draw.choice((1, 1, 2, 3)))]
        else:
            body = [self.block() for _ in range(draw.choice((1, 2, 3, 5, 8, 12, 20, 30)))]
        for kind in ("ad", "side", "share", "share", "form", "notice", "nav"):
            if draw.random() < 0.15:
                body.insert(draw.randint(0, len(body)), self.junk(kind))
        if draw.random() < 0.15:
            body.append(self.junk("talk"))
        title = f"<h1>{self.words(1, 12)}</h1>" if draw.random() < 0.85 else ""
        hold = draw.choice(self.HOLD) if draw.random() < 0.6 else "article"
        main = f'<{hold}{self.name("content", 0.75)} data-truth="content">{title}{"".join(body)}</{hold}>'
        if hold == "td":
            top = draw.choice(("", f"<tr><td colspan=2 data-truth='junk'><b>{self.words(1, 4)}</b></td></tr>"))
            side = draw.choice((self.links(), "<br>".join(self.link() for _ in range(draw.randint(1, 6)))))
            main = f"<table>{top}<tr><td data-truth='junk'>{side}</td>{main}</tr>{draw.choice(('', top))}</table>"
        before = [self.junk(k) for k, p in (("notice", 0.3), ("header", 0.6), ("nav", 0.8), ("form", 0.15), ("ad", 0.5), ("side", 0.15), ("share", 0.1)) if draw.random() < p]
        after = [self.junk(k) for k, p in (("share", 0.2), ("talk", 0.4), ("side", 0.35), ("ad", 0.2), ("form", 0.15), ("notice", 0.15), ("nav", 0.1)) if draw.random() < p]
        near = min(draw.randint(0, 2), len(before)), min(draw.randint(0, 3), len(after))  # these stand in the frame with the content
        inner = "".join([*before[len(before) - near[0] :], main, *after[: near[1]]])
        for _ in range(draw.choice((0, 0, 1, 1, 2, 3))):
            inner = f"<{(t := draw.choice(('div', 'div', 'main', 'section')))}{self.name('wrap', 0.6)}>{inner}</{t}>"
        foot = self.junk("footer") if draw.random() < 0.85 else ""
        head = f"<head><title>{self.words(1, 9)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before[: len(before) - near[0]])}{inner}{''.join(after[near[1] :])}{foot}" + draw.choice(("</body></html>", ""))


def _sentences(pages: list[Page]) -> list[str]:
    texts = (" ".join(t.split()) for p in pages for node, t in p.pieces if node >= 0)
    return [s for t in texts for s in t.split(". ") if len(s) > 3]


def fit(htmls: list[str], sets: int = SETS, seed: int = 11) -> Model:
    """A model from pages: as they are where one article element tells the content, and as matter for drawn pages."""
    marked = [h.replace("<article", '<article data-truth="content"', 1) for h in htmls if h.count("<article") == 1]
    words = _sentences([read(h) for h in htmls])
    pages = [read(h) for h in [*marked, *(Maker(words, seed * 100_003 + k).page() for k in range(sets))]]
    x = features(Batch(pages))
    y = np.concatenate([truths(p) for p in pages]) if pages else np.zeros(0)
    return Model(quality.fit(x, (y == CONTENT).astype(float)), quality.fit(x, (y == JUNK).astype(float)))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, sets: int = SETS) -> Model:
    """At most ``max_pages`` pages reach the driver."""
    with_text = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    few = with_text.select("id", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h", "id").limit(max_pages).select("id").distinct()
    picked = with_text.join(F.broadcast(few), "id").groupBy("id").agg(F.max("html").alias("html")).collect()
    return fit([r["html"] for r in sorted(picked, key=lambda r: r["id"])], sets)


def main_texts(model: Model) -> Callable[[list[str]], list[str]]:
    def run(htmls: list[str]) -> list[str]:
        pages = [read(h) for h in htmls]
        b = Batch(pages)
        state = model.states(b)
        return [text_of(p, state[b.first[i] : b.first[i + 1]]) for i, p in enumerate(pages)]

    return run


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    short_batches(pages.sparkSession)
    read_in = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    make = main_texts(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                texts = make(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = read_in.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return read_in.mapInArrow(run, schema)
