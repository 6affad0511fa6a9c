"""Reading web pages into nodes for ``html_extract``: a forgiving reader of markup, and features of nodes in numpy.

A node is an element, or a run of text that stands in a container beside other elements; inline elements without class, id
or role add to the node around them. Nodes are numbered in page order, so a subtree is a range of numbers and its sums
are differences of running sums. Missing end tags are implied as browsers do (p before a block, li before li, cells and
rows, head before the body); end tags without a start are ignored; an end tag of an inline element leaves open blocks open.
Raw texts (script, style, title, ...), comments and declarations give no text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np

# fixed values: element names of the HTML standard by behaviour
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head noscript template svg math select option button object audio video canvas datalist dialog map progress".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br nobr ruby rb rt rp".split())
NO_BLOCK = INLINE | RAW | UNSEEN - {"head", "dialog"}
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OF_HEAD = frozenset("base link meta noscript script style template title".split())
BARRIER = frozenset("table td th caption html body".split())
CONTAINERS = frozenset("html body div section article main aside header footer nav form center td th blockquote figure fieldset details".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}
# kinds of element that the features know
KINDS = {k: i for i, names in enumerate(["#text", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dd dt", "table tbody thead tfoot tr", "td th caption", "div center", "section", "article main", "nav", "header hgroup", "footer address", "aside", "form fieldset", "blockquote pre figure figcaption", "html body #root"]) for k in names.split()}
OTHER = 17
# words in class, id and role by what they tell
TOKENS = {
    "main": "article articlebody content contents main maincontent post postbody entry story body text hentry blog prose inhalt contenu contenido artikel beitrag document read",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumb crumbs pager pagination tabs toc toolbar submenu dropdown skip links sitemap",
    "top": "header head masthead topbar top branding brand logo hero site-header",
    "foot": "footer foot bottom colophon copyright legal imprint impressum",
    "side": "sidebar side aside rail widget widgets related recommend recommended recommendations more trending popular latest teaser teasers promo secondary complementary tags tagcloud bio author byline meta",
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promotion promoted adsense dfp outbrain taboola werbung anzeige publicite publicidad",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall privacy disclaimer warning message toast",
    "form": "form search searchbox login signin signup register contact field input",
    "talk": "comment comments commentlist commentary disqus reply replies respond discussion thread responses reviews feedback kommentare commentaires comentarios forum",
    "share": "share sharing social follow tweet like facebook twitter whatsapp buttons",
}
GROUPS = tuple(TOKENS)
_GROUP = {w: g for g, ws in enumerate(TOKENS.values()) for w in ws.split()}
_PARTS = [(w, g) for w, g in _GROUP.items() if len(w) >= 6 or w in ("foot", "menu", "post", "share", "side", "main")]
_HOLDERS = frozenset(KINDS.get(t, OTHER) for t in CONTAINERS if t != "details") | {KINDS["#root"]}
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|[^<]++|<", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=100_000)
def groups_of(value: str) -> int:
    """The bits of GROUPS that the words of an attribute name."""
    bits = 0
    for word in _WORD.findall(value):
        w = word.lower()
        if w in _GROUP:
            bits |= 1 << _GROUP[w]
        else:
            for part, g in _PARTS:
                if part in w:
                    bits |= 1 << g
    return bits


class Page:
    """Nodes in page order: parent, end (one past the last of the subtree), kind, depth, token bits, unseen, truth; direct text counts; pieces of text."""

    def __init__(self) -> None:
        self.parent, self.kind, self.depth, self.bits, self.unseen, self.truth = [-1], [KINDS["#root"]], [0], [0], [False], [""]
        self.counts: list[list[int]] = [[0] * 6]  # characters, words, characters in links, marks, digits, inputs
        self.pieces: list[tuple[int, str]] = []  # (node, text); node -1: a block ends

    def add(self, parent: int, kind: int, bits: int = 0, unseen: bool = False, truth: str = "") -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.depth.append(self.depth[parent] + 1)
        self.bits.append(bits)
        self.unseen.append(unseen)
        self.truth.append(truth)
        self.counts.append([0] * 6)
        return len(self.parent) - 1


def _attributes(tail: str) -> tuple[int, bool, str]:
    bits, unseen, truth = 0, False, ""
    for name, value in _ATTR.findall(tail):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            bits |= groups_of(value)
        elif name == "hidden" or (name == "style" and _UNSHOWN.search(value)):
            unseen = True
        elif name == "data-truth":
            truth = value
    return bits, unseen, truth


def read(html: str) -> Page:
    page = Page()
    pieces, counts, kinds = page.pieces, page.counts, page.kind
    stack: list[tuple[str, int]] = [("#root", 0)]
    open_tags: dict[str, int] = {}
    links, run = 0, -1  # open links; the text node of the current block, if its parent is a container
    at, size = 0, len(html)

    def cut(to: int) -> None:
        """Close what stands in the stack from place ``to`` on."""
        nonlocal links, run
        for tag, _ in stack[to:]:
            open_tags[tag] -= 1
            links -= tag == "a"
        if any(tag not in NO_BLOCK for tag, _ in stack[to:]):
            pieces.append((-1, ""))
            run = -1
        del stack[to:]

    def top_of(tags: set[str], within: frozenset | set[str]) -> int:
        """The place of the innermost open element of ``tags``, unless one of ``within`` stands inside it; else 0."""
        if any(open_tags.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in within:
                    break
        return 0

    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if "&" in text:
                text = unescape(text)
            node, words = stack[-1][1], text.split()
            if kinds[node] in _HOLDERS:
                if run < 0 and not words:
                    continue
                if run < 0 or page.parent[run] != node:
                    run = page.add(node, KINDS["#text"], 0, False)
                node = run
            if words:
                c = counts[node]
                n = sum(map(len, words))
                c[0] += n
                c[1] += len(words)
                c[2] += n if links else 0
                c[3] += text.count(".") + text.count(",")
                c[4] += sum(map(text.count, "0123456789")) if any(w[0].isdigit() for w in words) else 0
            pieces.append((node, text))
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if tag in ("html", "body") or not open_tags.get(tag):
                continue
            if tag in INLINE:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                open_tags[tag] -= 1
                links -= tag == "a"
                del stack[k]
            elif k := top_of(HEADINGS if tag in HEADINGS else {tag}, BARRIER - {tag}):
                cut(k)
            continue
        tail = m[3] or m[6] or ""
        if tag not in NO_BLOCK:
            if tag in CLOSES_P and (k := top_of({"p"}, BARRIER)):
                cut(k)
            if tag in HEADINGS and stack[-1][0] in HEADINGS:
                cut(len(stack) - 1)
            if tag in IMPLIED and (k := top_of(*IMPLIED[tag])):
                cut(k)
            pieces.append((-1, ""))
            run = -1
        if open_tags.get("head") and tag not in OF_HEAD and tag != "head" and (k := top_of({"head"}, frozenset())):
            cut(k)
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if tag == "a" and links and (k := top_of({"a"}, BARRIER)):  # a link ends where the next begins
            open_tags["a"] -= 1
            links -= 1
            del stack[k]
        parent = stack[-1][1]
        if tag in ("input", "textarea", "select", "button"):
            counts[parent][5] += 1
        if tag == "br":
            pieces.append((run if run >= 0 else parent, " "))
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            continue
        bits, unseen, truth = _attributes(tail) if tail.strip(" /\n\t\r") else (0, False, "")
        node = parent
        if tag not in INLINE or bits or unseen or truth:
            node = page.add(parent, KINDS.get(tag, OTHER), bits, unseen or tag in UNSEEN, truth)
        stack.append((tag, node))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
    return page


class Batch:
    """The nodes of several pages as arrays, parents and ends as places in the batch."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        join = lambda name, kind: np.concatenate([np.asarray(getattr(p, name), kind) for p in pages]) if pages else np.zeros(0, kind)
        self.kind, self.depth, self.bits, self.unseen = join("kind", np.int64), join("depth", np.int64), join("bits", np.int64), join("unseen", bool)
        local = join("parent", np.int64)
        self.root = local < 0
        self.parent = np.where(self.root, np.arange(len(local)), local + self.first[self.page])
        self.counts = np.concatenate([np.asarray(p.counts, np.float64) for p in pages]) if pages else np.zeros((0, 6))
        order = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        self.levels = np.split(order, cuts) if len(order) else []
        self.end = np.arange(1, len(local) + 1)
        for level in reversed(self.levels[1:]):
            np.maximum.at(self.end, self.parent[level], self.end[level])

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
        return run[self.end] - run[np.arange(len(self.end))]

    def above(self, bits: np.ndarray) -> np.ndarray:
        """The bits of all nodes above each."""
        out = np.zeros_like(bits)
        for level in self.levels[1:]:
            up = self.parent[level]
            out[level] = out[up] | bits[up]
        return out


def features(b: Batch) -> np.ndarray:
    """A row per node: sums and densities of its subtree, its element and tokens and those above, its place, its siblings and parent."""
    if not len(b.kind):
        return np.zeros((0, 1))
    ratio = lambda x, y: x / np.maximum(y, 1)
    own = np.where(b.unseen[:, None], 0, b.counts)
    kinds = np.eye(OTHER + 1)[b.kind]
    sums, tags = b.below(own), b.below(kinds)
    page = sums[b.first[:-1]][b.page]
    chars, words, linked, marks, digits, inputs = sums.T
    nodes = b.end - np.arange(len(b.end))
    before = np.concatenate([[0], np.cumsum(own[:, 0])])[:-1]
    before = before - before[b.first[:-1]][b.page]
    kind_bits = 1 << b.kind
    bit = lambda x, n: (x[:, None] >> np.arange(n) & 1).astype(float)
    shape = [np.log1p(chars), np.log1p(words), ratio(linked, chars), ratio(marks, words), ratio(digits, chars), ratio(chars, nodes), np.log1p(nodes), np.log1p(inputs), ratio(words, tags[:, [0, 1, 4, 6]].sum(axis=1))]
    heads = [np.log1p(tags[:, k]) for k in (1, 2, 4, 5)]
    order = np.lexsort((np.arange(len(b.parent)), b.parent))  # siblings stand together, in page order; a root is its own parent's first
    order = order[~b.root[order]]
    same = np.zeros(len(order), bool)
    same[1:] = b.parent[order][1:] == b.parent[order][:-1]
    start = np.flatnonzero(~same)
    count = np.diff(np.append(start, len(order)))
    place, many, prev, after = np.zeros(len(b.kind)), np.ones(len(b.kind)), np.full(len(b.kind), -1), np.full(len(b.kind), -1)
    place[order] = np.arange(len(order)) - np.repeat(start, count)
    many[order] = np.repeat(count, count)
    prev[order[same]] = order[np.flatnonzero(same) - 1]
    after[order[np.flatnonzero(same) - 1]] = order[same]
    pair = b.parent * (OTHER + 1) + b.kind
    _, inverse, number = np.unique(pair, return_inverse=True, return_counts=True)
    alike = number[inverse] / many
    beside = []
    for x in (prev, after):
        none = x < 0
        beside += [np.where(none, -1, shape[0][x]), np.where(none, -1, shape[2][x]), np.where(none, -1, b.kind[x])]
    up = b.parent
    rest = [ratio(chars, page[:, 0]), ratio(chars, chars[up]), ratio(before, page[:, 0]), ratio(before + chars, page[:, 0]), b.depth, place, many, ratio(place, many), alike, shape[0][up], shape[2][up], shape[5][up], ratio(tags[:, 1], tags[b.first[:-1]][b.page][:, 1]), np.log1p(page[:, 0])]
    own_words = bit(b.bits, len(GROUPS))
    above = bit(b.above(kind_bits), OTHER + 1)[:, [3, 6, 9, 10, 11, 12, 13, 14, 15]]
    return np.column_stack([*shape, *heads, *beside, *rest, b.kind, own_words, bit(b.above(b.bits), len(GROUPS)), above, np.minimum(b.below(own_words) - own_words, 3)])
