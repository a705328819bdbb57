"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements. Each node has features of its subtree (text, link and
tag density), its tag and attribute tokens, depth, siblings and ancestors. Boosted trees, trained in
numpy on generated pages whose main text is known, give the probability that a node holds main
text. Decoding is hierarchical: it picks the likeliest labelling of the tree in which nothing under
a rejected node is kept, so ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import fresh

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math meter nobr picture progress q ruby rb rp rt s samp small source span strike strong sub sup time tt u var wbr path g use mi mn mo mrow msup msub mfrac mtext msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; without an end tag they reach to the end of the page, as in browsers.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements whose text is not the page's. They count only if their end tag comes before their parent's end:
#: one left open holds whatever follows it.
SILENT = frozenset("noscript template svg object select button".split())
#: What may stand in a head; any other element or text ends it.
HEAD = frozenset("title meta link style script base noscript template".split())
#: Open elements that a start tag ends when they are the nearest of their kind in scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}, "select": {"select"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div"}
TAGS = [{"article", "main"}, {"nav", "menu"}, {"footer"}, {"header"}, {"aside"}, {"form", "fieldset", "dialog"}, {"p"}, {"div", "section", "center"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"body", "html"}, {"blockquote", "pre", "figure", "figcaption", "address"}]
ATTRIBUTES = [
    "article content main post entry story body text blog page",
    "nav menu menubar navigation navbar breadcrumb breadcrumbs toc pagination pager",
    "footer foot copyright legal colophon",
    "header masthead head top banner logo",
    "sidebar side aside widget rail related recommended popular trending more",
    "comment comments reply replies discussion respond disqus thread",
    "ad ads adv advert advertisement adsbygoogle sponsor sponsored promo promotion promoted",
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup",
    "form search login share social tags tag meta byline tools",
]
_ATTRIBUTE = {w: i for i, words in enumerate(ATTRIBUTES) for w in words.split()}
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


#: Nodes of pages that are judged together; a larger page is judged alone.
NODES = 50_000


@dataclass
class Tree:
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attrs: list[tuple[int, ...]] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, text, in page order
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters in links
    anchors: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)  # sentence ends


@lru_cache(4096)
def _groups(text: str) -> tuple[int, ...]:
    return tuple(sorted({_ATTRIBUTE[w] for w in _SPLIT.split(text.lower()) if w in _ATTRIBUTE}))


def _attributes(text: str) -> tuple[int, ...]:
    """The groups of ATTRIBUTES that the class, id and role of a tag name."""
    return _groups(" ".join(m[1] for m in _ATTR.finditer(text))) if "=" in text else ()


class Scanner:
    """The tags of a page one after the other, in time that is linear in its length.

    A quote in a tag reaches to the next one like it. Where no such quote or no > follows, quotes
    are plain characters from there on, so no part of the page is searched more than twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True

    def end(self, at: int) -> int:
        """The place after the > that ends a tag whose name ends at ``at``; -1 without one."""
        page = self.page
        while at <= self.last[">"]:
            if not self.quotes:
                return page.find(">", at) + 1
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                break
            if page[at] == ">":
                return at + 1
            close = page.find(page[at], at + 1) if self.last[page[at]] > at else -1
            at = (close if close > at else at) + 1
        if self.quotes:
            self.quotes = False
            return -2
        return -1

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Start and end of the next tag or comment from ``at`` on, and its name; -1 if there is none."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), start):
                return start, _COMMENT.match(page, start).end(), None
            name = _OPEN.match(page, start)
            if name:
                end = self.end(name.end())
                if end == -2:
                    end = self.end(name.end())
                if end > 0:
                    return start, end, name
            at = start + 1
            if start > self.last[">"]:
                break
        return -1, len(page), None


def parse(page: str) -> Tree:
    """The block elements of a page and their texts; inline elements belong to their block."""
    t = Tree()

    def node(tag: str, parent: int, attrs: str) -> int:
        t.tag.append(tag)
        t.parent.append(parent)
        t.attrs.append(_attributes(attrs))
        for x in (t.chars, t.links, t.anchors, t.marks):
            x.append(0)
        return len(t.tag) - 1

    stack = [node("html", -1, "")]
    depths: dict[str, list[int]] = {"html": [0]}  # places in the stack by tag
    scopes = [0]
    shut: set[int] = set()  # silent nodes that were closed
    blocks: list[tuple[int, str]] = []
    text: list[str] = []
    in_link = 0

    def push(n: int) -> None:
        depths.setdefault(t.tag[n], []).append(len(stack))
        if t.tag[n] in SCOPE:
            scopes.append(len(stack))
        stack.append(n)

    def pop_to(size: int) -> None:
        while len(stack) > size:
            tag = t.tag[stack.pop()]
            depths[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    def open_at(*tags: str) -> int:
        return max((depths[g][-1] for g in tags if depths.get(g)), default=-1)

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((stack[-1], words))

    def add(piece: str) -> None:
        if t.tag[stack[-1]] == "head" and not piece.isspace():
            pop_to(len(stack) - 1)
        text.append(piece)
        if in_link:
            t.links[stack[-1]] += len(piece.strip())

    scan = Scanner(page)
    at, size = 0, len(page)
    while at < size:
        start, after, m = scan.next(at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        at = after
        if m is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _CLOSE and not closing:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
                if not closing:
                    t.anchors[stack[-1]] += 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            in_link = 0
            keep = open_at(tag)
            if keep > 0 and (tag not in ("p", "li") or scopes[-1] <= keep):
                if tag in SILENT:
                    shut.add(stack[keep])
                pop_to(keep)
            continue
        if tag == "html":
            continue
        top = t.tag[stack[-1]]
        if top == "p" or (top == "head" and tag not in HEAD):
            pop_to(len(stack) - 1)
        ends = ENDS.get(tag, ())
        while ends and (k := open_at(*ends)) > scopes[-1]:
            pop_to(k)
            if tag != "tr":
                break
        n = node(tag, stack[-1], page[m.end() : after - 1])
        if tag not in VOID and not (tag == "svg" and page[after - 2] == "/"):
            push(n)
    flush()
    hidden = [False] * len(t.tag)
    for n in range(1, len(t.tag)):
        hidden[n] = hidden[t.parent[n]] or n in shut or t.tag[n] == "head"
    for n, words in blocks:
        if hidden[n]:
            continue
        t.blocks.append((n, words))
        t.chars[n] += len(words)
        t.marks[n] += sum(map(words.count, ".!?;,"))
    for n in range(len(t.tag)):
        if hidden[n]:
            t.links[n] = t.anchors[n] = 0
    return t


def features(t: Tree) -> np.ndarray:
    """One row for each node; nodes come after their parents."""
    n = len(t.tag)
    parent = np.array(t.parent)
    chars, links, anchors, marks, nodes = (np.array(x, float) for x in (t.chars, t.links, t.anchors, t.marks, [1] * n))
    own = chars.copy()
    paragraphs = np.array([c if g == "p" else 0 for g, c in zip(t.tag, t.chars, strict=True)], float)
    depth, order, siblings, alike = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    kids: dict[int, int] = {}
    kinds: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = t.parent[i]
        depth[i] = depth[p] + 1
        order[i] = kids[p] = kids.get(p, 0) + 1
        kinds[p, t.tag[i]] = kinds.get((p, t.tag[i]), 0) + 1
    tag = np.zeros((n, len(TAGS)))
    attr = np.zeros((n, len(ATTRIBUTES)))
    above = np.zeros((n, len(TAGS) + len(ATTRIBUTES)))
    for i in range(n):
        for k, group in enumerate(TAGS):
            if t.tag[i] in group:
                tag[i, k] = 1
        for k in t.attrs[i]:
            attr[i, k] = 1
        if i:
            p = t.parent[i]
            above[i] = np.maximum(above[p], np.concatenate([tag[p], attr[p]]))
            siblings[i], alike[i] = kids[p], kinds[p, t.tag[i]]
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        for x in (chars, links, anchors, marks, nodes, paragraphs):
            x[p] += x[i]
    total = max(chars[0], 1)
    before = np.zeros(n)
    seen = 0
    first: dict[int, int] = {}
    for node, words in t.blocks:
        k = node
        while k >= 0 and k not in first:
            first[k] = seen
            k = t.parent[k]
        seen += len(words)
    for k, v in first.items():
        before[k] = v / total
    up = np.maximum(parent, 0)
    dense = np.stack(
        [np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), anchors / nodes, chars / nodes, marks / np.maximum(chars, 1) * 100, paragraphs / np.maximum(chars, 1),
         depth, order, siblings, alike, chars / total, before, chars / np.maximum(chars[up], 1), links[up] / np.maximum(chars[up], 1), np.log1p(nodes)], axis=1)
    return np.hstack([dense, tag, attr, above])


# ------------------------------------------------------------------ boosted trees


@dataclass
class Boosted:
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)
        z = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > split[at])
            z += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24) -> Boosted:
    """Gradient boosting of full trees on histograms, with logistic loss and second-order gains."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)
    n, width = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z = np.full(n, start)
    inner = (1 << depth) - 1
    F_, S_, L_ = [], [], []
    cell = (np.arange(width) * bins)[None, :] + b
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, split, at = np.zeros(inner, int), np.full(inner, bins), np.zeros(n, int)
        for level in range(depth):
            base = (1 << level) - 1
            k = 1 << level
            flat = ((at - base)[:, None] * (width * bins) + cell).ravel()
            G = np.bincount(flat, np.repeat(g, width), k * width * bins).reshape(k, width, bins).cumsum(2)
            H = np.bincount(flat, np.repeat(h, width), k * width * bins).reshape(k, width, bins).cumsum(2)
            tg, th = G[:, :1, -1:], H[:, :1, -1:]
            gain = G**2 / (H + 1) + (tg - G) ** 2 / (th - H + 1) - tg**2 / (th + 1)
            gain[(H < 2) | (th - H < 2)] = 0
            best = gain.reshape(k, -1).argmax(1)
            feature[base : base + k], split[base : base + k] = best // bins, best % bins
            none = gain.reshape(k, -1).max(1) <= 1e-6
            split[base : base + k][none] = bins
            at = 2 * at + 1 + (b[np.arange(n), feature[at]] > split[at])
        leaf_at = at - inner
        leaf = -rate * np.bincount(leaf_at, g, 1 << depth) / (np.bincount(leaf_at, h, 1 << depth) + 1)
        z += leaf[leaf_at]
        F_.append(feature)
        S_.append(split)
        L_.append(leaf)
    return Boosted(edges, np.array(F_), np.array(S_), np.array(L_), start)


# ------------------------------------------------------------------ training pages

MAIN = "\x01"  # marks main text in generated pages


def generated_page(rng: np.random.Generator) -> str:
    """An invented page; main text is marked by a character that is removed before use."""
    letters = "abcdefghijklmnoprstuvw" + rng.choice(["", "éèêç", "äöüß", "ñóí", "абвгдеж"])
    word = lambda: "".join(rng.choice(list(letters), rng.integers(1, 10)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))

    def sentence(a: int = 3, b: int = 18) -> str:
        s = words(a, b).capitalize()
        if rng.random() < 0.1:
            s = s.replace(" ", rng.choice(["### ", " | ", "%%% ", "&amp;&amp; "]))
        return s.upper() + "!!" if rng.random() < 0.03 else s + "."

    def prose(mark: bool, a: int = 1, b: int = 6) -> str:
        s = " ".join(sentence() for _ in range(rng.integers(a, b)))
        if rng.random() < 0.15:
            s += f' <a href="/{word()}">{words(1, 4)}</a> {words(1, 5)}.'
        return (MAIN if mark else "") + s

    pick = lambda *x: x[rng.integers(len(x))]
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, pick(2, 4, 9))}</a></li>' for _ in range(rng.integers(a, b)))

    def junk() -> str:
        kind = rng.integers(12)
        return [
            lambda: f"<nav{pick('', ' class=menu', ' id="top-nav"')}><ul>{links(2, 10)}</ul></nav>",
            lambda: f'<div class="{pick("menu", "navbar", "breadcrumbs", "nav-main")}"><ul>{links(2, 8)}</ul></div>',
            lambda: f'<div class="{pick("ad", "ads", "advert", "promo-box", "sponsored", "ad banner")}">{prose(False, 1, 4)}</div>',
            lambda: f"<aside{pick('', ' class=sidebar', ' class=widget')}><h3>{words(1, 4)}</h3><{pick('p', 'div')}>{prose(False)}</p></aside>",
            lambda: f'<div class="{pick("sidebar", "widget", "related", "popular-posts")}"><h4>{words(1, 4)}</h4><ul>{links(2, 8)}</ul></div>',
            lambda: f'<div class="{pick("cookie-notice", "cookie-banner", "gdpr-consent", "notice", "newsletter-popup", "alert")}"><p>{prose(False, 1, 3)}</p></div>',
            lambda: f'<form{pick("", " class=search", " id=signup")}><label>{words(1, 4)}</label><input name="q"><p>{prose(False, 1, 2)}</p><button>{word()}</button></form>',
            lambda: f'<div class="{pick("share", "social", "tags")}">{"".join(f"<a href=#>{word()}</a> " for _ in range(rng.integers(2, 6)))}</div>',
            lambda: comments(),
            lambda: f"<header{pick('', ' class=masthead', ' id=header')}><div class=logo>{words(1, 4)}</div><p>{sentence()}</p></header>",
            lambda: f"<footer{pick('', ' class=footer')}>{pick('', '<p>')}&copy; {word()}.example &middot; {prose(False, 1, 4)}</footer>",
            lambda: f'<div id="{pick("footer", "legal", "header", "masthead")}"><p>{prose(False, 1, 3)}</p></div>',
        ][kind]()

    def comments() -> str:
        one = lambda: f'<{pick("div", "li")} class="{pick("comment", "reply", "comment-body")}"><h5>{words(1, 3)}</h5><p>{prose(False, 1, 4)}</p>{pick("<p>" + prose(False, 1, 3) + "</p>", "")}</div>'
        return f'<{(c := pick("section", "div", "ol"))} {pick("id", "class")}="{pick("comments", "discussion", "comment-list", "replies")}"><h3>{words(1, 3)}</h3>{"".join(one() for _ in range(rng.integers(1, 6)))}</{c}>'

    def body() -> str:
        out = [f"<h1>{MAIN}{sentence(2, 12)}</h1>"] if rng.random() < 0.85 else []
        short = rng.random() < 0.3
        for _ in range(rng.integers(1, 3 if short else 14)):
            k = rng.random()
            if short and k < 0.8:
                out.append(f"<p>{MAIN}{pick('', '<b>')}{sentence(1, 8)}{pick('</p>', '', '<br>')}")
            elif k < 0.72:
                out.append(f"<p>{prose(True)}{pick('</p>', '</p>', '</p>', '')}")
            elif k < 0.78:
                out.append(f"<p><b>{prose(True, 1, 3)}<br>")
            elif k < 0.84:
                out.append(f"<h{rng.integers(2, 4)}>{MAIN}{words(2, 7)}</h2>")
            elif k < 0.89:
                out.append("<ul>" + "".join(f"<li>{MAIN}{sentence()}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote><p>{prose(True)}</p></blockquote>")
            elif k < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{MAIN}{words(1, 4)}</td><td>{MAIN}{words(1, 4)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif k < 0.97:
                out.append(junk())
            else:
                out.append(f"<div>{prose(True)}</div>")
        return "".join(out)

    open_, close = pick(
        ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<article class="post">', "</article>"),
        ('<div class="content">', "</div>"), ('<div id="main"><div class="post-body entry">', "</div></div>"), ('<section class="story">', "</section>"), ("<div>", "</div>"), ('<div id="page"><div>', "</div></div>"),
    )
    before = "".join(junk() for _ in range(rng.integers(0, 4)))
    after = "".join(junk() for _ in range(rng.integers(0, 4)))
    head = f"<head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{before}{open_}{body()}{close}{after}" + pick("</body></html>", "")


def training_rows(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes of generated pages, and whether each holds main text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = generated_page(rng)
        marked = parse(page)
        has = np.zeros(len(marked.tag))
        for n, words in marked.blocks:
            while MAIN in words and n >= 0:
                has[n] = 1
                n = marked.parent[n]
        xs.append(features(parse(page.replace(MAIN, ""))))
        ys.append(has)
    return np.concatenate(xs), np.concatenate(ys)


@cache
def model(pages: int = 500, seed: int = 3) -> Boosted:
    return boost(*training_rows(pages, seed))


def decode(t: Tree, p: np.ndarray) -> np.ndarray:
    """The likeliest labels under which every kept node has a kept parent."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    inside, outside = yes.copy(), no.copy()
    for i in range(len(p) - 1, 0, -1):
        k = t.parent[i]
        inside[k] += max(inside[i], outside[i])
        outside[k] += outside[i]
    keep = np.zeros(len(p), bool)
    keep[0] = inside[0] >= outside[0]
    for i in range(1, len(p)):
        keep[i] = keep[t.parent[i]] and inside[i] >= outside[i]
    return keep


def extract(trees: list[Tree], m: Boosted) -> list[str]:
    if not trees:
        return []
    x = [features(t) for t in trees]
    p = np.split(m.probability(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
    out = []
    for t, q in zip(trees, p, strict=True):
        keep = decode(t, q)
        out.append("\n\n".join(words for n, words in t.blocks if keep[n]))
    return out


def main_text(pages: DataFrame, training_pages: int = 500, seed: int = 3) -> DataFrame:
    """page_id, url, text, n_chars for every row; a null, empty or textless page has an empty text.

    Character references are decoded, white space in a block is one space, blocks stand in page
    order with an empty line between them. ``n_chars`` counts code points. Pages of any length are
    read whole; repeated rows are read row by row; other columns are not looked at. A script, style,
    textarea, title or iframe without an end tag reaches to the end of the page, as in browsers.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model(training_pages, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text: list[str] = []
            trees: list[Tree] = []
            for x in batch.column(2):
                trees.append(parse(x.as_py() or ""))
                if sum(len(t.tag) for t in trees[-64:]) > NODES or len(trees) == 64:
                    text += extract(trees, shared.value)
                    trees = []
            text += extract(trees, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return fresh(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
