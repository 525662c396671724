"""Main-text extraction: gradient-boosted trees over DOM-node features, then one consistent choice of nodes.

Each element gets features of its tag, attribute tokens, depth, subtree and siblings. The trees, fit on generated pages, give the
probability that it belongs to the article. The decoder takes the likeliest labelling in which nothing below a dropped
element of the article is kept.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title head select button option".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html tbody td tfoot th thead tr li dd dt legend summary".split())
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside form ul ol li dl dt dd table tr td th blockquote pre figure figcaption a span b i em strong label".split()
_BARRIER = ("td", "th", "table", "body")
_STOP = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ()}
_SAME = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
#: Buckets of hashed attribute tokens.
BUCKETS = 4096
_TAG_NO = {t: i for i, t in enumerate(TAGS)}
LENGTH = 26


class Node:
    __slots__ = ("tag", "parent", "parts", "kids", "attributes", "depth")

    def __init__(self, tag, parent, attributes=""):
        self.tag, self.parent, self.parts, self.kids, self.attributes = tag, parent, [], [], attributes
        self.depth = parent.depth + 1 if parent else 0


@lru_cache(4096)
def _tokens(attributes: str) -> tuple[int, ...]:
    """Buckets of the words in an element's class, id, role, itemprop and label."""
    found = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            found += [zlib.crc32(t.lower().encode()) % BUCKETS for t in _WORD.findall(a or b or c)]
    return tuple(found)


class _Open:
    """The open elements, with the places of each tag and of block elements among them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place (the root is at 0 and stays) and all in it."""
        for node in self.nodes[place:]:
            self.at[node.tag].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        del self.nodes[place:]


class _Page:
    """Ends of tags and of raw elements; each look goes on from where the last one was, so a page is read a few times at most."""

    def __init__(self, page: str):
        self.page, self.none, self.quoted = page, set(), True
        self.closers: dict[str, tuple[list[int], list[int]]] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, quotes respected, or -1. Once quotes do not close before the page ends they count for nothing."""
        k = at
        while self.quoted:
            k = _PLAIN.match(self.page, k).end()
            if k >= len(self.page):
                self.quoted = False
            elif self.page[k] == ">":
                return k
            else:
                k = self.find(self.page[k], k + 1) + 1
                if not k:
                    break
        return self.find(">", at)

    def after(self, tag: str, at: int) -> int:
        """Where the text after the end tag of a raw element goes on, or -1."""
        if tag not in self.closers:
            found = [(m.start(), m.end()) for m in re.finditer(rf"</{re.escape(tag)}\b[^<>]*>?", self.page, re.I)]
            self.closers[tag] = [a for a, _ in found], [z for _, z in found]
        starts, ends = self.closers[tag]
        k = bisect.bisect_left(starts, at)
        return ends[k] if k < len(starts) else -1


def parse(page: str) -> list[Node]:
    """Elements in page order, the first a root. An end tag without its start is passed over; unclosed elements end with their parent. Time grows with the page."""
    root = Node("html", None)
    nodes, open_, look, at, end = [root], _Open(root), _Page(page), 0, len(page)
    body = False
    while at < end:
        k = page.find("<", at)
        if k < 0:
            open_.nodes[-1].parts.append(page[at:])
            break
        if k > at:
            open_.nodes[-1].parts.append(page[at:k])
        if page.startswith("<!--", k):
            z = look.find("-->", k + 4)
            at = z + 3 if z >= 0 else end
            continue
        if page.startswith("<![CDATA[", k):
            z = look.find("]]>", k + 9)
            open_.nodes[-1].parts.append(page[k + 9 : z if z >= 0 else end].replace("&", "&amp;"))
            at = z + 3 if z >= 0 else end
            continue
        m = _NAME.match(page, k)
        if not m and page[k + 1 : k + 2] not in ("!", "?", "/"):
            open_.nodes[-1].parts.append("<")
            at = k + 1
            continue
        z = look.tag_end(m.end()) if m else look.find(">", k)
        if z < 0:
            break  # the page ends in a tag
        at = z + 1
        if not m:
            continue
        tag = m[1].lower()
        if page[k + 1] == "/":
            place = open_.last((tag,))
            if place and (tag in BLOCK or open_.last(_BARRIER) <= place):
                open_.cut(place)
            continue
        attributes = page[m.end() : z]
        if tag in RAW:
            if not attributes.endswith("/"):
                z = look.after(tag, at)
                if z >= 0 or tag in ("script", "style", "textarea", "title"):
                    at = z if z >= 0 else end
            continue
        if tag == "br" or tag == "hr" or tag == "img":
            open_.nodes[-1].parts.append(" ")
        if tag in VOID or tag == "html" or tag == "body" and body:
            continue
        body |= tag == "body"
        if tag in CLOSES_P and open_.blocks and open_.nodes[open_.blocks[-1]].tag == "p":
            open_.cut(open_.blocks[-1])
        if tag in _STOP:
            place = open_.last(_SAME.get(tag, (tag,)))
            if place > open_.last(_STOP[tag]):
                open_.cut(place)
        node = Node(tag, open_.nodes[-1], attributes)
        node.parent.parts.append(node)
        node.parent.kids.append(node)
        nodes.append(node)
        if not attributes.endswith("/"):
            open_.push(node)
    return nodes


def features(nodes: list[Node], weights: np.ndarray | None = None) -> list[list[float]]:
    """LENGTH numbers for each element, in page order; weights: what each bucket of attribute tokens tells, as learnt from the generated pages."""
    n = len(nodes)
    weights = token_weights() if weights is None else weights
    told = [[float(weights[t]) for t in _tokens(x.attributes)] for x in nodes]
    good_of, bad_of = [sum(w for w in t if w > 0) for t in told], [-sum(w for w in t if w < 0) for t in told]
    place = {id(x): i for i, x in enumerate(nodes)}
    own, text, link, tags, marks, blocks = ([0.0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        for part in node.parts:
            if part.__class__ is str:
                size = len(part) - part.count(" ") - part.count("\n")
                own[i] += size
                if size:
                    marks[i] += part.count(".") + part.count(",") + part.count("!") + part.count("?")
        text[i] += own[i]
        tags[i] += 1
        if node.tag == "a":
            link[i] = text[i]
        if node.tag in BLOCK:
            blocks[i] += 1
        if i:
            p = place[id(node.parent)]
            text[p] += text[i]
            link[p] += link[i]
            tags[p] += tags[i]
            marks[p] += marks[i]
            blocks[p] += blocks[i]
    whole = max(1.0, text[0])
    kinds = [Counter(k.tag for k in node.kids) for node in nodes]
    out, above_bad, above_good, inside = [], [0.0] * n, [0.0] * n, [0] * n
    for i, node in enumerate(nodes):
        p = place[id(node.parent)] if i else 0
        tag = node.tag
        above_bad[i], above_good[i] = (above_bad[p] if i else 0.0) + bad_of[i], (above_good[p] if i else 0.0) + good_of[i]
        inside[i] = 2 if tag in ("nav", "aside", "footer", "form") else 1 if tag in ("article", "main") else inside[p] if i else 0
        brothers = nodes[p].kids if i else [node]
        like = kinds[p][tag] if i else 1
        size = text[i]
        others = max(0.0, text[p] - size)
        out.append([_TAG_NO.get(tag, len(TAGS)), node.depth, good_of[i], bad_of[i], above_good[i], above_bad[i], inside[i], math.log1p(own[i]), math.log1p(size), size / whole, link[i] / max(1.0, size), marks[i] / max(1.0, size), size / tags[i], math.log1p(blocks[i]), len(node.kids), len(brothers), like / max(1, len(brothers)), math.log1p(others / max(1, len(brothers) - 1) if i else 0.0), size / max(1.0, text[p]), link[p] / max(1.0, text[p]), text[p] / tags[p], _TAG_NO.get(nodes[p].tag, len(TAGS)) if i else -1, i / n, tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("p", "blockquote", "pre"), tag in ("header", "footer", "nav", "aside", "form")])
    return out


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, with splits at quantiles."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, least: int = 8, bins: int = 32):
        self.size, self.depth, self.rate, self.least, self.bins = trees, depth, rate, least, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = np.zeros(BUCKETS)
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        self.start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        z = np.full(len(y), self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            which, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(1 << self.depth)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = (1e-6, -1, 0)
                if len(rows) >= 2 * self.least:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for f in range(x.shape[1]):
                        if not len(cuts[f]):
                            continue
                        c = codes[rows, f]
                        gs, hs, ns = (np.cumsum(np.bincount(c, w, len(cuts[f]) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                        gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
                _, f, c = best
                if f < 0:
                    which[k], cut[k] = 0, np.inf
                else:
                    which[k], cut[k] = f, cuts[f][c]
                node[rows] = 2 * k + 1 + (x[rows, which[k]] > cut[k])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * gs / (hs + 1)
            z += value[leaf]
            self.trees.append((which, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for which, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > cut[node])
            z += value[node - len(which)]
        return z


def decode(nodes: list[Node], z: np.ndarray) -> list[bool]:
    """The likeliest labels: outside the article an element may hold some, inside it one is kept with what is kept below it or dropped whole."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    drop, inside, outside = no.tolist(), yes.tolist(), no.tolist()
    kept = yes.tolist()
    keep_in, enter = [False] * n, [False] * n
    for i in range(n - 1, -1, -1):
        keep_in[i] = kept[i] >= drop[i]
        inside_i = max(kept[i], drop[i])
        enter[i] = kept[i] > outside[i]
        outside_i = max(kept[i], outside[i])
        if i:
            p = place[id(nodes[i].parent)]
            drop[p] += drop[i]
            kept[p] += inside_i
            outside[p] += outside_i
    label = [False] * n
    state = [0] * n  # 0 outside, 1 inside, 2 dropped
    for i in range(n):
        above = state[place[id(nodes[i].parent)]] if i else 0
        if above == 0:
            label[i] = enter[i]
            state[i] = 1 if enter[i] else 0
        elif above == 1:
            label[i] = keep_in[i]
            state[i] = 1 if keep_in[i] else 2
        else:
            state[i] = 2
    return label


def text_of(nodes: list[Node], label: list[bool]) -> str:
    """Text of the kept elements, one line a block; white space in a block is one space."""
    keep = {id(n) for n, k in zip(nodes, label) if k}
    blocks, now = [], []

    def end():
        s = _SPACE.sub(" ", "".join(now)).strip()
        if s:
            blocks.append(s)
        now.clear()

    stack = [(nodes[0], iter(nodes[0].parts))]
    while stack:
        node, parts = stack[-1]
        for part in parts:
            if part.__class__ is str:
                if id(node) in keep:
                    now.append(entities.unescape(part) if "&" in part else part)
            else:
                if part.tag in BLOCK:
                    end()
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            if node.tag in BLOCK:
                end()
    end()
    return "\n".join(blocks)


# Class names that the generated pages draw from.
TEXT = "article content entry-content main-content page-body post post-body prose read-more story text copy".split()
ADS = "ad ads advert advertisement banner promo promoted sponsor sponsored".split()
SHARES = "newsletter-signup related share share-buttons sharing social tags toolbar".split()
TALK = ["comments", "comment-list", "discussion comments", "disqus", "feedback", "reader-comments", "replies", "respond", "shoutbox"]
MENUS = "header masthead menu nav navbar navigation skip toolbar top topbar".split()
NOTICES = "banner consent-dialog cookie cookie-notice cookies dialog modal notice popup privacy warning".split()
SIDES = "recommended related search sidebar widget".split()


def training_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Generated pages; elements of the article have the attribute ``data-y``."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(2, 18).capitalize() + r.choice(".....!?") + r.choice(["", "", "", " $$$", "!!", " |"])
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"
    pages = []
    for _ in range(n):
        inline = lambda s: r.choice([s, s, s, f"<b data-y>{s}</b>", f"{s} <a data-y href='/x'>{words(1, 3)}</a> {s}", f"<b data-y>{s}<br>", f"<em data-y>{s}</em>, {s}", f"<span data-y>{s}</span>"])
        body = [f"<h1 data-y>{words(1, 8)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 30])):
            kind = r.random()
            if kind < 0.72:
                body.append(f"<p data-y>{inline(prose(1, r.choice([1, 2, 6])))}" + r.choice(["</p>", "</p>", ""]))
            elif kind < 0.78:
                body.append(f"<h2 data-y>{words(1, 6)}</h2>")
            elif kind < 0.83:
                body.append("<ul data-y>" + "".join(f"<li data-y>{prose(1, 2)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.86:
                body.append(f"<blockquote data-y><p data-y>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.89:
                body.append("<table data-y>" + "".join(f"<tr data-y><td data-y>{words(1, 3)}</td><td data-y>{words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.92:
                body.append(f"<pre data-y>{prose(1, 2)}</pre>")
            elif kind < 0.94:
                body.append(f"<div class='{r.choice(ADS + SHARES)}'>{r.choice([words(2, 9), prose(1, 3), links(2, 5)])}</div>")
            elif kind < 0.97:
                body.append(f"<div data-y>{prose(1, 4)}</div>")
            else:
                body.append(f"<figure data-y><img src='a.png'><figcaption data-y>{words(3, 9)}</figcaption></figure>")
        if r.random() < 0.15:
            body.append(f"<div class='{r.choice(TALK)}'><h3>{words(1, 2)}</h3>" + "".join(f"<div class='comment'><p>{prose(1, 3)}</p></div>" for _ in range(r.randint(1, 5))) + "</div>")
        box = r.choice(["article", "article", "article", "main", *[f"{r.choice(['div', 'div', 'section'])} {r.choice(['class', 'id'])}='{r.choice(TEXT)}'" for _ in range(4)], "div"])
        text = f"<{box} data-y>{''.join(body)}</{box.split()[0]}>"
        if box != "main" and r.random() < 0.3:
            text = f"<main>{text}</main>"
        before, after = [], []
        say = lambda: r.choice([words(2, 10), prose(1, 2), prose(2, 5)])
        for p, piece in ((0.8, f"<nav>{links(2, 8)}</nav>"), (0.4, f"<header><a href='/'>{word()}</a><p>{words(2, 6)}</p></header>"), (0.2, f"<div class='{r.choice(MENUS)}'>{links(3, 9)}</div>"), (0.25, f"<div class='{r.choice(NOTICES)}'><p>{say()}</p><button>ok</button></div>"), (0.5, f"<div class='{r.choice(ADS)}'>{say()}</div>"), (0.15, f"<form action='/s'><label>{word()}</label><input name='q'></form>"), (0.1, f"<div class='{r.choice(['breadcrumbs', 'breadcrumb', 'pager', 'pagination'])}'><a href='/'>{word()}</a> / {word()}</div>"), (0.1, links(3, 8)), (0.15, f"<aside class='{r.choice(SIDES)}'><h3>{words(1, 3)}</h3>{r.choice([links(2, 6), '<p>' + say() + '</p>'])}</aside>")):
            if r.random() < p:
                before.append(piece)
        for p, piece in ((0.8, f"<footer>&copy; {word()}.example.com &middot; {say()}</footer>"), (0.3, f"<aside>{r.choice([links(2, 6), '<p>' + say() + '</p>', '<p>' + say() + '</p><p>' + say() + '</p>'])}</aside>"), (0.3, f"<{r.choice(['section', 'div', 'ol'])} {r.choice(['class', 'id'])}='{r.choice(TALK)}'><h3>{words(1, 2)}</h3>" + "".join(r.choice([f"<div class='comment'><p>{say()}</p></div>", f"<li><b>{word()}</b><p>{say()}</p></li>", f"<p>{say()}</p>", f"<article class='comment'><p>{say()}</p></article>"]) for _ in range(r.randint(1, 8))) + "</section>"), (0.15, f"<form><p>{say()}</p><textarea></textarea><input type='submit'></form>"), (0.2, f"<div class='{r.choice(SIDES)}'>{links(2, 6)}</div>"), (0.15, f"<div id='{r.choice(SIDES)}'><p>{say()}</p>{links(1, 4)}</div>"), (0.1, f"<div class='{r.choice(['footer', 'foot', 'copyright', 'legal', 'page-footer'])}'><p>{say()}</p></div>"), (0.12, f"<div class='{r.choice(['newsletter', 'signup', 'subscribe', 'login'])}'><p>{say()}</p><form><input></form></div>")):
            if r.random() < p:
                after.append(piece)
        r.shuffle(before)
        r.shuffle(after)
        wrap = r.choice(["{}", "{}", "<div id='page'>{}</div>", "<div class='wrapper'><div class='row'>{}</div></div>"])
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{wrap.format(''.join(before) + text + ''.join(after))}</body></html>")
    return pages


@lru_cache(1)
def _training() -> tuple[list[list[Node]], list[list[bool]]]:
    trees = [parse(p) for p in training_pages()]
    return trees, [_truth(t) for t in trees]


@lru_cache(1)
def token_weights() -> np.ndarray:
    """Log-odds of each bucket of attribute tokens that an element which has one is of the article, smoothed; 0 where the generated pages have none."""
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for tree, truth in zip(*_training()):
        for node, y in zip(tree, truth):
            for t in set(_tokens(node.attributes)):
                (yes if y else no)[t] += 1
    return np.where(yes + no > 0, np.log((yes + 0.5) / (no + 0.5)), 0.0)


@lru_cache(1)
def trained() -> Boosted:
    """The trees, fit on the generated pages."""
    x, y = [], []
    for tree, truth in zip(*_training()):
        x += features(tree)
        y += truth
    model = Boosted().fit(np.array(x, float), np.array(y, float))
    model.tokens = token_weights()
    return model


def _truth(page: str | list[Node]) -> list[bool]:
    """Whether each element has the mark."""
    return ["data-y" in node.attributes for node in (parse(page) if isinstance(page, str) else page)]


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; null is empty."""
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    rows = [features(t, model.tokens) for t in trees]
    z = model.margin(np.array([f for r in rows for f in r], float))
    out, at = [], 0
    for t in trees:
        out.append(text_of(t, decode(t, z[at : at + len(t)])))
        at += len(t)
    return out


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null, empty and blank pages, and pages without an article, have an empty text and 0. The whole page is read. Repeated rows are worked on alike, broken
    markup is taken as it comes, more columns are ignored, and an empty table gives an empty one.
    """
    model = model or trained()

    def of(batches):
        for b in batches:
            pages = b.column(2).to_pylist()
            text = [t for i in range(0, len(pages), 256) for t in extract(pages[i : i + 256], model)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string"))
    return rows.mapInArrow(of, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
