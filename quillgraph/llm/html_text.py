"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that the tree stays consistent.

A page is parsed to block elements and runs of text. Each node gets features: its tag, hashed
tokens of its class, id and role and those of its ancestors, depth, place among its siblings and
their text, and its subtree's text, links, punctuation and density. Boosted trees, trained here
on generated pages whose parts are known, give each node the log-odds that it holds main text.
A node can hold main text only if its parent does, so the nodes kept are those of the subtree at
the root with the greatest sum of log-odds.

Defined results: a null or empty page, and one with no main text, has an empty text and 0
characters. Broken markup never fails: unclosed elements end with their parent or with the page,
stray end tags are ignored, an unfinished tag at the end is dropped. A quote opens a value only after
an equals sign and closes it only before white space, a slash or the tag's end; if it does not, the tag ends at
its first angle bracket. Parsing takes time in proportion to the page, and features are made for
``HOLD`` nodes at once, whatever the page. Repeated rows are all returned. Columns besides id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches

TEXT = "#text"
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template title textarea iframe svg math select object canvas audio video".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
#: Elements that are part of a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
#: An element that begins ends an open one of these, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "button", "body", TEXT)
_TAG_BITS = {t: 1 << i for i, t in enumerate(TAGS)}
#: Buckets that attribute tokens are hashed to.
TOKENS = 64
#: Nodes whose features are held at once.
HOLD = 1 << 14
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))|[\"'=])*+)>", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?]")


@dataclass(slots=True)
class Node:
    """A block element or a run of text."""

    tag: str
    parent: int
    depth: int
    tokens: int = 0
    text: str = ""
    link: int = 0
    children: list[int] = field(default_factory=list)


def _token_bits(attributes: str) -> int:
    bits = 0
    for m in _NAMES.finditer(attributes):
        for part in _PARTS.findall((m[1] or m[2] or m[3] or "").lower()):
            bits |= 1 << (zlib.crc32(part.encode()) % TOKENS)
    return bits


def parse(page: str) -> list[Node]:
    """The nodes of a page in their order; the first is the root."""
    nodes = [Node("body", -1, 0)]
    stack = [0]
    places: dict[str, list[int]] = {}  # where the open elements of a tag are in the stack
    pieces: list[str] = []
    state = {"link": 0, "in_link": False}

    def close(at: int) -> None:
        for i in stack[at:]:
            places[nodes[i].tag].pop()
        del stack[at:]

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                nodes.append(Node(TEXT, stack[-1], nodes[stack[-1]].depth + 1, 0, text, min(state["link"], len(text))))
                nodes[stack[-1]].children.append(len(nodes) - 1)
            pieces.clear()
        state["link"] = 0

    def add(text: str) -> None:
        pieces.append(text)
        if state["in_link"]:
            state["link"] += len(text)

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = _MARKUP.search(page, at) if at <= last else None
        if m is None:
            add(_UNFINISHED.sub("", page[at:]))
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SILENT and not closing:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last + 1)
                at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "a":
                state["in_link"] = not closing
            continue
        flush()
        if tag == "br" or tag in VOID or tag in ("html", "body") or tag in SILENT:
            if tag == "body" and not closing:
                nodes[0].tokens |= _token_bits(m[3])
            continue
        if closing:
            if found := nearest({tag}):
                close(found)
            state["in_link"] = False
            continue
        if nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        if tag in ENDS:
            own, stop = ENDS[tag]
            if (found := nearest(own)) > nearest(stop):
                close(found)
        nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, _token_bits(m[3])))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if not m[3].rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    return nodes


NUMBERS = 19
#: Blocks in the main part of the long pages that are trained on besides the others.
LONG_PAGES = (40, 64, 80, 96, 120, 150, 180, 220) * 3
WIDTH = NUMBERS + 2 * len(TAGS) + 2 * TOKENS


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for every node."""
    return np.concatenate(list(feature_blocks(nodes)))


def feature_blocks(nodes: list[Node]) -> Iterator[np.ndarray]:
    """Rows of features for every node, ``HOLD`` at once."""
    n = len(nodes)
    chars, links, marks, tags, runs = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == TEXT:
            chars[i], links[i], runs[i] = len(x.text), x.link, 1
            marks[i] = len(_MARKS.findall(x.text))
        else:
            tags[i] += 1
        if x.parent >= 0:
            for own in (chars, links, marks, tags, runs):
                own[x.parent] += own[i]
    whole = max(1, chars[0])
    numbers = np.zeros((min(n, HOLD), NUMBERS), dtype=np.float32)
    own_bits, above_bits, own_tags, above_tags = (np.zeros(n, dtype=np.uint64) for _ in range(4))
    before = 0
    starts = [0] * n
    for i, x in enumerate(nodes):
        starts[i] = before
        if x.tag == TEXT:
            before += chars[i]
    places, same_tags = [0] * n, [1] * n
    for x in nodes:
        kinds = Counter(nodes[s].tag for s in x.children)
        for place, s in enumerate(x.children):
            places[s], same_tags[s] = place, kinds[nodes[s].tag]
    for i, x in enumerate(nodes):
        p = x.parent
        siblings = nodes[p].children if p >= 0 else [0]
        place, same = places[i], same_tags[i]
        prev, nxt = (siblings[place - 1] if place else -1), (siblings[place + 1] if place + 1 < len(siblings) else -1)
        log = math.log1p
        c, up = chars[i], chars[p] if p >= 0 else whole
        numbers[i % HOLD] = (
            x.depth, log(c), links[i] / max(1, c), marks[i] / max(1, c), c / (tags[i] + 1), c / max(1, runs[i]), log(tags[i]), c / whole, starts[i] / whole,
            place, len(siblings), same / len(siblings), c / max(1, up), log(up), links[p] / max(1, up) if p >= 0 else 0,
            log(chars[prev]) if prev >= 0 else -1, log(chars[nxt]) if nxt >= 0 else -1, links[prev] / max(1, chars[prev]) if prev >= 0 else -1, len(x.children),
        )
        own_tags[i] = _TAG_BITS.get(x.tag, 0)
        own_bits[i] = x.tokens
        if p >= 0:
            above_bits[i] = above_bits[p] | own_bits[p]
            above_tags[i] = above_tags[p] | own_tags[p]
        if i % HOLD == HOLD - 1 or i == n - 1:
            part = slice(i - i % HOLD, i + 1)
            spread = [np.unpackbits(bits[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=c) for bits, c in ((own_tags, len(TAGS)), (above_tags, len(TAGS)), (own_bits, TOKENS), (above_bits, TOKENS))]
            yield np.concatenate((numbers[: i % HOLD + 1], *spread), axis=1, dtype=np.float32)


@dataclass
class Trees:
    """Boosted trees of one depth: per tree and inner node a feature and a threshold, per leaf a value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 16, l2: float = 1.0) -> Trees:
    """Fit by second-order boosting of the logistic loss over binned numbers and flags."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(NUMBERS)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # x > cut k  <=>  bin > k
    codes = binned + bins * np.arange(NUMBERS)
    flags = np.ascontiguousarray(x[:, NUMBERS:])
    inner = (1 << depth) - 1
    share = float((weight * y).sum() / weight.sum())
    base = math.log(share / (1 - share))
    margin, rows = np.full(len(x), base), np.arange(len(x))
    model = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = at - first
            key = (place[:, None] * (bins * NUMBERS) + codes).ravel()
            shape = (count, NUMBERS, bins)
            gs, hs = (np.bincount(key, np.repeat(v, NUMBERS), minlength=math.prod(shape)).reshape(shape) for v in (g, h))
            gt, ht = gs[:, 0].sum(axis=1)[:, None], hs[:, 0].sum(axis=1)[:, None]
            spread = np.zeros((len(x), 2 * count), np.float32)
            spread[rows, place], spread[rows, count + place] = g, h
            right = spread.T @ flags  # sums over the rows whose flag is set
            gl = np.concatenate((gs.cumsum(axis=2)[..., :-1].reshape(count, -1), gt - right[:count]), axis=1)
            hl = np.concatenate((hs.cumsum(axis=2)[..., :-1].reshape(count, -1), ht - right[count:]), axis=1)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
            for node, best in enumerate(gain.argmax(axis=1).tolist()):
                if gain[node, best] > 1e-6:
                    j, k = divmod(best, bins - 1) if best < NUMBERS * (bins - 1) else (best - NUMBERS * (bins - 2), -1)
                    if k >= 0 and k >= len(cuts[j]):
                        continue
                    model.feature[t, first + node] = j
                    model.threshold[t, first + node] = cuts[j][k] if k >= 0 else 0.5
            at = 2 * at + 1 + (x[rows, model.feature[t, at]] > model.threshold[t, at])
        leaf = at - inner
        model.value[t] = -rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + l2)
        margin += model.value[t, leaf]
    return model


def decode(nodes: list[Node], margins: np.ndarray) -> str:
    """The texts kept when the subtree at the root has the greatest sum of log-odds."""
    gain = margins.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [gain[0] > 0]
    out = []
    for i, x in enumerate(nodes):
        if i:
            kept.append(kept[x.parent] and gain[i] > 0)
        if kept[i] and x.tag == TEXT:
            out.append(x.text)
    return "\n".join(out)


def _texts(pages: list[list[Node]], trees: Trees) -> list[str]:
    """The main texts of parsed pages; small pages are judged together, and a large one in blocks."""
    margins, waiting, held = [], 0, []
    for block in (block for nodes in pages for block in feature_blocks(nodes)):
        held.append(block)
        waiting += len(block)
        if waiting >= HOLD:
            margins.append(trees.margins(np.concatenate(held)))
            held, waiting = [], 0
    margins = np.concatenate([*margins, *([trees.margins(np.concatenate(held))] if held else [])])
    ends = np.cumsum([len(n) for n in pages])
    return [decode(n, margins[e - len(n) : e]) for n, e in zip(pages, ends, strict=True)]


class _Page:
    """A generated page; what is put between ``MAIN`` marks is main text."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        #: Share of the blocks that have few words.
        self.brief = self.r.choice([0.05, 0.15, 0.15, 0.6, 1.0])

    def words(self, low: int, high: int, stop: bool = False) -> str:
        r = self.r
        own = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(own) - 1):
            if stop and r.random() < 0.15:
                own[i] += r.choice([".", ",", ".", ";"])
        return " ".join(own).capitalize() + (r.choice(".....,!?:") if stop else "")

    def named(self, tag: str, names: list[str], inner: str, bare: float = 0.2) -> str:
        r = self.r
        which = "" if r.random() < bare else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
        return f"<{tag}{which}>{inner}</{tag}>"

    def linked(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, self.r.random() < 0.3)}</a>' for i in range(self.r.randint(low, high))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def prose(self) -> str:
        r, kind = self.r, self.r.random()
        own = self.words(1, 3, r.random() < 0.7) if r.random() < self.brief else self.words(4, r.choice([9, 15, 60, 200]), True)
        if kind < 0.72:
            return f"<p>{own}</p>" if r.random() < 0.8 else f"<p><b>{own}<br>" if r.random() < 0.5 else f'<p>{own} <a href="/x">{self.words(1, 4)}</a> {self.words(3, 20, True)}</p>'
        if kind < 0.8:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 8)}</h{n}>"
        if kind < 0.88:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.words(2, 20, r.random() < 0.5)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
        if kind < 0.94:
            return f"<blockquote>{own}</blockquote>"
        return f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 9)}</td></tr></table>" if r.random() < 0.6 else f"<pre>{own}</pre>"

    def extras(self, where: str) -> str:
        """Boilerplate: menus, notices, adverts and the like."""
        r, out = self.r, []
        menu = ["nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb"]
        if where == "top":
            if r.random() < 0.8:
                out.append(f"<nav>{self.linked(2, 9)}</nav>" if r.random() < 0.6 else self.named("div", menu, self.linked(2, 9)))
            if r.random() < 0.5:
                out.append(self.named(r.choice(["header", "header", "div"]), ["header", "site-header", "masthead", "banner", "top"], r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 9)}</p>", f"<div>{self.words(1, 4)}</div>" + self.linked(2, 5)]), 0.05))
            if r.random() < 0.3:
                out.append(self.named("div", ["cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert"], f"<p>{self.words(5, 30, True)}</p><button>{self.words(1, 2)}</button>" if r.random() < 0.7 else self.words(5, 25, True), 0))
        ads = ["ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot", "banner-ad"]
        if r.random() < 0.45:
            inner = self.words(3, 25, r.random() < 0.7)
            out.append("<!-- ad -->" + self.named(r.choice(["div", "div", "aside", "section"]), ads, r.choice([inner, f"<p>{inner}</p>"]), 0))
        if where in ("side", "top", "bottom") and r.random() < 0.35:
            out.append(self.named(r.choice(["aside", "div"]), ["sidebar", "side", "widget", "related", "related-posts", "rail"], f"<h3>{self.words(1, 3)}</h3>" + (self.linked(2, 8) if r.random() < 0.6 else f"<p>{self.words(5, 40, True)}</p>"), 0.02))
        if r.random() < 0.25:
            out.append(self.named("form", ["search", "newsletter", "subscribe", "signup", "login"], f"<label>{self.words(1, 4)}</label><input name=q><p>{self.words(2, 12, True)}</p><button>{self.words(1, 2)}</button>"))
        if where == "bottom":
            if r.random() < 0.4:
                one = lambda: self.named(r.choice(["div", "li", "article"]), ["comment", "comment-body", "reply"], f"<h4>{self.words(1, 2)}</h4><p>{self.words(3, 60, True)}</p>", 0)
                out.append(self.named(r.choice(["section", "div"]), ["comments", "comment-list", "discussion", "responses"], f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))), 0))
            if r.random() < 0.3:
                out.append(self.named("div", ["share", "social", "tags", "author-bio", "byline"], self.linked(2, 5), 0))
            if r.random() < 0.9:
                inner = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(2, 15, True)}", f"<p>&copy; {self.words(2, 12)}</p>", self.linked(2, 7), f"<div>{self.linked(2, 5)}</div><p>{self.words(4, 30, True)}</p>"])
                out.append(f"<footer>{inner}</footer>" if r.random() < 0.7 else self.named("div", ["footer", "site-footer", "copyright", "legal", "bottom"], inner, 0))
        r.shuffle(out) if where != "bottom" else None
        return "".join(out)

    def whole(self, blocks: int | None = None) -> str:
        """The page; its main part has ``blocks`` blocks, or a few as dealt by chance."""
        r = self.r
        main = (f"<h1>{self.words(2, 12)}</h1>" if r.random() < 0.85 else "") + "".join(self.prose() for _ in range(blocks or r.choice([1, 2, 4, 8, 16, 30])))
        main = f"<i data-main>{main}<i data-end>"
        if r.random() < 0.25:  # boilerplate inside of the article
            main = main.replace("</p>", f"</p><i data-end>{self.extras('in')}<i data-main>", 1)
        kind = r.random()
        if kind < 0.4:
            main = f"<article>{main}</article>"
        elif kind < 0.5:
            main = f"<main>{main}</main>"
        elif kind < 0.88:
            main = self.named(r.choice(["div", "section", "div"]), ["content", "post", "entry", "article", "story", "post-content", "main", "text", "article-body", "body", "page-content"], main, 0.5)
        if r.random() < 0.2:
            main = self.named("div", ["container", "wrapper", "page", "main", "row"], main)
        body = self.extras("top") + (self.extras("side") if r.random() < 0.5 else "") + main + self.extras("bottom")
        if r.random() < 0.3:
            body = self.named("div", ["container", "wrapper", "page", "site"], body)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def labelled_page(seed: int, blocks: int | None = None) -> tuple[list[Node], np.ndarray]:
    """A generated page's nodes and whether each holds main text."""
    page = _Page(seed).whole(blocks)
    open_mark, end_mark = "\ue000", "\ue001"
    nodes = parse(page.replace("<i data-main>", open_mark).replace("<i data-end>", end_mark))
    inside, labels = False, np.zeros(len(nodes), dtype=bool)
    for i, x in enumerate(nodes):
        if x.tag != TEXT:
            continue
        inside_here = inside or open_mark in x.text
        for c in x.text:
            inside = True if c == open_mark else False if c == end_mark else inside
        x.text = x.text.replace(open_mark, "").replace(end_mark, "").strip()
        if inside_here and x.text:
            at = i
            while at >= 0 and not labels[at]:
                labels[at] = True
                at = nodes[at].parent
    return _without_empty(nodes, labels)


def _without_empty(nodes: list[Node], labels: np.ndarray) -> tuple[list[Node], np.ndarray]:
    keep = [i for i, x in enumerate(nodes) if x.tag != TEXT or x.text]
    at = {i: k for k, i in enumerate(keep)}
    out = [Node(x.tag, at.get(x.parent, -1), x.depth, x.tokens, x.text, x.link, [at[c] for c in x.children if c in at]) for x in (nodes[i] for i in keep)]
    return out, labels[keep]


def train(pages: int = 700, seed: int = 1000) -> Trees:
    """Trees from generated pages; each page weighs the same."""
    found = [labelled_page(seed + i) for i in range(pages)]
    found += [labelled_page(seed + pages + i, blocks) for i, blocks in enumerate(LONG_PAGES)]
    x = np.concatenate([features(n) for n, _ in found])
    y = np.concatenate([v for _, v in found]).astype(np.float64)
    weight = np.concatenate([np.full(len(v), 40.0 / len(v)) for _, v in found])
    return boost(x, y, weight)


def extract(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            texts, held, waiting = [], [], 0
            for n, cell in enumerate(b.column(2), 1):
                held.append(parse(cell.as_py() or ""))
                waiting += len(held[-1])
                if waiting >= HOLD or n == b.num_rows:
                    texts += _texts(held, trees)
                    held, waiting = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return given.mapInArrow(run, f"page_id {given.schema['page_id'].dataType.simpleString()}, url {given.schema['url'].dataType.simpleString()}, text string, n_chars bigint").withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
