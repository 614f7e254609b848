"""Main text of web pages by gradient-boosted trees over DOM-node features.

A page is parsed into a tree in linear time (unclosed and stray tags as browsers treat them). Every element gets features: densities of
its subtree (text, links, punctuation, tags, controls), groups of tokens in its class, id and role and in those of its
ancestors, depth, and how it compares with its siblings and parent. Boosted trees, trained in numpy on generated pages
of many layouts with known main text, give each element log-odds of being main text; ``python -m tapeline.llm.pages``
trains them and writes ``page_trees.json``, which queries read. Decoding is hierarchical: the kept
elements are the subtree closed under parents with the largest total weight, so nothing is kept inside a dropped element
and an element is only dropped with all below it.

Edge cases: null or empty html gives an empty text; a page without main text gives an empty text; text outside any tag
belongs to the page's root; deep nesting is handled without recursion; a tag that the page's end cuts off is no text;
elements with ``hidden``, or styled so, and dialogs that are not open are not shown; repeated rows give equal results; null
ids and urls stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import json
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from tapeline.llm.common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template iframe svg object canvas select option textarea button audio video datalist".split())
RAW = frozenset("script style title textarea noscript template iframe svg".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What an opening tag closes first, up to the given ancestors.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: What may stand in head; any other tag or text ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
P_ENDS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
GROUPS = [
    "content article post entry main body text story page column copy prose markdown",
    "nav menu navbar navigation breadcrumb breadcrumbs tabs pagination pager toc",
    "header head masthead top logo brand topbar",
    "footer foot bottom copyright colophon legal",
    "sidebar side aside widget rail secondary related recommended more trending popular",
    "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp",
    "cookie notice consent gdpr alert popup modal overlay toast announcement warning message",
    "comment comments reply replies disqus discussion respond reviews",
    "form search login signup subscribe newsletter register contact email",
    "share social tools meta byline author tags tag category date",
]
TAGS = ["article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset label input", "a", "table tbody tr td th thead", "blockquote pre figure figcaption code", "span b i em strong small", "body html"]
_TOKEN_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
_TAG_GROUP = {t: i for i, g in enumerate(TAGS) for t in g.split()}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# up to the end of a tag; possessive, so that it is read once
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "groups", "items", "label", "hidden")

    def __init__(self, tag: str, parent: int, depth: int, hidden: bool):
        self.tag, self.parent, self.depth, self.hidden = tag, parent, depth, hidden
        self.children: list[int] = []
        self.groups: set[int] = set()
        self.items: list = []  # texts (str) and children (int) in order
        self.label = -1


class _Open:
    """The open elements, with the places of each tag and of blocks, so that no step walks through them."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.blocks = nodes, [0], [0]
        self.places: dict[str, list[int]] = {}

    def push(self, number: int, tag: str) -> None:
        at = len(self.stack)
        self.stack.append(number)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.stack) > at:
            self.places[self.nodes[self.stack.pop()].tag].pop()
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def last(self, tags: frozenset[str] | set[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def head(self) -> bool:
        return len(self.stack) > 1 and self.nodes[self.stack[1]].tag == "head"


def parse(page: str) -> list[Node]:
    """Elements in page order; the first is a root that holds all."""
    nodes = [Node("html", -1, 0, False)]
    seen = _Open(nodes)
    at, size, scan, strict = 0, len(page), 0, True

    def text(end: int) -> None:
        if end > at:
            if nodes[seen.stack[-1]].tag == "head" and page[at:end].strip():
                seen.cut(1)
            top = nodes[seen.stack[-1]]
            if not top.hidden:
                top.items.append(page[at:end])

    while True:
        lt = page.find("<", scan)
        if lt < 0:
            text(size)
            break
        if page.startswith(("<!", "<?", "</"), lt) and not (page[lt + 1] == "/" and page[lt + 2 : lt + 3].isalpha()):
            text(lt)  # a comment, a declaration or what browsers take for one
            mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(mark, lt + 2)
            if end < 0 and mark == "]]>":
                mark, end = ">", page.find(">", lt)
            if end < 0:
                break
            at = scan = end + len(mark)
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            scan = lt + 1  # an ordinary sign
            continue
        text(lt)
        rest = _REST.match(page, m.end()) if strict else None
        if rest:
            inside, at = rest[1], rest.end()
        else:  # quotes that never end: from here on, tags end at the next sign for it
            strict = False
            end = page.find(">", m.end())
            if end < 0:
                break
            inside, at = page[m.end() : end], end + 1
        scan = at
        name = m[1].lower()
        if page[lt + 1] == "/":
            place = seen.last({name})
            if place and (name in BLOCK or place > seen.blocks[-1]):  # an inline end tag doesn't close a block
                seen.cut(place)
            continue
        if name == "html":
            continue
        if name == "head" and (len(nodes) > 1 or any(t.strip() for t in nodes[0].items)):
            continue  # only the first thing of a page can be its head
        if name not in IN_HEAD and seen.head():
            seen.cut(1)
        if name in P_ENDS and nodes[seen.stack[seen.blocks[-1]]].tag == "p":
            seen.cut(seen.blocks[-1])
        if name in CLOSES:
            ends, stops = CLOSES[name]
            place = seen.last(ends)
            if place > seen.last(stops):
                first = min(p for t in ends for p in seen.places.get(t, ())[-1:])
                seen.cut(place if first <= seen.last(stops) else first)
        up = seen.stack[-1]
        node = Node(name, up, len(seen.stack), nodes[up].hidden or name in HIDDEN)
        if name in ("article", "main", "nav", "header", "footer", "aside", "form"):
            node.groups.add(_TOKEN_GROUP[name])
        shown = name != "dialog"
        if inside:
            for a in _ATTR.finditer(inside):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role"):
                    node.groups.update(g for t in _WORD.findall(value) if (g := _TOKEN_GROUP.get(t.lower())) is not None)
                elif key == "data-y":
                    node.label = int(value)
                elif key == "hidden" or (key == "style" and _HIDING.search(value)):
                    node.hidden = True
                elif key == "open":
                    shown = True
        node.hidden |= not shown
        number = len(nodes)
        nodes.append(node)
        nodes[up].children.append(number)
        nodes[up].items.append(number)
        if name in VOID or inside.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not close:
                break
            at = scan = close.end()
            continue
        seen.push(number, name)
    return nodes


N_FEATURES = 24 + 2 * len(GROUPS) + len(TAGS)


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    own, marks, tags, paras, controls, blocks = ([0.0] * n for _ in range(6))
    parent = [x.parent for x in nodes]
    depth = np.array([x.depth for x in nodes], float)
    for i, x in enumerate(nodes):
        tags[i] = 1.0
        if x.hidden:
            continue
        for t in x.items:
            if isinstance(t, str):
                s = t.strip()
                own[i] += len(s)
                marks[i] += len(_MARKS.findall(s)) if s else 0
        paras[i] = float(x.tag == "p")
        blocks[i] = float(x.tag in BLOCK)
        controls[i] = float(x.tag in ("input", "button", "select", "textarea", "label", "form", "option"))
    in_link = [False] * n
    above: list[frozenset[int]] = [frozenset()] * n
    for i, x in enumerate(nodes):
        if i:
            in_link[i] = x.tag == "a" or in_link[x.parent]
            p = nodes[x.parent]
            above[i] = above[x.parent] if p.groups <= above[x.parent] else above[x.parent] | p.groups
    links = [o if k else 0.0 for o, k in zip(own, in_link, strict=True)]
    text = own.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (text, marks, links, tags, paras, controls, blocks):
            a[p] += a[i]
    own, text, marks, links, tags, paras, controls, blocks = (np.array(a) for a in (own, text, marks, links, tags, paras, controls, blocks))
    parent = np.array(parent)
    whole = max(1.0, text[0])
    p = np.maximum(parent, 0)
    kids = np.array([len(x.children) for x in nodes], float)
    place = np.zeros(n)
    before, after = np.zeros(n), np.zeros(n)
    density = links / np.maximum(text, 1)
    most = np.zeros(n)
    for x in nodes:
        c = x.children
        if c:
            place[c] = np.arange(len(c)) / max(1, len(c) - 1)
            most[c] = text[c].max()
            if len(c) > 1:
                before[c[1:]], after[c[:-1]] = text[c[:-1]], text[c[1:]]
    order = np.arange(n) / n
    cols = [
        np.log1p(own), np.log1p(text), text / whole, density, density[p], marks / np.maximum(text, 1), np.log1p(marks), np.log1p(text / tags),
        np.log1p(tags), paras / tags, np.log1p(paras), controls / tags, np.log1p(controls), depth, depth / max(1.0, depth.max()), np.log1p(kids),
        place, np.log1p(kids[p]), np.log1p(before), np.log1p(after), text / np.maximum(most, 1), text / np.maximum(text[p], 1), order, np.log1p(text / np.maximum(blocks, 1)),
    ]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, : len(cols)] = np.stack(cols, 1)
    base = len(cols)
    for i, x in enumerate(nodes):
        for g in x.groups:
            out[i, base + g] = 1
        for g in above[i]:
            out[i, base + len(GROUPS) + g] = 1
        if (g := _TAG_GROUP.get(x.tag)) is not None:
            out[i, base + 2 * len(GROUPS) + g] = 1
    return out


class Boosted:
    """Gradient-boosted trees of fixed depth for two classes, with histogram splits."""

    def __init__(self, trees: int = 70, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(f)]
        code = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        wide = np.arange(f) * self.bins
        flat = (code + wide).ravel()
        self.base = math.log((y.sum() + 1) / (n - y.sum() + 1))
        score = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
            for level in range(self.depth):
                first, k = 2**level - 1, 2**level
                at = (np.repeat((node - first) * f * self.bins, f) + flat).astype(np.int64)
                G = np.bincount(at, np.repeat(g, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(2)
                H = np.bincount(at, np.repeat(h, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(2)
                gt, ht = G[:, :1, -1:], H[:, :1, -1:]
                gain = G**2 / (H + 1) + (gt - G) ** 2 / (ht - H + 1) - gt**2 / (ht + 1)
                gain[(H < 3) | (ht - H < 3)] = -1
                best = gain.reshape(k, -1).argmax(1)
                for i in range(k):
                    if gain.reshape(k, -1)[i, best[i]] > 1e-3:
                        feature[first + i], cut[first + i] = divmod(int(best[i]), self.bins)
                right = code[np.arange(n), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            leaf_at = node - (2**self.depth - 1)
            G, H = np.bincount(leaf_at, g, 2**self.depth), np.bincount(leaf_at, h, 2**self.depth)
            leaf = self.rate * G / (H + 1)
            score += leaf[leaf_at]
            self.feature.append(feature)
            self.cut.append(np.array([self.edges[j][c] if c < len(self.edges[j]) else np.inf for j, c in zip(feature, cut, strict=True)], np.float32))
            self.leaf.append(leaf)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] >= cut[node])
            score += leaf[node - (2**self.depth - 1)]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept elements: of all sets that hold an element's parent with it, the one of the largest weight."""
    n = len(nodes)
    own = np.array([sum(len(t.strip()) for t in x.items if isinstance(t, str)) if not x.hidden else 0 for x in nodes])
    up = np.array([max(0, x.parent) for x in nodes])
    sure = np.clip(odds, -6, 6)
    whole = np.array([nodes[i].tag in ("html", "body") for i in up])
    best = (sure + 0.5 * np.where(whole, 0, sure[up])) * (0.2 + np.log1p(own))  # an element is rather like its parent
    best[[x.hidden for x in nodes]] = -1e9
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = np.zeros(n, bool)
    keep[0] = best[0] > 0
    for i in range(1, n):
        keep[i] = best[i] > 0 and keep[nodes[i].parent]
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """Kept text: one line for each block, white space as one space."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        s = " ".join(htmllib.unescape("".join(held)).split())
        if s:
            blocks.append(s)
        held.clear()

    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, k = todo.pop()
        x = nodes[i]
        block = x.tag in BLOCK
        if k == 0 and block:
            flush()
        while k < len(x.items):
            t = x.items[k]
            k += 1
            if isinstance(t, str):
                held.append(t)
            elif nodes[t].tag in ("br", "hr", "img", "wbr"):
                held.append(" " if nodes[t].tag != "wbr" else "")
            elif keep[t]:
                todo.append((i, k))
                todo.append((t, 0))
                break
            elif nodes[t].tag in BLOCK:
                flush()
        else:
            if block:
                flush()
    flush()
    return "\n".join(blocks)


#: How a head may end: with its tag, by what follows, or by a stray block before its tag.
HEAD_ENDS = ("</head>", "", "<div></div></head>")


class Generator:
    """Pages of many layouts, each element marked with whether it belongs to the main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = ""

    def sentence(self, lo: int, hi: int) -> str:
        r = self.r
        words = ["".join(r.choice(["the", "on", "er", "in", "la", "de", "ti", "ung", "que", "sch", "a", "o", "re"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        for i in range(len(words)):
            if r.random() < 0.08:
                words[i] += ","
        words[0] = words[0].capitalize()
        if self.style == "plain":
            return " ".join(words)
        if self.style == "repeat":
            return " ".join(w for w in words[: r.randint(1, 5)] for _ in range(r.randint(2, 6)))
        if self.style == "noise":
            return " ".join(w + r.choice(["", "!!", " |", "&amp;&amp;", "***", "%%%"]) for w in words)
        return " ".join(words) + r.choice([".", ".", ".", "!", "?"])

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        return " ".join(self.sentence(4, 22) for _ in range(self.r.randint(lo, hi)))

    def attrs(self, group: int, semantic: bool) -> str:
        r = self.r
        if not semantic or r.random() < 0.25:
            return r.choice(["", f' class="c{r.randint(1, 99)}"', f' class="x{r.randint(1, 99)} box"', ' class="wrap"'])
        token = r.choice(GROUPS[group].split())
        token = r.choice([token, token, f"{token}-{r.choice(['box', 'wrap', 'area', 'inner', '1'])}", f"site-{token}", f"{token}Block"])
        return f' {r.choice(["class", "class", "id"])}="{token}"'

    def links(self, n: int) -> str:
        r = self.r
        return "".join(f'<li data-y="0"><a data-y="0" href="/{i}">{self.sentence(1, 3)[:-1]}</a></li>' for i in range(n)) if r.random() < 0.7 else "".join(f'<a data-y="0" href="/{i}">{self.sentence(1, 2)[:-1]}</a> ' for i in range(n))

    def boiler(self, kind: str, semantic: bool) -> str:
        r, y = self.r, 'data-y="0"'
        one = lambda tag, group, body: f"<{tag} {y}{self.attrs(group, semantic)}>{body}</{tag}>"
        tag = lambda t: t if r.random() < 0.6 else "div"
        p = lambda s: f"<{r.choice(['p', 'p', 'div', 'span'])} {y}>{s}" if r.random() < 0.2 else f"<p {y}>{s}</p>"
        if kind == "nav":
            return one(tag("nav"), 1, f"<ul {y}>{self.links(r.randint(3, 12))}</ul>")
        if kind == "header":
            return one(tag("header"), 2, f"<{r.choice(['h1', 'h2', 'div', 'span'])} {y}>{self.sentence(1, 4)}</{'div'}>" + (self.boiler("nav", semantic) if r.random() < 0.5 else "") + (p(self.sentence(3, 8)) if r.random() < 0.4 else ""))
        if kind == "footer":
            return one(tag("footer"), 3, r.choice([f"&copy; {self.sentence(1, 2)} &middot; {self.prose(1, 2)}", p(f"&copy; 2024 {self.sentence(2, 8)}"), f"<ul {y}>{self.links(5)}</ul>{p(self.prose(1, 3))}"]))
        if kind == "side":
            return one(tag("aside"), 4, f"<h3 {y}>{self.sentence(1, 4)}</h3>" + r.choice([f"<ul {y}>{self.links(r.randint(2, 9))}</ul>", p(self.prose(1, 3)), p(self.prose(1, 2)) + f"<ul {y}>{self.links(4)}</ul>"]))
        if kind == "ad":
            return one(r.choice(["div", "div", "aside", "section", "p"]), 5, r.choice([self.prose(1, 2), f'<a {y} href="/x">{self.sentence(2, 9)}</a>', f"<span {y}>{self.sentence(3, 9)}</span>"]))
        if kind == "notice":
            return one(r.choice(["div", "section", "p"]), 6, r.choice([self.prose(1, 3), p(self.prose(1, 2)) + f'<button {y}>OK</button>', p(self.prose(1, 2)) + f'<a {y} href="#">{self.sentence(1, 2)}</a>']))
        if kind == "comments":
            body = "".join(one(r.choice(["div", "li", "article"]), 7, f"<{r.choice(['b', 'span', 'cite'])} {y}>{self.sentence(1, 2)}</b>" + p(self.prose(1, 4))) for _ in range(r.randint(1, 6)))
            return one(r.choice(["section", "div", "ol"]), 7, f"<h3 {y}>{self.sentence(1, 3)}</h3>{body}")
        if kind == "form":
            return one("form", 8, f"<label {y}>{self.sentence(1, 4)}</label><input {y} type=text><button {y}>Go</button>" + (p(self.prose(1, 2)) if r.random() < 0.4 else ""))
        return one(r.choice(["div", "ul", "p"]), 9, self.links(r.randint(2, 6)))

    def main(self, semantic: bool) -> str:
        r, y = self.r, 'data-y="1"'
        self.style = r.choice([""] * 7 + ["plain", "repeat", "noise"])
        out = [f"<h1 {y}>{self.sentence(3, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            u = r.random()
            if u < 0.66:
                s = self.prose(1, r.choice([1, 3, 8]))
                if r.random() < 0.15:
                    s = f'{s} <a {y} href="/y">{self.sentence(1, 4)}</a> {self.prose(1, 2)}'
                if r.random() < 0.2:
                    s = self.sentence(1, 3)
                out.append(r.choice([f"<p {y}>{s}</p>"] * 5 + [f"<p {y}>{s}", f"<div {y}>{s}</div>", f"<p {y}><b {y}>{s}<br>", f"<p {y}>{s}<br>{self.prose(1, 2)}</p>"]))
            elif u < 0.74:
                out.append(f"<h2 {y}>{self.sentence(1, 6)}</h2>")
            elif u < 0.81:
                out.append(f"<ul {y}>" + "".join(f"<li {y}>{self.sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif u < 0.86:
                out.append(f"<blockquote {y}><p {y}>{self.prose(1, 2)}</p></blockquote>")
            elif u < 0.9:
                out.append(f"<table {y}><tr {y}><td {y}>{self.sentence(1, 3)}</td><td {y}>{self.sentence(1, 3)}</td></tr></table>")
            elif u < 0.915:
                out.append(f"<pre {y}>{self.prose(1, 2)}</pre>")
            elif u < 0.93:
                out.append(r.choice([
                    f"<details {y}><summary {y}>{self.sentence(1, 5)}</summary><p {y}>{self.prose(1, 3)}</p></details>",
                    f"<figure {y}><img src=x><figcaption {y}>{self.sentence(2, 9)}</figcaption></figure>",
                    f"<p {y}>{self.sentence(2, 6)} <math {y}><mi {y}>x</mi><mo {y}>=</mo><mn {y}>2</mn></math> {self.sentence(2, 6)}</p>",
                    f"<dl {y}><dt {y}>{self.sentence(1, 2)}</dt><dd {y}>{self.sentence(2, 9)}</dd></dl>",
                    f"<section {y}><h3 {y}>{self.sentence(1, 4)}</h3><p {y}>{self.prose(1, 3)}</p></section>",
                ]))
            else:
                style, self.style = self.style, ""
                out.append(self.boiler(r.choice(["ad", "share", "form", "notice", "side"]), True))
                self.style = style
        body = "".join(out)
        self.style = ""
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        return f"<{tag} {y}{self.attrs(0, semantic or tag == 'div')}>{body}</{tag}>"

    def page(self, head_end: str = "</head>") -> str:
        """``head_end``: one of HEAD_ENDS. The trees learn from the first only: the others must not change what they see."""
        r = self.r
        semantic = r.random() < 0.75
        top = [self.boiler(k, semantic) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.4] or [self.boiler("nav", semantic)]
        end = [self.boiler(k, semantic) for k in ("share", "comments", "side", "ad", "form", "footer") if r.random() < 0.4]
        r.shuffle(top)
        middle = [self.main(semantic)]
        if r.random() < 0.3:
            middle.insert(r.randint(0, 1), self.boiler("side", semantic))
        body = "".join(middle)
        if r.random() < 0.4:
            body = f'<{r.choice(["div", "main"])} data-y="1"{self.attrs(0, semantic)}>{body}{"".join(end[:1])}</div>'
            end = end[1:]
        whole = "".join(top) + body + "".join(end)
        if r.random() < 0.3:
            whole = f'<div data-y="1" class="wrapper">{whole}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title>{head_end}<body data-y=\"1\">{whole}</body></html>"


def fit(pages: int = 900, seed: int = 11) -> Boosted:
    g = Generator(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(g.page())
        pick = [i for i, n in enumerate(nodes) if n.label >= 0]
        xs.append(features(nodes)[pick])
        ys.append([nodes[i].label for i in pick])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def save(model: Boosted, path: Path) -> None:
    trees = [{"feature": f.tolist(), "cut": [float(c) if np.isfinite(c) else None for c in cut], "leaf": [round(float(v), 6) for v in leaf]} for f, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True)]
    lines = ",\n".join(json.dumps(t, separators=(",", ":")) for t in trees)
    path.write_text(f'{{"features": {N_FEATURES}, "depth": {model.depth}, "base": {model.base!r}, "trees": [\n{lines}\n]}}\n')


@lru_cache(maxsize=1)
def trained(path: Path = Path(__file__).with_name("page_trees.json")) -> Boosted:
    """The fitted trees of the file, which must be of this version's features."""
    said = json.loads(path.read_text())
    if said["features"] != N_FEATURES:
        raise ValueError(f"{path} was fitted to other features: fit it again")
    model = Boosted(trees=len(said["trees"]), depth=said["depth"])
    model.base = said["base"]
    model.feature = [np.array(t["feature"], np.int64) for t in said["trees"]]
    model.cut = [np.array([np.inf if c is None else c for c in t["cut"]], np.float32) for t in said["trees"]]
    model.leaf = [np.array(t["leaf"]) for t in said["trees"]]
    return model


def extract(model: Boosted, pages: list[str | None]) -> list[str]:
    trees = [parse(p) if p else [] for p in pages]
    sizes = [len(t) for t in trees]
    if not sum(sizes):
        return [""] * len(pages)
    odds = model.log_odds(np.concatenate([features(t) for t in trees if t]))
    out, at = [], 0
    for t, n in zip(trees, sizes, strict=True):
        out.append(text_of(t, decode(t, odds[at : at + n])) if n else "")
        at += n
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    kinds = dict(pages.dtypes)

    def run(slices: Iterator[dict]) -> Iterator[list[tuple]]:
        for rows in slices:
            texts = extract(model.value, rows["html"])
            yield [(i, u, t, len(t)) for i, u, t in zip(rows["page_id"], rows["url"], texts, strict=True)]

    return map_rows(pages, ["page_id", "url", "html"], run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", chunk=100)


if __name__ == "__main__":
    save(fit(), Path(__file__).with_name("page_trees.json"))
