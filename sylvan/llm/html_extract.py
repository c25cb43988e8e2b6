"""Main text of web pages: boosted trees over DOM-node features, decoded top-down.

Every block element gets a probability of holding main text from gradient-boosted trees over its features (subtree
density, link share, attribute tokens, depth, siblings). The decoding chooses the set of nodes with the highest likelihood
in which a chosen node's ancestors are all chosen, so ancestors and descendants never contradict. No page comes with a
label, so the trees are trained on generated pages whose main text is known.
"""

from __future__ import annotations

import collections
import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvan.llm.common import lean

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe svg object canvas head title textarea select datalist button".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
TAG_GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "div section", "article main", "nav menu", "header", "footer", "aside", "form fieldset", "ul ol li dl dt dd", "table tbody thead tr td th", "pre blockquote", "figure figcaption", "body html"]
TAG_OF = {t: i for i, ts in enumerate(TAG_GROUPS) for t in ts.split()}
#: Words in class, id and role attributes.
TOKEN_GROUPS = [
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adbox dfp",
    "nav navbar navigation menu breadcrumb breadcrumbs topnav pagination pager skip toc",
    "footer colophon copyright legal foot",
    "sidebar aside widget rail related recommended more trending popular share social tags",
    "comment comments discussion reply replies respond responses disqus thread feedback",
    "notice alert cookie cookies consent gdpr message warning popup modal overlay paywall",
    "form search login signup subscribe newsletter contact register",
    "header masthead top branding logo site",
    "content article post story entry main body text prose page news",
]
TOKEN_OF = {t: i for i, ts in enumerate(TOKEN_GROUPS) for t in ts.split()}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
MARK = ""


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "own", "links", "marks", "fields", "content", "depth", "total", "total_links", "total_marks", "size", "total_fields")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset = frozenset()):
        self.tag, self.parent, self.tokens, self.children = tag, parent, tokens, []
        self.own = self.links = self.marks = self.fields = 0
        self.content = False
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def parse(page: str, mark: str = "") -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block nodes in page order, the root first, and runs of inline text with the node that holds each.

    mark: in generated pages, what text of the main part begins with. Any other page is taken as it is.
    """
    root = Node("html", None)
    nodes, runs, stack = [root], [], [("html", root)]
    blocks: list[int] = []  # places of block elements in the stack, without the root
    count: collections.Counter = collections.Counter()  # open elements by tag
    run: list[str] = []
    skip = link = 0  # depth of elements whose text is dropped; of links

    def flush():
        nonlocal run
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run = []
            if text:
                node = stack[-1][1]
                if mark and text.startswith(mark):
                    node.content = True
                    text = text.replace(mark, "")
                runs.append((node, text))
                node.own += len(text)
                node.marks += sum(map(text.count, ".,;:!?"))

    def add(text: str):
        if not skip and text:
            run.append(text)
            if link:
                stack[-1][1].links += len(text.strip())

    def pop():
        nonlocal skip, link
        tag, _ = stack.pop()
        count[tag] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        skip -= tag in SKIPPED
        link -= tag == "a"

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if count[tag]:
                while True:
                    last = stack[-1][0]
                    if last in BLOCKS:
                        flush()
                    pop()
                    if last == tag:
                        break
            elif tag == "p":
                flush()
            continue
        if tag in ("input", "textarea", "select", "button"):
            stack[-1][1].fields += 1
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                add(" " * (tag == "br"))
            continue
        if tag in ("html", "body"):
            while skip and len(stack) > 1:
                pop()
            continue
        if tag in BLOCKS:
            flush()
            shut, until = CLOSES.get(tag, (frozenset(), frozenset()))
            i = len(blocks)
            while i:
                i -= 1
                k = blocks[i]
                t = stack[k][0]
                if t in until:
                    break
                if t in shut or t == "p":
                    while len(stack) > k:
                        pop()
                    if t in shut:
                        break
                elif t in BLOCKS and not shut:
                    break
            words = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m[3])).lower() if m[3] else ""
            tokens = frozenset(TOKEN_OF[w] for w in SPLIT.split(words) if w in TOKEN_OF)
            node = Node(tag, stack[-1][1], tokens)
            nodes.append(node)
            blocks.append(len(stack))
            count[tag] += 1
            stack.append((tag, node))
        else:
            if m[3].endswith("/"):
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            count[tag] += 1
            stack.append((tag, stack[-1][1]))
            skip += tag in SKIPPED
            link += tag == "a"
    while len(stack) > 1:
        if stack[-1][0] in BLOCKS:
            flush()
        pop()
    flush()
    return nodes, runs


def features(nodes: list[Node]) -> np.ndarray:
    for n in reversed(nodes):
        kids = n.children
        n.total = n.own + sum(k.total for k in kids)
        n.total_links = n.links + sum(k.total_links for k in kids)
        n.total_marks = n.marks + sum(k.total_marks for k in kids)
        n.total_fields = n.fields + sum(k.total_fields for k in kids)
        n.size = 1 + sum(k.size for k in kids)
    page = nodes[0].total + 1
    out = np.zeros((len(nodes), 14 + 2 * len(TAG_GROUPS) + 2 * len(TOKEN_GROUPS)), np.float32)
    above: dict[Node, tuple[frozenset, frozenset]] = {}
    tags_in: dict[Node | None, collections.Counter] = {}
    for row, n in zip(out, nodes, strict=True):
        p = n.parent
        kin = p.children if p else [n]
        if p not in tags_in:
            tags_in[p] = collections.Counter(k.tag for k in kin)
        same = tags_in[p][n.tag]
        around = (p.total - p.own) / len(kin) if p else n.total
        row[:14] = (
            n.depth, math.log1p(n.total), n.total_links / (n.total + 1), math.log1p(n.size), n.total / n.size, math.log1p(n.own), len(kin), same / len(kin),
            n.total / page, math.log1p(around), n.total_marks / (n.total + 1), p.total_links / (p.total + 1) if p else 0, n.total_fields, p.total_fields if p else 0,
        )
        tags, tokens = above[p] if p else (frozenset(), frozenset())
        own = TAG_OF.get(n.tag)
        if own is not None:
            row[14 + own] = 1
        for t in tags:
            row[14 + len(TAG_GROUPS) + t] = 1
        at = 14 + 2 * len(TAG_GROUPS)
        for t in n.tokens:
            row[at + t] = 1
        for t in tokens:
            row[at + len(TOKEN_GROUPS) + t] = 1
        above[n] = (tags | {own} if own is not None else tags, tokens | n.tokens)
    return out


class Boosted:
    """Gradient-boosted trees of fixed depth for log-odds, grown on binned features."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.2, least: float = 8.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 32) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(rate / (1 - rate))
        score = np.full(len(y), self.base)
        n_f, leaves = x.shape[1], 1 << self.depth
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(leaves, np.int64), np.full(leaves, np.inf)
            for d in range(self.depth):
                width = 1 << d
                best = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, bins)
                for f in range(n_f):
                    at = node * bins + code[:, f]
                    gs = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(1)
                    hs = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least / 8) | (ht - hs < self.least / 8)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best[0]
                    for target, value in zip(best, (top, np.full(width, f), k), strict=True):
                        target[better] = value[better]
                f, k = best[1], best[2]
                for i in range(width):
                    e = edges[f[i]]
                    feature[width - 1 + i], cut[width - 1 + i] = f[i], e[k[i]] if k[i] < len(e) else np.inf
                node = node * 2 + (code[np.arange(len(y)), f[node]] > k[node])
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            score += value[node]
            self.splits.append((feature[: leaves - 1], cut[: leaves - 1], value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = node * 2 + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - (len(value) - 1)]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """The likeliest set of nodes in which a chosen node's parent is chosen. The root is always chosen."""
    log = {id(n): o for n, o in zip(nodes, odds.tolist(), strict=True)}
    best = {}
    for n in reversed(nodes):
        # Against leaving out the whole subtree: log p - log(1 - p) of each chosen node.
        best[id(n)] = log[id(n)] + sum(max(0.0, best[id(k)]) for k in n.children)
    chosen = {id(nodes[0])}
    for n in nodes[1:]:
        if id(n.parent) in chosen and best[id(n)] > 0:
            chosen.add(id(n))
    return chosen


def generated_page(rng: random.Random) -> str:
    """A page of a random layout; text of the main part begins with MARK in each block."""
    some = rng.choice

    def words(n):
        out = ["".join(some("aeioustrnlmd") for _ in range(rng.randint(2, 9))) for _ in range(n)]
        for i in range(0, n, rng.randint(6, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += some([".", ".", ",", "?"])
        return " ".join(out) + some([".", ".", "", "!"])

    def box(tags, tokens, inner, bare=0.5):
        tag = some(tags)
        token = some(tokens)
        kind = some(["class", "id", "class"])
        if tag == "div" or rng.random() > bare:
            return f'<{tag} {kind}="{some(["", "site-", "main-", "x"]) if rng.random() < 0.2 else ""}{token}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(n)) + "</ul>"

    def pick(group, n=99):
        return TOKEN_GROUPS[group].split()[:n]

    def plain():
        return some([words(rng.randint(2, 25)), f"<p>{words(rng.randint(3, 40))}</p>", f"<p>{words(8)}</p>{links(3)}"])

    def ad():
        return box(["div", "div", "aside", "section"], pick(0), plain())

    def comments():
        one = lambda: box(["div", "li", "article"], ["comment", "reply", "response"], f"<h4>{words(2)}</h4>" * (rng.random() < 0.5) + "".join(f"<p>{words(rng.randint(4, 90))}</p>" for _ in range(rng.randint(1, 3))), 0)
        return box(["section", "div", "aside"], ["comments", "discussion", "responses", "replies", "comment-list"], f"<h3>{words(2)}</h3>" * (rng.random() < 0.6) + "".join(one() for _ in range(rng.randint(1, 8))), 0)

    def form():
        return some(["<form>", '<form class="search">', '<form id="newsletter">']) + f"<label>{words(3)}</label><input name=a>" + f"<p>{words(rng.randint(3, 20))}</p>" * (rng.random() < 0.5) + f"<button>{words(1)}</button></form>"

    def body(n):
        out = []
        for _ in range(n):
            k = rng.random()
            text = MARK + words(rng.choice([3, 8, 20, 40, 80, 150]))
            if k < 0.1:
                out.append(f"<h{rng.randint(2, 4)}>{MARK}{words(rng.randint(2, 8))}</h2>".replace("</h2>", "</h2>"))
            elif k < 0.2:
                out.append(f"<p><b>{MARK}{words(rng.randint(3, 9))}<br>")
            elif k < 0.26:
                out.append("<ul>" + "".join(f"<li>{MARK}{words(rng.randint(3, 20))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.3:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif k < 0.32:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{words(2)}</td><td>{MARK}{words(3)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.36:
                out.append(f'<p>{text} <a href="/x">{words(3)}</a> {words(10)}</p>')
            elif k < 0.4:
                out.append(some([ad, form, lambda: box(["div", "aside"], pick(3), links(4)), lambda: box(["div"], pick(5), plain())])())
            else:
                out.append(f"<p>{text}</p>")
        return "".join(out)

    head = f"<h1>{MARK}{words(rng.randint(3, 10))}</h1>" if rng.random() < 0.85 else ""
    if head and rng.random() < 0.15:
        head = f"<header>{head}</header>"
    story = head + body(rng.choice([1, 2, 4, 8, 15, 30]))
    story = some([f"<article>{story}</article>", f"<article>{story}</article>", f"<main>{story}</main>", box(["div", "section", "article"], pick(8), story, 0), f"<div>{story}</div>", f"<main><article>{story}</article></main>", box(["div"], pick(8), f"<div>{story}</div>", 0)])
    top = [lambda: box(["nav", "nav", "div", "ul"], pick(1), links(rng.randint(2, 12))), lambda: box(["header", "div"], pick(7, 3), f"<p>{words(3)}</p>" * (rng.random() < 0.6) + some([links(3), f"<h2>{words(2)}</h2>", words(3)])), lambda: box(["div", "section"], pick(5), plain()), ad, form]
    end = [lambda: box(["footer", "footer", "div"], pick(2), some([f"&copy; {words(3)}", plain(), links(5) + words(6)])), comments, lambda: box(["aside", "div"], pick(3), some([f"<h3>{words(2)}</h3>{links(5)}", plain()])), ad, form]
    before = "".join(f() for f in top if rng.random() < 0.5)
    after = "".join(f() for f in end if rng.random() < 0.5)
    if rng.random() < 0.3:
        story, after = f'<div class="{some(["row", "wrapper", "container", "layout"])}">{story}{box(["aside", "div"], pick(3), plain())}</div>', after
    if rng.random() < 0.4:
        return f'<html><head><title>{words(3)}</title><script>var a="<p>";</script></head><body><div id="{some(["wrap", "outer", "container"])}">{before}{story}{after}</div></body></html>'
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{before}{story}{after}</body></html>"


@functools.lru_cache(1)
def trained(pages: int = 900, seed: int = 11) -> Boosted:
    """Trees trained on generated pages; the same for the same arguments."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes, _ = parse(generated_page(rng), MARK)
        for n in reversed(nodes):
            n.content = n.content or any(k.content for k in n.children)
        xs.append(features(nodes))
        ys.append([n.content for n in nodes])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(page: str | None, model: Boosted) -> str:
    nodes, runs = parse(page or "")
    chosen = decode(nodes, model.log_odds(features(nodes)))
    return "\n".join(text for node, text in runs if id(node) in chosen)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null and empty pages, and pages without main text, give an empty text. Character references are decoded, white space
    within a block becomes one space, blocks are joined by line feeds in page order. Repeated rows are extracted each;
    null page_ids and urls are passed on. A page without block elements is text of its root and kept whole.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        model = sent.value
        for b in batches:
            ids, urls, source = b.columns
            texts = []
            for i in range(0, b.num_rows, 64):
                parsed = [parse(x.as_py() or "") for x in source[i : i + 64]]
                odds = model.log_odds(np.concatenate([features(nodes) for nodes, _ in parsed]))
                at = np.cumsum([0] + [len(nodes) for nodes, _ in parsed])
                for k, (nodes, runs) in enumerate(parsed):
                    chosen = decode(nodes, odds[at[k] : at[k + 1]])
                    texts.append("\n".join(text for node, text in runs if id(node) in chosen))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
