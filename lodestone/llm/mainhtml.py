"""Main text of web pages by a minimum cut.

A page becomes a sequence of text blocks with their ancestors.  A linear classifier turns each block's
features into two terminal capacities: what it costs to call the block boilerplate, and what it costs
to call it content.  Neighbours in page order, and neighbours within one container, are joined by edges
that weigh less the farther apart they stand in the tree.  The minimum cut of this graph, found by
maximum flow, is the cheapest labelling: the source's side is content.

The classifier is a logistic regression, fitted here by Newton steps on pages that a seeded generator
writes together with their main text, as there are no labels for pages.  Elements, attributes and words are
features of it and have finite weights; only what is no text of a page (scripts, styles, controls) is left
out before.  What an element says counts for the blocks below it, unless it wraps an article or more than half
of the page's text, and not for an article within it.

Of several least cuts the one with least content is taken, so a block of score 0 without content beside it is
boilerplate.  Character references are decoded in each text node.  Null and empty pages, and pages without text, give ''.
Rows that repeat a page give the same text each; pages and blocks of any length are worked off whole.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.functions.memory import lean

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr br img".split()
)
#: Elements whose text is no text of the page: code, and labels of controls.
SILENT = frozenset("head script style noscript template iframe svg math button select textarea object title".split())
MAIN = frozenset(("article", "main"))
#: Elements that are a feature of all blocks below them.
CHROME = {"nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "form": "form", "dialog": "form", "header": "header"}
#: Words of class and id attributes that mark what surrounds an article, and words that go with them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion sidebar side aside rail widget comment comments disqus reply replies respond "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs nav navbar "
    "navigation menu footer header masthead toolbar pagination pager skip copyright disclaimer legal".split()
)
FILLERS = frozenset("area bar block body box content container cta form group inner item items left line links list main outer panel right row section site slot text top bottom unit wrap wrapper".split())

# an attribute's value ends at its quote; without one, at white space or the tag's end, whatever quotes it holds; a
# quote that nothing closes is part of a value without quotes
_VALUE = r"""\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
_ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:{_VALUE})?+""")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    rf"""((?>[\s/]++|[^\s/>][^\s/>=]*+(?:{re.sub(r"\((?=\[)", "(?:", _VALUE)})?+)*+)(?:>|\Z)""", re.S
)
_TOLD = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


FEATURES = (
    "bias", "words", "sentence", "heading", "paragraph", "item", "links", "main", "beside", "mark", "part", "nav", "aside", "footer", "form", "header", "hidden",
)
_FLAGS = FEATURES[9:]


FAR = 64


@dataclass(frozen=True)
class Weights:
    """The classifier, one weight a feature, and the smoothness of the cut."""

    features: tuple[float, ...]
    smooth: float = 1.5
    container: float = 1.0


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    depth: int
    silent: bool
    main: bool
    says: frozenset[str] = frozenset()
    wraps: bool = False  # holds an article, or most of the page
    chars: int = 0
    heard: frozenset[str] | None = None


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


_NOTHING: frozenset[str] = frozenset()


def _says(tag: str, attributes: str, inside_main: bool) -> frozenset[str]:
    """What an element tells of the blocks below it."""
    said = set()
    if tag in CHROME and not (tag == "header" and inside_main):
        said.add(CHROME[tag])
    if attributes and tag not in MAIN and tag not in ("body", "html"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name not in _TOLD:
                continue
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                said.add("hidden")
                continue
            for token in value.split():
                words = _WORDS.findall(token)
                if not MARKS.isdisjoint(words):
                    said.add("mark" if all(w in MARKS or w in FILLERS for w in words) else "part")
    return frozenset(said) if said else _NOTHING


def parse(page: str) -> list[Block]:
    """The text blocks of a page; tolerant of unclosed, stray and cut-off tags."""
    root = Element("", None, 0, False, False)
    opened: Counter[str] = Counter()  # open elements by name, so that a stray end costs nothing
    here, block, blocks, at, links, elements = root, None, [], 0, 0, []

    def text(piece: str) -> None:
        nonlocal block
        if here.silent or not piece:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if block is None:
            if piece.isspace():
                return
            block = Block(here_block())
            blocks.append(block)
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    def leave() -> None:
        nonlocal here, links
        opened[here.tag] -= 1
        links -= here.tag == "a"
        here = here.parent

    def here_block() -> Element:
        e = here
        while e.tag in INLINE and e.parent is not None:
            e = e.parent
        return e

    for m in iter(lambda: _TOKEN.search(page, at), None):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag not in SILENT and not here.silent:
            block = None
        if m[1]:
            if opened[tag]:
                while here.tag != tag:
                    leave()
                leave()
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        if tag not in INLINE and here.tag == "p" or tag == here.tag in ("li", "p", "dt", "dd", "option", "tr", "td", "th"):
            leave()
        elif tag not in INLINE and tag in ("p", "div", "li", "article", "section", "footer", "aside", "ul", "ol", "table", "h1", "h2", "h3"):
            e = here
            while e.tag in INLINE and e.parent is not None:  # an open <p><b> ends where a block begins
                e = e.parent
            if e.tag == "p" and e is not here:
                while here is not e:
                    leave()
                leave()
        if tag in MAIN:
            e = here
            while e is not None and not e.wraps:
                e.wraps, e = True, e.parent
        here = Element(tag, here, here.depth + 1, here.silent or tag in SILENT, here.main or tag in MAIN, _says(tag, m[3] or "", here.main))
        elements.append(here)
        opened[tag] += 1
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else len(page)
    text(page[at:])
    blocks = [b for b in blocks if b.text]
    for b in blocks:
        b.element.chars += sum(map(len, b.parts))
    whole = sum(b.element.chars for b in {id(b.element): b for b in blocks}.values())
    for e in reversed(elements):
        e.wraps |= 2 * e.chars > whole and not e.main
        if e.parent is not None:
            e.parent.chars += e.chars
    for e in elements:  # a parent comes before its children
        above = _NOTHING if e.tag in MAIN or e.parent is None else e.parent.heard or _NOTHING
        e.heard = above if e.wraps or not e.says else above | e.says
    return blocks


def features(blocks: list[Block], texts: list[str]) -> np.ndarray:
    """A row for each block, in the order of FEATURES."""
    has_main, rows = any(b.element.main for b in blocks), np.zeros((len(blocks), len(FEATURES)))
    for row, b, text in zip(rows, blocks, texts, strict=True):
        e = b.element
        heard = e.heard or _NOTHING
        row[:9] = (
            1.0, math.log2(text.count(" ") + 2), text[-1] in ".!?\u2026:\"\u201d\u00bb\u3002", e.tag in ("h1", "h2", "h3", "h4"), e.tag in ("p", "blockquote", "pre", "dd", "figcaption"),
            e.tag in ("li", "td", "th", "dt"), b.linked / (sum(map(len, b.parts)) or 1), e.main, has_main and not e.main,
        )
        if heard:
            row[9:] = [f in heard for f in _FLAGS]
    return rows


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements; beyond FAR the count stops, as an edge of so many halvings weighs nothing."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node pays its score's size for the wrong side, an edge its weight if cut.

    Dinic's algorithm.  Nodes of positive score hang on the source, of negative score on the sink.
    """
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, x in enumerate(scores):
        if x > 0:
            arc(s, k, x, 0.0)
        elif x < 0:
            arc(k, t, -x, 0.0)
    for a, b, weight in edges:
        arc(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def graph(blocks: list[Block], w: Weights) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow one another, and between followers within one container."""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, w.smooth * 0.5 ** tree_distance(blocks[k - 1].element, b.element)))
        box = id(b.element.parent)
        if box in last and last[box] != k - 1:
            edges.append((last[box], k, w.container * 0.5 ** tree_distance(blocks[last[box]].element, b.element)))
        last[box] = k
    return edges


def main_text(page: str | None, weights: Weights | None = None) -> str:
    blocks = parse(page) if page else []
    if not blocks:
        return ""
    w = weights or trained()
    texts = [b.text for b in blocks]
    keep = minimum_cut((features(blocks, texts) @ np.array(w.features)).tolist(), graph(blocks, w))
    return "\n\n".join(t for t, k in zip(texts, keep, strict=True) if k)


# --- The classifier ----------------------------------------------------------------------------------


def sample_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its main text; every block's text stands once."""
    number = iter(range(1, 1 << 30))

    def words(k: int) -> str:
        return " ".join([f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'a', 'en', 'ing'])}" for _ in range(max(1, k - 1))] + [f"x{next(number)}"])

    def sentence(k: int) -> str:
        return words(k).capitalize() + rng.choice(".....!?:")

    def link(text: str) -> str:
        return f"<a href='#'>{text}</a>"

    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return text

    def prose() -> str:
        kind = rng.random()
        if kind < 0.72:
            text = keep(words(rng.randint(1, 14)) if rng.random() < 0.2 else " ".join(sentence(rng.randint(2, 24)) for _ in range(rng.choice((1, 1, 2, 3, 5)))))
            if rng.random() < 0.2:
                head, _, tail = text.partition(" ")
                text = link(head) + " " + tail if tail else text
            harmless = rng.choice(["side-effects", "legal-history", "social-order", "reply-rates", "lead", "intro", "note-worthy"])
            tag = rng.choice(["p"] * 6 + ["div", "div", "div class='p'"])
            return f"<p class='{harmless}'>{text}</p>" if rng.random() < 0.12 else f"<{tag}>{text}</{tag.split()[0]}>"
        if kind < 0.82:
            return f"<h2>{keep(words(rng.randint(1, 6)).capitalize())}</h2>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{keep(rng.choice((words, sentence))(rng.randint(1, 12)))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        return f"<blockquote>{keep(sentence(rng.randint(4, 30)))}</blockquote>"

    def marked(inner: str, mark: str) -> str:
        more = rng.choice(["", "", "-box", "-wrapper", "_area"])
        return f"<{rng.choice(('div', 'div', 'section'))} {rng.choice(('class', 'id'))}='{rng.choice(['', 'c1 '])}{mark}{more}'>{inner}</div>".replace("</div>", "</div></section>")

    def noise(inside: bool) -> str:
        some = lambda: "".join(f"<p>{rng.choice((sentence, sentence, words))(rng.randint(2, 25))}</p>" for _ in range(rng.randint(1, 3)))
        menu = lambda: "<ul>" + "".join(f"<li>{link(words(rng.randint(1, 3)))}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        kinds = [
            lambda: marked(rng.choice((some, menu, lambda: sentence(rng.randint(2, 16))))(), rng.choice(sorted(MARKS))),
            lambda: marked(some(), rng.choice(["comments", "comment", "replies", "ad", "cookie-notice", "related", "sponsored"])),
            lambda: f"<aside>{rng.choice((some, menu))()}</aside>",
            lambda: f"<form><p>{words(rng.randint(1, 9))}</p><label>{words(2)}</label><button>{words(1)}</button></form>",
            lambda: f"<nav>{menu()}</nav>",
            lambda: f"<footer>{rng.choice((some, menu, lambda: words(rng.randint(2, 9))))()}</footer>",
            lambda: f"<div {rng.choice(['hidden', 'aria-hidden=true'])}>{some()}</div>",
            lambda: f"<p>{link(words(rng.randint(1, 4)))}</p>",
        ]
        if not inside:
            kinds += [lambda: f"<header>{words(3)}{menu()}</header>", lambda: f"<div>{words(rng.randint(1, 4))}</div>", lambda: f"<div>{link(words(2))} | {link(words(2))}</div>"]
        return rng.choice(kinds)()

    title = f"<h1>{keep(words(rng.randint(2, 9)).capitalize())}</h1>"
    title = f"<header class='article-header'>{title}</header>" if rng.random() < 0.15 else title
    outside = rng.random() < 0.2
    lead = f"<p>{keep(sentence(rng.randint(3, 14)))}</p>" if rng.random() < 0.3 else ""
    body = "".join(prose() + (noise(True) if rng.random() < 0.12 else "") for _ in range(rng.choice((1, 2, 4, 8, 14))))
    tag = rng.choice(("article", "article", "main", "div", "div id='content'", "section class='post'"))
    wrapped = f"{title + lead if outside else ''}<{tag}>{'' if outside else title + lead}{body}</{tag.split()[0]}>"
    if rng.random() < 0.25:
        wrapped = f"<div class='{rng.choice(['layout has-sidebar', 'page-with-comments', 'with-nav', 'content-and-ads'])}'>{wrapped}</div>"
    page = "".join(noise(False) for _ in range(rng.randint(1, 4))) + wrapped + "".join(noise(False) for _ in range(rng.randint(1, 4)))
    return f"<html><head><title>{words(3)}</title></head><body>{page}</body></html>", kept


@lru_cache(maxsize=1)
def trained(pages: int = 400, seed: int = 17, ridge: float = 0.1) -> Weights:
    """The classifier, fitted on ``pages`` generated pages."""
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(pages):
        page, kept = sample_page(rng)
        blocks = parse(page)
        texts = [b.text for b in blocks]
        main = set(kept)
        rows.append(features(blocks, texts))
        labels += [t in main for t in texts]
    x, y = np.concatenate(rows), np.array(labels, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Weights(tuple(np.round(w, 6).tolist()))


def extract(df: DataFrame, column: str = "html", out: str = "text", weights: Weights | None = None) -> DataFrame:
    """``df`` without its HTML, with the main text of every whole page; null and empty pages give ''.

    A column of ``df`` named as ``out`` is replaced.
    """
    weights = weights or trained()
    keep = [c for c in df.columns if c not in (column, out)]
    df = df.select(*keep, column)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py(), weights) for page in batch.column(column)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, out])

    return df.mapInArrow(lean(run), schema)
