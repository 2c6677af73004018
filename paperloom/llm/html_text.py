"""Operator 9: the main text of web pages, as the contiguous region of the highest score: words score positive, tags negative."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bounded
from paperloom.llm.labelled_pages import labelled_pages

_NAME = re.compile(r"[^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)|(?=[\s>])|([\"'])))?")
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STOP = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
#: Elements whose content is characters up to their end tag, in whatever case.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is not shown as text of the page.
UNSHOWN = {"head", "title", "script", "style", "template", "noscript", "textarea", "select", "option", "datalist", "iframe", "object", "canvas", "svg", "audio", "video", "noembed", "noframes"}
#: Start tags end an open element of these names, unless one of the others stands between.
ENDS = {"li": (("li",), {"ul", "ol", "menu"}), "dt": (("dt", "dd"), {"dl"}), "dd": (("dt", "dd"), {"dl"}), "tr": (("tr",), {"table"}), "td": (("td", "th"), {"tr", "table"}), "th": (("td", "th"), {"tr", "table"}), "option": (("option",), {"select"})}
#: Start tags that end an open paragraph, unless one of the others stands between.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dt dd main menu nav ol p pre section summary table ul".split())
HOLDS_P = {"table", "td", "th", "caption", "button", "object"}
#: Elements that say by their name that they are a part beside something.
PARTS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What any tag costs at least, where a word of an article brings several.
TAG_COST = 0.1
#: What it costs a region to pass over an element.
SKIP = -0.5
#: What an end tag of an inline element does not reach over.
WALLS = {"table", "td", "th", "li", "div", "article", "section", "body", "main", "aside", "nav", "footer", "header", "form", "blockquote", "p"}


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, name or text, attributes, self-closing) of a page, by the rules of HTML: kind is text, start or end. Comments and declarations are left out, and so is a tag that the page's end cuts off."""
    at, n = 0, len(html)
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            yield "text", html[at:end], {}, False
            at = end
            continue
        after = html[at + 1 : at + 2]
        closing = after == "/"
        first = html[at + 2 : at + 3] if closing else after
        if first.isascii() and first.isalpha():
            m = _NAME.match(html, at + 1 + closing)
            name, at, found = m[0].lower(), m.end(), {}
            while True:
                m = _ATTRIBUTE.match(html, at)
                if not m or m[5] is not None:
                    break
                at = m.end()
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            if m:  # a quote that never ends
                return
            end = html.find(">", at)
            if end < 0:
                return
            bare = html[end - 1] == "/"
            at = end + 1
            yield ("end" if closing else "start"), name, found, bare
            if not closing and name in RAW:
                m = RAW[name].search(html, at)
                end = m.start() if m else n
                if end > at:
                    yield "text", html[at:end], {}, False
                at = end
        elif html.startswith("<!--", at):
            if html.startswith(("<!-->", "<!--->"), at):
                at = html.index(">", at) + 1
                continue
            ends = [x + k for x, k in ((html.find("-->", at + 4), 3), (html.find("--!>", at + 4), 4)) if x >= 0]
            at = min(ends, default=n)
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            at = n if end < 0 else end + 3
        elif after in ("!", "?") or closing and first:
            end = html.find(">", at)
            at = n if end < 0 else end + 1
        else:
            yield "text", "<", {}, False
            at += 1


@dataclass
class Page:
    """A page as blocks of text and tags in their order, and its elements: parents stand before children."""

    names: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    marks: list[list[str]] = field(default_factory=list)
    unshown: list[bool] = field(default_factory=list)
    #: Of each token: its element, and its block, or -1 for a tag.
    owners: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    #: Of each block: its text, its words, how many of them are links, its element.
    texts: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    of: list[int] = field(default_factory=list)


def marks_of(name: str, found: dict[str, str]) -> list[str]:
    """What an element calls itself: the words of its classes, role and label, and of its id, unless it is a heading or section, whose id is its topic."""
    out = [f"called {w.lower()}" for c in ("class", "role", "aria-label", "itemprop") for w in _PARTS.split(found.get(c, "")) if w]
    topic = name in HEADINGS or name == "section"
    return out if topic else out + [f"id {w.lower()}" for w in _PARTS.split(found.get("id", "")) if w]


def parse(html: str) -> Page:
    """The blocks, tags and elements of a page. Text that follows a block's border begins a new block; text outside of all markup is a block too."""
    page = Page([""], [-1], [[]], [False])
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each name, its places in the stack
    solid = [0]  # elements that are not inline, innermost last
    pieces: list[str] = []
    linked = 0
    first = -1

    def close_block() -> None:
        nonlocal pieces, linked, first
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            page.owners.append(first)
            page.blocks.append(len(page.texts))
            page.texts.append(text)
            page.sizes.append(text.count(" ") + 1)
            page.links.append(linked)
            page.of.append(first)
        pieces, linked, first = [], 0, -1

    def cut(to: int) -> None:
        while len(stack) > to:
            name, _ = stack.pop()
            places[name].pop()
            if name not in INLINE:
                solid.pop()

    def inside(names: tuple[str, ...], walls: set[str]) -> int:
        """Where the innermost open element of these names stands, unless a wall is nearer; else -1."""
        at = max((places[x][-1] for x in names if places.get(x)), default=-1)
        return at if at >= 0 and all(places[w][-1] < at for w in walls if places.get(w)) else -1

    for kind, name, found, bare in tokens(html):
        if kind == "text":
            near = stack[-1][1] if stack else 0
            if page.unshown[near]:
                continue
            text = unescape(name)
            if text and not text.isspace():
                if first < 0:
                    # a block of one piece takes its inline elements' names too
                    first = near
                elif near != first:
                    first = solid[-1]
                if places.get("a"):
                    linked += len(text.split())
            pieces.append(text)
            continue
        block = name not in INLINE
        if block:
            close_block()
        elif name == "br":
            pieces.append(" ")
            continue
        if kind == "end":
            own = places.get(name)
            if own and (block or all(places[w][-1] < own[-1] for w in WALLS if places.get(w))):
                cut(own[-1])
        else:
            if name in ENDS_P and (at := inside(("p",), HOLDS_P)) >= 0:
                cut(at)
            if name in ENDS and (at := inside(*ENDS[name])) >= 0:
                cut(at)
            if name not in VOID and not (bare and name in ("svg", "path")):
                parent = stack[-1][1] if stack else 0
                at = len(page.names)
                hidden = name in UNSHOWN or "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(found.get("style", "")))
                page.names.append(name)
                page.parents.append(parent)
                page.marks.append(marks_of(name, found))
                page.unshown.append(hidden or page.unshown[parent])
                places.setdefault(name, []).append(len(stack))
                stack.append((name, at))
                if block:
                    solid.append(at)
        if block and not page.unshown[solid[-1]]:
            page.owners.append(solid[-1])
            page.blocks.append(-1)
    close_block()
    return page


def wrapping(page: Page) -> list[bool]:
    """Which elements hold the article rather than being a part beside it, by what they contain: the main element, the largest article (if it is the only one, or has a fifth of the words), or what is around the first heading of the first rank (with two more blocks, and in no header, menu, footer or aside of the page); on pages without any of these, over half of the words."""
    n = len(page.names)
    words, count, beside = [0] * n, [0] * n, [False] * n
    for size, e in zip(page.sizes, page.of, strict=True):
        words[e] += size
        count[e] += 1
    for e in range(n - 1, 0, -1):
        words[page.parents[e]] += words[e]
        count[page.parents[e]] += count[e]
    for e in range(1, n):
        name = page.names[e]
        beside[e] = name not in ("article", "main") and (beside[page.parents[e]] or name in ("nav", "header", "footer", "aside"))
    shown = [e for e in range(n) if not page.unshown[e]]
    held = [e for e in shown if page.names[e] == "main"]
    articles = [e for e in shown if page.names[e] == "article"]
    largest = max(articles, key=lambda e: words[e], default=0)
    if largest and (5 * words[largest] >= words[0] or len(articles) == 1):
        held.append(largest)
    held += [page.parents[e] for e in shown if page.names[e] == "h1" and not beside[e] and count[page.parents[e]] >= 3][:1]
    out = [False] * n
    for e in held:
        while e > 0 and not out[e]:
            out[e] = True
            e = page.parents[e]
    return out if held else [2 * w > words[0] for w in words]


def element_features(page: Page) -> tuple[list[list[str]], list[str]]:
    """Of each element what it is known by, by its name and what it calls itself, and the place that it is: article, part (beside or amid it, by its name) or page."""
    wraps = wrapping(page)
    own, place = [[]], ["page"]
    for e in range(1, len(page.names)):
        name, end, above = page.names[e], "+" if wraps[e] else "", place[page.parents[e]]
        plain = name in INLINE or name in ("html", "body")
        own.append(list(dict.fromkeys(([] if plain else [f"in {name}{end}"]) + ([f"{m}{end}" for m in page.marks[e]] if name not in ("html", "body") else []))))
        place.append("part" if above == "part" or not wraps[e] and name in PARTS else "article" if above == "article" or wraps[e] and not plain else "page")
    return own, place


def headings_above(page: Page) -> list[list[str]]:
    """Of each block the headings that it stands under, as their letters' words, but for those of the first rank and longer ones: a heading holds for what follows in its parent, up to the next of its rank or a higher one."""
    last = list(range(len(page.names)))  # each element's last descendant
    for e in range(len(page.names) - 1, 0, -1):
        last[page.parents[e]] = max(last[page.parents[e]], last[e])
    open_: list[tuple[str, int, str]] = []  # rank, last element under it, words
    out = []
    for text, size, e in zip(page.texts, page.sizes, page.of, strict=True):
        while open_ and e > open_[-1][1]:
            open_.pop()
        at = e
        while page.names[at] in INLINE and at:
            at = page.parents[at]
        while page.names[at] in HEADINGS and open_ and open_[-1][0] >= page.names[at]:
            open_.pop()
        out.append([words for rank, _, words in open_ if rank != "h1" and words])
        if page.names[at] in HEADINGS:
            open_.append((page.names[at], last[page.parents[at]], " ".join(re.findall(r"[a-z]+", text.lower())) if size <= 5 else ""))
    return out


def block_features(page: Page, place: list[str]) -> list[list[str]]:
    """Of each block what its words are known by, but for the elements around it."""
    out = []
    for text, size, linked, e, above in zip(page.texts, page.sizes, page.links, page.of, headings_above(page), strict=True):
        near = e
        while page.names[near] in INLINE:
            near = page.parents[near]
        length = "short" if size <= 3 else "middling" if size <= 9 else "long"
        stop = "stopped" if _STOP.search(text[-8:]) else "open"
        share = "linked" if 2 * linked > size else "some links" if linked else "plain"
        own = ["word", f"word in {page.names[near]}", f"of a {place[e]}", f"{place[e]} {length} {stop}", f"{length} {stop}", f"{share} {length}", *[f"under {w}" for w in above]]
        if size <= 5:
            own += {f"says {w}" for w in re.findall(r"[a-z]+|[©®]", text.lower())}
        out.append(own)
    return out


def path_sums(page: Page, own: list[list[str]], weight: Callable[[str], float]) -> list[float]:
    """Of each element the sum of the weights of all that it and the elements around it are known by, each feature once: one walk, whatever the depth."""
    out, path, held, total = [0.0], [], {}, 0.0
    for e in range(1, len(own)):
        while path and path[-1] != page.parents[e]:
            for f in own[path.pop()]:
                held[f] -= 1
                if not held[f]:
                    total -= weight(f)
        if not path:
            total = 0.0  # no rest of rounding is carried on
        path.append(e)
        for f in own[e]:
            if not held.get(f):
                total += weight(f)
            held[f] = held.get(f, 0) + 1
        out.append(total)
    return out


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous region of the highest sum, by one scan; the first of equals, and none if nothing is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores.tolist()):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


@dataclass
class Scored:
    """A page with the score of a word of each block, and of each token as the region counts it, and the blocks that a region passes over."""

    page: Page
    word: np.ndarray
    token: np.ndarray
    passed: np.ndarray


def scored(html: str, weights: dict[str, float]) -> Scored:
    """Scores of a page: a block's words have the sum of its features' weights, a tag that of its own, which training keeps from being positive.

    A region may pass over an element for SKIP: one that scores less in total, and does not hold most of what scores above
    zero on the page, counts so much and is left out, with all that it holds. So what is no main text amid an article costs
    little and does not end it, and what follows an article is worth no more than its tags.
    """
    page = parse(html)
    own, place = element_features(page)
    get = lambda f: weights.get(f, 0.0)
    words = path_sums(page, own, get)
    tags = path_sums(page, own, lambda f: get(f"tag {f}"))
    word = np.array([sum(map(get, x)) + words[e] for x, e in zip(block_features(page, place), page.of, strict=True)])
    tag = [t + get("tag") + get(f"tag {name}") for t, name in zip(tags, page.names, strict=True)]
    token = np.array([tag[o] if b < 0 else word[b] * page.sizes[b] for o, b in zip(page.owners, page.blocks, strict=True)])
    n = len(page.names)
    value, good = [0.0] * n, [0.0] * n
    for o, b, t in zip(page.owners, page.blocks, token.tolist(), strict=True):
        value[o] += t
        good[o] += max(0.0, t) if b >= 0 else 0.0
    passed = [False] * n
    for e in range(n - 1, 0, -1):
        good[page.parents[e]] += good[e]
    for e in range(n - 1, 0, -1):
        passed[e] = page.names[e] not in INLINE and value[e] < SKIP and 2 * good[e] <= good[0]
        value[page.parents[e]] += SKIP if passed[e] else value[e]
    top = [0] * n  # the outermost passed element around, itself included
    for e in range(1, n):
        top[e] = top[page.parents[e]] or (e if passed[e] else 0)
    met: set[int] = set()
    left_out = np.zeros(len(word), bool)
    for i, (o, b) in enumerate(zip(page.owners, page.blocks, strict=True)):
        if top[o]:
            token[i] = 0.0 if top[o] in met else SKIP
            met.add(top[o])
            if b >= 0:
                left_out[b] = True
    return Scored(page, word, token, left_out)


def train(pages: list[tuple[str, list[str]]], rounds: int = 300, rate: float = 0.8) -> dict[str, float]:
    """Weights from labelled pages (html and the blocks of its main text) by logistic regression: are a block's words main text, is a tag within it?

    Words count up to 20 a block. Tags' weights are kept from being positive, and any tag costs TAG_COST at least.
    Features never seen count nothing.
    """
    names: dict[str, int] = {}
    rows, marks, sizes = [], [], []
    for html, wanted in pages:
        page = parse(html)
        own_features, place = element_features(page)
        around: list[list[str]] = [[]]
        for e in range(1, len(page.names)):
            around.append(list(dict.fromkeys([*around[page.parents[e]], *own_features[e]])))
        of_blocks = [[*x, *around[e]] for x, e in zip(block_features(page, place), page.of, strict=True)]
        left = list(wanted)
        inside = []
        for text in page.texts:
            hit = text in left
            if hit:
                del left[: left.index(text) + 1]
            inside.append(hit)
        places = [i for i, b in enumerate(page.blocks) if b >= 0 and inside[b]]
        region = range(places[0], places[-1] + 1) if places else range(0)
        for i, (o, b) in enumerate(zip(page.owners, page.blocks, strict=True)):
            own = of_blocks[b] if b >= 0 else ["tag", f"tag {page.names[o]}", *[f"tag {f}" for f in around[o]]]
            rows.append([names.setdefault(f, len(names)) for f in own])
            marks.append(float(inside[b]) if b >= 0 else float(i in region))
            sizes.append(min(page.sizes[b], 20) if b >= 0 else 1)
    flat = np.array([f for own in rows for f in own], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(own) for own in rows])
    y, size = np.array(marks), np.array(sizes, float) / sum(sizes)
    tags = np.array([f.startswith("tag") for f in names])
    seen = np.bincount(flat, minlength=len(names))
    # what stands in very few blocks is chance
    flat_kept = seen[flat] >= 6
    flat, row = flat[flat_kept], row[flat_kept]
    base = names["tag"]
    w, g = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[flat], len(rows))
        error = size * (1 / (1 + np.exp(-z)) - y)
        d = np.bincount(flat, error[row], len(names)) + 2e-6 * w
        g += d**2
        w -= rate * d / np.sqrt(g)
        w[tags] = np.minimum(w[tags], 0.0)
        w[base] = min(w[base], -TAG_COST)
    return {f: float(w[i]) for f, i in names.items() if w[i]}


@functools.cache
def default_weights() -> dict[str, float]:
    """The weights of labelled_pages(), trained once in a process."""
    return train(labelled_pages())


def region_blocks(found: Scored) -> list[int]:
    """The blocks of the best region, without those that it passes over."""
    start, end = best_region(found.token)
    return [b for b in found.page.blocks[start:end] if b >= 0 and not found.passed[b]]


def main_text(html: str, weights: dict[str, float]) -> str:
    """The text of the best region: its blocks, without what it passes over, joined by line ends."""
    found = scored(html, weights)
    return "\n".join(found.page.texts[b] for b in region_blocks(found))


def page_texts(pages: DataFrame, weights: dict[str, float] | None = None, passing: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """The columns passing, text (the main text, empty if none) and n_chars (its code points) of every row.

    A null html is an empty page. Broken markup is read as far as it goes: what is not closed ends with what is around
    it. Character references are decoded, white space in a block is one space, blocks are joined by a line end. Ids may
    be null or repeated; other columns are not read; an empty table gives an empty result. weights: of train(); those
    of labelled_pages() if not given.
    """
    weights = weights if weights is not None else default_weights()
    schema = pages.select(*passing).schema.add("text", "string").add("n_chars", "long")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(it, "__html"):
            texts = [main_text(x or "", weights) for x in batch.column("__html").to_pylist()]
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*passing, "text", "n_chars"])

    return pages.select(*passing, F.col(html_column).alias("__html")).mapInArrow(work, schema)
