"""Main text of web pages: boosted trees over DOM nodes, then one consistent choice of nodes for each page.

A page becomes a tree of its elements (inline markup belongs to the block around it unless it has a class or id). Every
node has features: its tag, the evidence of its class, id and role words, text and link density of its subtree, depth,
its place among its siblings, and the same evidence inherited from its ancestors. Boosted trees, trained on pages made
by ``html_pages`` whose main text is known, give each node a log-odds of being main. The decoding takes the most likely
labelling in which nothing below a left-out node is kept, by one pass over the tree's levels.

Defined results: null or empty html, or a page without kept text, gives the empty string; repeated rows are read each;
an empty table gives no rows. Character references are decoded, white space inside a block is one space, blocks are
joined by one space; ``script``, ``style`` and the like never give text. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specton.llm.boosting import BoostedTrees
from specton.llm.common import small_batches, unused

#: Elements without an end tag, elements whose content is no markup, elements without main text, inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
TAGS = tuple("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button fieldset details address span a".split())
#: An opening tag of the first ends an open element of the second.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: The elements an implied end tag does not reach out of.
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("table", "td", "th", "button", "article", "section", "div", "body")}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_TAIL = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?…。]")


class Page:
    """Nodes in page order: parent, depth, tag, attribute words, inline flag; and the text runs with their nodes."""

    __slots__ = ("parent", "depth", "tag", "words", "inline", "marked", "runs")

    def __init__(self, html: str) -> None:
        self.parent, self.depth, self.tag, self.words, self.inline, self.marked = [-1], [0], ["#"], [()], [False], [0]
        self.runs: list[tuple[int, str, bool]] = []  # node, text, whether in a link; a node of -1 is a line break
        stack: list[tuple[str, int]] = [("#", 0)]
        opened: dict[str, int] = {}
        gone: set[str] = set()  # quotes and end tags that don't come any more
        links, at, end, text_from = 0, 0, len(html), 0

        def close(k: int) -> int:
            """Close the open elements from the kth on: how many of them are links."""
            for name, _ in stack[k:]:
                opened[name] -= 1
            n = sum(s[0] == "a" for s in stack[k:])
            del stack[k:]
            return n

        def imply(names: tuple, scope: tuple) -> int:
            if any(opened.get(x) for x in names):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in names:
                        return close(k)
                    if stack[k][0] in scope:
                        break
            return 0

        while at < end:
            begin = html.find("<", at)
            if begin < 0:
                break
            m = _NAME.match(html, begin)
            if m:
                stop = self._tag_end(html, m.end(), gone)
            elif html.startswith("<!--", begin):
                stop = html.find("-->", begin) + 3
                stop = stop if stop > 2 else end
            elif html.startswith("<![CDATA[", begin):
                stop = html.find("]]>", begin) + 3
                stop = stop if stop > 2 else end
            elif html.startswith(("<!", "<?", "</"), begin):
                stop = html.find(">", begin) + 1 or end
            else:  # a lone sign is text
                at = begin + 1
                continue
            if begin > text_from:
                self.runs.append((stack[-1][1], html[text_from:begin], links > 0))
            at = text_from = stop
            if not m:
                continue
            name = m[1].lower()
            if html[begin + 1] == "/":
                if opened.get(name):
                    links -= close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                continue
            attributes = html[m.end() : stop - 1]
            if name in RAW:
                tail = None if attributes.endswith("/") and name in ("svg", "math", "object") or name in gone else _TAIL[name].search(html, at)
                if not tail:
                    gone.add(name)
                at = text_from = tail.end() if tail else (end if name in ("script", "style", "textarea", "title") else at)
                continue
            if name in ("br", "hr"):
                self.runs.append((-1, " ", False))
            if name in VOID:
                continue
            if name in BLOCKS_END_P:
                links -= imply(("p",), SCOPE["p"])
            elif name in CLOSES:
                links -= imply(CLOSES[name], SCOPE[name])
            words = self._attributes(attributes) if len(attributes) > 1 else ()
            if name in INLINE and not words:
                stack.append((name, stack[-1][1]))
            else:
                above = stack[-1][1]
                self.parent.append(above)
                self.depth.append(self.depth[above] + 1)
                self.tag.append(name)
                self.words.append(words)
                self.inline.append(name in INLINE)
                self.marked.append(1 if "data-main" in attributes else -1 if "data-not" in attributes else 0)
                stack.append((name, len(self.tag) - 1))
            opened[name] = opened.get(name, 0) + 1
            links += name == "a"
        if end > text_from:
            self.runs.append((stack[-1][1], html[text_from:], links > 0))

    @staticmethod
    def _tag_end(html: str, at: int, gone: set[str]) -> int:
        """Where the tag ends: at the first > outside a quoted value; a quote that is never closed is none. Nothing is
        looked for twice, so a page takes time in proportion to its length."""
        while m := _TAG_STOP.search(html, at):
            at = m.end()
            if not m[1]:
                return at
            if m[1] not in gone:
                close = html.find(m[1], at)
                if close < 0:
                    gone.add(m[1])
                else:
                    at = close + 1
        return len(html)

    @staticmethod
    def _attributes(text: str) -> tuple:
        out = []
        for name, value in _ATTRIBUTE.findall(text):
            name = name.lower()
            if name in ("class", "id", "role", "itemprop"):
                out += (w.lower() for w in _WORDS.findall(value))
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and "true" in value:
                out.append("hidden")
        return tuple(out)


def _text(page: Page, keep: np.ndarray) -> str:
    """The kept runs: inline nodes run on, every other change of node begins a new block."""
    out, block, last = [], [], 0
    anchor = list(range(len(page.tag)))
    for n in range(1, len(anchor)):
        if page.inline[n]:
            anchor[n] = anchor[page.parent[n]]
    for node, text, _ in page.runs:
        if node < 0:
            block.append(" ")
            continue
        if anchor[node] != last:
            out.append("".join(block))
            block, last = [], anchor[node]
        if keep[node]:
            block.append(text)
    out.append("".join(block))
    done = (_SPACE.sub(" ", unescape(b)).strip() for b in out)
    return " ".join(b for b in done if b)


#: Names of the features, in their order.
FEATURES = ["words", "words_low", "above_low", "above_high", "tag_score", "above_tag_low", "above_tag_high", "depth", "children", "log_text", "log_own", "link_share", "stops", "density", "share", "siblings", "same_tag", "sibling_text", "place", "before", "log_subtree", "parent_words", "parent_tag", "parent_text", "parent_link_share"]


def features(pages: list[Page], evidence: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row for each node of all pages; with parent (as row), depth and page number."""
    sizes = [len(p.tag) for p in pages]
    first = np.cumsum([0, *sizes])
    parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=False)])
    depth = np.concatenate([np.array(p.depth) for p in pages])
    owner = np.repeat(np.arange(len(pages)), sizes)
    n = len(parent)
    roots = first[:-1]
    parent[roots] = roots
    own_node, own_len, own_link, own_stop, own_page_at = [], [], [], [], []
    for p, f in zip(pages, first, strict=False):
        seen = 0
        for node, text, link in p.runs:
            if node >= 0 and not text.isspace():
                size = len(text)
                own_node.append(node + f)
                own_len.append(size)
                own_link.append(size if link else 0)
                own_stop.append(len(_STOP.findall(text)))
                own_page_at.append(seen)
                seen += size
    own_node = np.array(own_node, np.int64)
    text = np.bincount(own_node, own_len, n) if len(own_node) else np.zeros(n)
    link = np.bincount(own_node, own_link, n) if len(own_node) else np.zeros(n)
    stop = np.bincount(own_node, own_stop, n) if len(own_node) else np.zeros(n)
    before = np.full(n, np.inf)
    if len(own_node):
        np.minimum.at(before, own_node, own_page_at)
    own = text.copy()
    nodes = np.ones(n)
    levels = _levels(depth)
    for at in reversed(levels):
        for x in (text, link, stop, nodes):
            np.add.at(x, parent[at], x[at])
        np.minimum.at(before, parent[at], before[at])
    score = lambda w: evidence.get(w, 0.0)
    words = np.zeros(n)
    low = np.zeros(n)
    flat = [w for p in pages for w in p.words]
    for i, w in enumerate(flat):
        if w:
            s = [score(x) for x in w]
            words[i], low[i] = sum(s), min(s)
    tag = np.array([score("<" + t) for p in pages for t in p.tag])
    above_low, above_high, tag_low, tag_high = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for at in levels:
        up = parent[at]
        above_low[at], above_high[at] = np.minimum(above_low[up], low[up]), np.maximum(above_high[up], words[up])
        tag_low[at], tag_high[at] = np.minimum(tag_low[up], tag[up]), np.maximum(tag_high[up], tag[up])
    child = np.ones(n, bool)
    child[roots] = False
    children = np.bincount(parent[child], minlength=n)
    kinds = {t: i for i, t in enumerate(TAGS)}
    kind = np.array([kinds.get(t, len(TAGS)) for p in pages for t in p.tag])
    key = parent * (len(TAGS) + 1) + kind
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    total = text[roots][owner]
    up_text = text[parent]
    before = np.where(np.isfinite(before), before, total)
    x = np.stack([
        words, low, above_low, above_high, tag, tag_low, tag_high, depth, children, np.log1p(text), np.log1p(own), link / np.maximum(text, 1), 100 * stop / np.maximum(text, 1), text / nodes, text / np.maximum(total, 1),
        children[parent], count[inverse], (up_text - text) / np.maximum(children[parent], 1), before / np.maximum(total, 1), np.log1p(before), np.log1p(nodes), words[parent], tag[parent], np.log1p(up_text), link[parent] / np.maximum(up_text, 1),
    ], 1)
    return x, parent, depth, owner


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth from 1 on."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])[1:] if len(depth) else []


def decode(log_odds: np.ndarray, weight: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely labels in which no node below a left-out one is kept."""
    yes = -np.log1p(np.exp(-np.clip(log_odds, -30, 30))) * weight
    no = -np.log1p(np.exp(np.clip(log_odds, -30, 30))) * weight
    levels = _levels(depth)
    for at in reversed(levels):
        np.add.at(no, parent[at], no[at])
        np.add.at(yes, parent[at], np.maximum(yes[at], no[at]))
    keep = yes > no
    for at in levels:
        keep[at] &= keep[parent[at]]
    return keep


class Extractor:
    """Evidence of words and tags, and the boosted trees; both learned from pages whose main nodes are marked."""

    def __init__(self, pages: list[Page]) -> None:
        labels = [self._labels(p) for p in pages]
        counts: dict[str, list[float]] = {}
        for p, own in zip(pages, labels, strict=True):
            for tag, words, y in zip(p.tag, p.words, own, strict=True):
                for w in {"<" + tag, *words}:
                    counts.setdefault(w, [0.0, 0.0])[y] += 1
        self.evidence = {w: float(np.log((yes + 1) / (no + 1))) for w, (no, yes) in counts.items() if yes + no >= 5}
        x, _, _, _ = features(pages, self.evidence)
        self.trees = BoostedTrees(50, 5).fit(x, np.concatenate(labels).astype(float))

    @staticmethod
    def _labels(page: Page) -> list[int]:
        main = [0] * len(page.tag)
        for i in range(len(main)):
            main[i] = int(page.marked[i] > 0 or page.marked[i] == 0 and i > 0 and main[page.parent[i]])
        out = main[:]
        for i in range(len(main) - 1, 0, -1):
            if out[i]:
                out[page.parent[i]] = 1
        return out

    def __call__(self, htmls: list[str | None]) -> list[str]:
        pages = [Page(h or "") for h in htmls]
        if not pages:
            return []
        x, parent, depth, owner = features(pages, self.evidence)
        keep = decode(self.trees.log_odds(x), np.ones(len(x)), parent, depth)
        first = np.searchsorted(owner, np.arange(len(pages) + 1))
        return [_text(p, keep[a:b]) for p, a, b in zip(pages, first, first[1:], strict=False)]


@cache
def trained() -> Extractor:
    """The extractor, learned from the made pages: the same one in every process."""
    from specton.llm.html_pages import made

    return Extractor([Page(h) for h in made()])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The input without its html, with text and n_chars (code points); columns of those names are replaced."""
    model = trained()

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in columns:
            texts: list[str] = []
            for k in range(0, len(s), 100):
                texts += model([h if isinstance(h, str) else None for h in s.iloc[k : k + 100]])
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    main = F.pandas_udf(run, "text string, n_chars long")
    columns = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    m = unused(pages, "main")
    return small_batches(pages).select(*columns, main(F.col(html).cast("string")).alias(m)).select(*columns, f"{m}.text", f"{m}.n_chars")
