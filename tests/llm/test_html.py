import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from specton.llm import html
from specton.llm.html_pages import made


def truth(page):
    p = html.Page(page)
    main = []
    for i in range(len(p.tag)):
        main.append(p.marked[i] > 0 or p.marked[i] == 0 and i > 0 and main[p.parent[i]])
    return html._text(p, np.array(main, bool))


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_held_out_pages():
    pages = made(150, seed=4242)  # other pages than those it learned from
    got = html.trained()([p.replace(" data-main", "").replace(" data-not", "") for p in pages])
    assert np.mean([f1(truth(p), g) for p, g in zip(pages, got)]) > 0.96


@pytest.mark.parametrize(("naming", "least"), [("words", 0.99), ("opaque", 0.93), ("none", 0.93)])
def test_held_out_pages_by_naming(naming, least):
    """Pages whose class names are words, say nothing, or are missing: the latter two hold no word that was learned."""
    pages = made(100, seed=99, naming=(naming,))
    got = html.trained()([p.replace(" data-main", "").replace(" data-not", "") for p in pages])
    assert np.mean([f1(truth(p), g) for p, g in zip(pages, got)]) > least


@pytest.mark.parametrize("wrap", ['<div class="c1"><div class="q7">%s</div></div>', '<div id="root"><div class="css-1a2b3c">%s</div></div>', "<div>%s</div>", "<article>%s</article>"])
def test_opaque_wrappers_keep_the_article(wrap):
    body = "".join(f"<p>This is sentence number {k} of an article that says something.</p>" for k in range(8))
    assert html.trained()(["<html><body>" + wrap % body + "</body></html>"])[0].count("something.") == 8


@pytest.mark.parametrize("piece", ['<a "x ', '<a x="', "<a x='y", "<svg>", "<b></i>", "<div><p>", "<!x", "</x"])
def test_time_is_in_proportion_to_length(piece):
    begun = time.time()
    html.trained()([piece * (400_000 // len(piece))]) if "div" not in piece else html.Page(piece * 50_000)
    assert time.time() - begun < 15


def test_deep_and_large_pages():
    body = "".join(f"<p>This is sentence number {k} of an article that says something.</p>" for k in range(140_000))
    page = "<html><body>" + "<div>" * 2000 + body + "</div>" * 2000 + "</body></html>"
    assert len(page) > 9_000_000 and html.trained()([page])[0].count("something.") == 140_000


class Plain(HTMLParser):
    """Text of article elements without what a few names say is no text: a plain extractor for the test tables' pages."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.stack = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "img", "input", "meta", "link", "p", "li"):
            self.out.append(" " if tag == "br" else "\n")
            return
        self.stack.append((tag, tag == "article", tag in ("nav", "aside", "script", "style", "form", "footer", "header") or dict(attrs).get("class") in ("ad", "share", "comments", "related", "notice", "cookie")))
        if tag not in html.INLINE:
            self.out.append("\n")

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        if tag not in html.INLINE:
            self.out.append("\n")

    def handle_data(self, data):
        if any(s[1] for s in self.stack) and not any(s[2] for s in self.stack):
            self.out.append(data)


def test_query_equals_a_plain_extractor(spark, sf_dir):
    from specton.llm.registry import op2_html_extraction

    rows = {r.page_id: r for r in op2_html_extraction(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    same = n = 0
    for p in pages:
        if "<article" in p.html:
            own = Plain()
            own.feed(p.html)
            n += 1
            same += rows[p.page_id].text == " ".join("".join(own.out).split())
    assert n > 20 and same >= 0.95 * n


@pytest.mark.parametrize(("page", "text"), [
    ("<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=ad>Buy now</div><article><h1>T &amp; U</h1><p><b>One  two<br><p>three\n four</p></article><footer>&copy; x</footer>", "T & U One two three four"),
    ("<article><p>a<script>var x='</p>'</script>b<!-- c --><i>d</i> e</p><aside>no</aside></article>", "abd e"),
    ("", ""), (None, ""), ("   ", ""), ("<div", ""), ("<!-- never closed", ""), ("<p", ""),
])
def test_small_pages(page, text):
    assert html.trained()([page])[0] == text


def test_decoding_is_consistent():
    r = np.random.default_rng(1)
    n = 200
    parent = np.array([0, *[r.integers(0, i) for i in range(1, n)]])
    depth = np.zeros(n, int)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    keep = html.decode(r.normal(size=n) * 3, np.ones(n), parent, depth)
    assert all(keep[parent[i]] or not keep[i] for i in range(1, n))


def test_decoding_is_the_best_labelling():
    r = np.random.default_rng(2)
    parent, depth = np.array([0, 0, 0, 1, 1, 2, 5]), np.array([0, 1, 1, 2, 2, 2, 3])
    for _ in range(30):
        lo = r.normal(size=7) * 2
        score = lambda y: sum(-np.log1p(np.exp(-v)) if b else -np.log1p(np.exp(v)) for v, b in zip(lo, y))
        every = [[bool(k >> i & 1) for i in range(7)] for k in range(128)]
        allowed = [y for y in every if all(y[parent[i]] or not y[i] for i in range(1, 7))]
        assert np.isclose(score(html.decode(lo, np.ones(7), parent, depth)), max(map(score, allowed)))


def test_frame(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>" + "word " * 50 + "</p></article>", 7, "x"), (2, None, None, None, None), (2, None, None, None, None)], "page_id long, url string, html string, n_chars long, text string")
    got = html.extract(rows).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [249, 0, 0] and got[0].text == ("word " * 50).strip()
    assert html.extract(rows.limit(0)).count() == 0


def test_trees_learn():
    from specton.llm.boosting import BoostedTrees

    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((BoostedTrees(30, 3).fit(x, y).log_odds(x) > 0) == y).mean() > 0.95
