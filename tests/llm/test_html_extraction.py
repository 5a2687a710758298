"""Page extraction: the parser, the choice of states against enumeration, accuracy on pages it has not seen, odd inputs."""

from __future__ import annotations

import itertools
import re
import time
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import boosting, html_extraction, html_pages
from tidewater.llm.html_dom import NAMES, Forest, Page, attribute_tokens
from tidewater.llm.queries import QUERIES

MODEL = (html_extraction.TRAINING_PAGES, html_extraction.ROUNDS, html_extraction.DEPTH, html_extraction.SEED)


def whole(html):
    """All text of a page, as the extractor joins it."""
    return " ".join("".join(t for _, t, _ in Page(html).parts).split())


def shape(html):
    p = Page(html)
    return [(NAMES[k], u) for k, u in zip(p.kind, p.parent)]


def test_parser_texts():
    assert whole("<p>a<b>b</b>c<p>d<br>e<ul><li>f<li>g</ul>&amp;&lt;h&am") == "abc d e f g &<h&am"
    assert whole("x<script>var t='</p>';</script>y<style>p{}</style><!-- a > b -->z<title>no</title>") == "xyz"
    assert whole("a < b <3 &copy; <? x ?><!doctype html><a title='>\"'>c</a>") == "a < b <3 © c"
    assert whole("a<!-- open <p>b") == "a" and whole("a<script>b") == "a" and whole("a <b title=\"x>y</b> z") == "a y z" and whole("a <b") == "a"
    assert whole("") == "" and whole("<div></div>") == "" and whole("plain  text") == "plain text"


def test_parser_trees():
    assert shape("<p>a<p>b") == [("body", -1), ("p", 0), ("p", 0)]
    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("body", -1), ("ul", 0), ("li", 1), ("li", 1), ("text", 3), ("ul", 3), ("li", 5), ("li", 1)]
    assert shape("<div>a<p>b</p>c</div>d") == [("body", -1), ("div", 0), ("text", 1), ("p", 1), ("text", 1), ("text", 0)]
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == [("body", -1), ("table", 0), ("table", 1), ("table", 2), ("table", 2), ("table", 1), ("table", 5)]
    assert shape('<p>a<span class="x"><span>b</span>c</span>d</p></div>')[1:] == [("p", 0), ("text", 1), ("inline", 1), ("text", 1)]
    links = [(t, link) for n, t, link in Page('<div><a href="/">a<b>b</b></a>c<p><a>d</p>e</div>').parts if n >= 0]
    assert links == [("a", True), ("b", True), ("c", False), ("d", True), ("e", False)]


def test_attribute_tokens():
    assert attribute_tokens(' class="main-Nav topBar" id=x1 data-class="no" hidden') == ("main", "nav", "top", "bar", "x", "hidden")
    assert attribute_tokens(' style="DISPLAY : none"') == ("hidden",) and attribute_tokens(" href='class=x'") == ()


@pytest.mark.parametrize("html", ["<div>" * 20000, "<a <b " * 20000, '<a "' * 20001, "<p>a" * 20000 + "</div>" * 20000, "<ul><li>" * 10000 + "</x>" * 10000, "<!-" * 20000, "&amp" * 30000, "<li><div>" * 10000, "<b class=x>" * 10000 + "</i>" * 10000])
def test_odd_pages_take_linear_time(html):
    start = time.perf_counter()
    html_extraction.main_texts([Page(html)], *html_extraction.fitted(60, 3, 3, 1))
    assert time.perf_counter() - start < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(0, 10**6))
def test_states_are_the_likeliest_that_fit(parents, seed):
    r = np.random.default_rng(seed)
    parent = [-1, *[min(p, k) for k, p in enumerate(parents)]]
    n = len(parent)
    page = Page("")
    page.kind, page.parent, page.tokens = [0] * n, parent, [()] * n
    page.depth = [0] * n
    for k in range(1, n):
        page.depth[k] = page.depth[parent[k]] + 1
    page.parts = [(k, "x", False) for k in range(n) if r.random() < 0.8]
    forest, chance = Forest([page]), np.log(r.dirichlet([1, 1, 1], n))
    has = forest.up(forest.own[:, 0]) > 0
    leaf = [k not in parent for k in range(n)]

    def value(states):
        fits = all(u < 0 or states[u] == 2 or states[k] == states[u] for k, u in enumerate(parent)) and not any(s == 2 and leaf[k] for k, s in enumerate(states))
        return sum(chance[k, s] for k, s in enumerate(states) if has[k]) if fits else -np.inf

    every = list(itertools.product(range(3), repeat=n))
    top = max(map(value, every))
    got = html_extraction.decode(forest, chance).tolist()
    assert any([s == 0 for s in x] == got for x in every if value(x) > top - 1e-9)


def test_trees_learn():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, np.where(x[:, 2] > 0.3, 1, 2))
    trees = boosting.fit(x[:2000], y[:2000], 3, rounds=20, depth=4)
    scores = trees.scores(x[2000:])
    assert (scores.argmax(1) == y[2000:]).mean() > 0.9 and np.allclose(np.exp(scores).sum(1), 1)
    assert boosting.fit(x[:50], np.zeros(50, int), 3, rounds=2, depth=2).scores(x[:5]).argmax(1).tolist() == [0] * 5


def test_composed_pages_not_seen_in_the_fit():
    trees, odds = html_extraction.fitted(*MODEL)
    made, sizes = html_extraction.labelled(html_pages.pages(200, 77))
    forest, own = Forest(made), np.concatenate(sizes)
    keep = html_extraction.decode(forest, trees.scores(forest.features(odds)))
    assert own[keep, 0].sum() > 0.99 * own[:, 0].sum() and own[keep, 0].sum() > 0.98 * own[keep].sum()
    wrong = np.where(keep, own[:, 1], own[:, 0]) > 0
    assert len(np.unique(forest.page[wrong])) < 20


HAND_MADE = {
    "A title First paragraph, with a link. Second. one two": '<body class="single"><header id="masthead"><a href="/">Site</a><nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav></header><div id="content"><h1 class="entry-title">A title</h1><div class="entry-content"><p>First paragraph, with a <a href="/x">link</a>.</p><div class="ad-slot">Buy now, cheap watches.</div><p>Second.</p><ul><li>one<li>two</ul></div><div id="comments" class="comments-area"><ol><li><div class="comment-body"><p>I completely agree with all of this, it is very well written.</p></div></li></ol><form><label>Name</label><input><button>Post</button></form></div></div><aside class="widget-area"><h2>Recent posts</h2><ul><li><a href="1">Another post</a></li></ul></aside><footer><p>&copy; 2024 Site.</p></footer></body>',
    "T Hi.": '<body><div class="cookie-banner">We use cookies to make this site better. <button>Accept</button></div><main><h1>T</h1><p>Hi.</p></main><div class="newsletter">Get our letter<form><input><button>Go</button></form></div></body>',
    "Short Of.": '<body><header><h1>Site</h1><p>tagline here</p></header><aside class="sidebar"><p>About the author: a long text about who wrote this page and why.</p></aside><article><h1>Short</h1><p>Of.</p></article><section id="comments"><article class="comment"><p>A long comment that says a lot of things about all sorts of matters, and on it goes.</p></article></section><footer>c</footer>',
    "no tags, & all": "no tags, &amp; all",
}


def test_hand_made_pages():
    trees, odds = html_extraction.fitted(*MODEL)
    assert html_extraction.main_texts([Page(h) for h in HAND_MADE.values()], trees, odds) == list(HAND_MADE)


def plain(html):
    """The article of the pages at hand, cut out by its tag."""
    inner = html[html.index("<article>") : html.index("</article>")]
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_query_on_whole_pages(spark):
    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        own = got[r.page_id]
        assert (own.url, own.text, own.n_chars) == (r.url, plain(r.html), len(plain(r.html)))


def test_odd_rows(spark):
    rows = [(1, "u", None, "x", 3), (1, "u", "", "y", 4), (None, None, "<p>word here</p>", None, None), (2, "u", "<p>word here</p>", "z", 1), (3, "u", "<nav></nav>", "z", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html int")
    out = html_extraction.extract(df)
    assert out.columns == ["page_id", "url", "_html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "word here", 9), (1, "", 0), (1, "", 0), (2, "word here", 9), (3, "", 0)]
    assert html_extraction.extract(df.where("false")).collect() == []
