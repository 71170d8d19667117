"""Page extraction: densities recomputed node by node, marks as hints, broken pages in linear time."""

import math
import random
import time

import pytest

from papyrine.llm import html_text
from tests.llm.test_others import found


def random_page(rnd, depth=0):
    """Balanced markup of blocks, links and text."""
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        if kind < 0.4 or depth > 4:
            out.append(" ".join(rnd.choices(["tax", "firm", "a", "market,", "prices."], k=rnd.randint(1, 30))))
        elif kind < 0.55:
            out.append(f"<a href=x>{' '.join(rnd.choices(['more', 'link'], k=rnd.randint(1, 5)))}</a>")
        else:
            tag = rnd.choice(["div", "section", "p", "ul", "li", "b"] if depth < 4 else ["b", "i"])
            out.append(f"<{tag}>{random_page(rnd, depth + 1) if tag != 'p' else 'text of a paragraph ' * rnd.randint(1, 5)}</{tag}>")
    return "".join(out)


def below(page, node):
    """All nodes of a subtree, by walking up from every node."""
    inside = []
    for i in range(len(page.name)):
        j = i
        while j not in (node, -1):
            j = page.parent[j]
        if j == node:
            inside.append(i)
    return inside


@pytest.mark.parametrize("seed", range(12))
def test_density_of_every_node(seed):
    """Characters, tags and links of each node counted anew from its own subtree, and the node with the largest sum."""
    page = html_text.Page(f"<html><body>{random_page(random.Random(seed))}</body></html>")
    n = len(page.name)

    def links_above(i):
        while i > 0:
            if page.name[i] == "a":
                return True
            i = page.parent[i]
        return False

    def plain(node):
        inside = set(below(page, node))
        sizes = [(len(" ".join(t.split())), links_above(i)) for i, t in page.pieces if t and i in inside]
        return sum(s for s, _ in sizes), len(inside) - 1, sum(s for s, a in sizes if a), sum(page.name[i] == "a" for i in inside - {node})

    want = [plain(i) for i in range(n)]
    assert list(zip(*page.statistics([False] * n), strict=True)) == want
    body = page.name.index("body")
    ratio = want[body][2] / want[body][0]

    def density(node):
        c, t, lc, lt = want[node]
        if not c:
            return 0.0
        t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
        return c / t * math.log(max(1.0, c * t / lc / lt)) / math.log(c / max(1, c - want[node][2]) * want[node][2] + ratio * c + math.e)

    for i in range(n):
        c, t, lc, lt = want[i]
        assert (html_text.composite_density(c, t, lc, lt, ratio) if c else 0.0) == pytest.approx(density(i))
    sums = [sum(density(j) for j in range(n) if page.parent[j] == i and page.name[j] not in html_text.INLINE) for i in range(n)]
    best = max((i for i in range(n) if want[i][0]), key=lambda i: (sums[i], -i))
    text = page.main_text()
    own = " ".join("".join(t if t else " " if page.name[i] not in html_text.INLINE else "" for i, t in page.pieces if i in set(below(page, best))).split())
    assert sums[best] == 0 or page.name[best] in html_text.INLINE or own in text


LONG = "{} words of a paragraph that is long enough to be dense and to count as text of the article, ".format
ARTICLE = "<body><article><h1>T</h1><p>{}</p>{}<p>{}</p></article></body>"


@pytest.mark.parametrize(
    "block",
    [
        "<p class='social-history'>{}</p>",
        "<div class='notice-period'>{}</div>",
        "<div class='header'>{}</div>",
        "<p id=search-theory>{}</p>",
        "<div class='copyright law'>{}</div>",
        "<section class='research header-bidding commentary'>{}</section>",
    ],
)
def test_names_that_hold_a_listed_word_stay(block):
    text = html_text.main_text(ARTICLE.format(LONG("first") * 3, block.format(LONG("middle") * 3), LONG("last") * 3))
    assert [text.count(w) for w in ("first", "middle", "last")] == [3, 3, 3]


@pytest.mark.parametrize("block", ["<div class=ad>{}</div>", "<div class='site-nav top'>{}</div>", "<section id=comments><p>{}</p></section>", "<div class='cookie-notice'>{}</div>", "<ul class=sidebar><li>{}</ul>", "<div hidden>{}</div>", "<p style='display: none'>{}</p>"])
def test_blocks_beside_the_article_go(block):
    text = html_text.main_text(ARTICLE.format(LONG("first") * 3, block.format(LONG("middle") * 5), LONG("last") * 3))
    assert [text.count(w) for w in ("first", "middle", "last")] == [3, 0, 3]


def test_a_hint_without_an_article_element_is_judged_by_density():
    page = f"<body><h1>T</h1><div class=header>{LONG('middle') * 4}</div><p>{LONG('first') * 3}</p><p>{LONG('last') * 3}</p><div class=share><a href=x>Share</a></div></body>"
    text = html_text.main_text(page)
    assert [text.count(w) for w in ("first", "middle", "last", "Share")] == [3, 4, 3, 0]


def test_hints_go_where_they_are_thin_or_beside():
    thin = "<div class='share'><a href=x>Share</a> <a href=y>it</a></div>"
    assert html_text.main_text(ARTICLE.format(LONG("first") * 3, thin, LONG("last") * 3)).count("Share") == 0
    page = f"<body><div class=notice>{LONG('notice') * 5}</div><article><h1>T</h1><p>{LONG('first') * 3}</p><p>{LONG('last') * 3}</p></article></body>"
    assert html_text.main_text(page).count("notice words") == 0


@pytest.mark.parametrize(
    "page",
    ["<div>" * 40_000, '<p "' * 50_000, "<div>" * 20_000 + "</foo>" * 20_000, '<p a=">" ' * 25_000, "<b><div>" + "<i>" * 25_000 + "</b>" * 25_000, "<script></script" * 12_000, "<" * 200_000, "<!-" * 60_000, "</" * 100_000, "<p><li>" * 28_000, "<table><tr><td>" * 13_000, "<a href='" * 20_000],
)
def test_broken_pages_take_linear_time(page):
    """Some 200 KB of each kind of broken markup in about a second (they took minutes in quadratic time)."""
    began = time.process_time()
    html_text.main_text("<p>text</p>" + page)
    assert time.process_time() - began < 4


def test_an_empty_table_and_clashing_names(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    assert found(html_text.extract(spark.createDataFrame([(1, None, "<p>x", "y", "z")], schema))) == [(1, None, "x", 1)]
