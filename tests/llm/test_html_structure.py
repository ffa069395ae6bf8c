"""Main text: what class names, densities and depth may do to it."""

import re
import time

import pytest

from quire.llm import html_density

TEXT = "<p>Some words of the article, as long as it takes.</p><p>And some more of them, in one more line.</p>"


@pytest.mark.parametrize("title", ['<h1 class="page-header">T</h1>', '<h1 class="post-header">T</h1>', '<div class="entry-header"><h1>T</h1></div>', '<h1 id="top-notice">T</h1>'])
@pytest.mark.parametrize("box", ["article", "div", "main", "section"])
def test_titles_stay_whatever_they_are_called(title, box):
    page = f'<body><nav><a href="a">One</a></nav><{box}>{title}{TEXT}</{box}><div class="site-footer"><p>Foot.</p></div></body>'
    assert html_density.main_text(page).startswith("T\n\nSome words") and "Foot" not in html_density.main_text(page)


@pytest.mark.parametrize("part", ['<section id="notice-periods"><p>Keep.</p></section>', '<p class="no-comments">Keep.</p>', '<table class="share-prices"><tr><td>Keep.</table>', '<div class="ad-hoc">Keep.</div>', '<h2 class="related">Keep.</h2>'])
def test_class_names_do_not_cut_text_within_an_article(part):
    assert "Keep." in html_density.main_text(f"<body><article><h1>T</h1>{TEXT}{part}</article></body>")


@pytest.mark.parametrize("part", ['<div class="ad">Go.</div>', '<div class="ads-box">Go.</div>', '<div id="related-posts"><p>Go.</p></div>', '<div style="color:red; display : none">Go.</div>', '<p style="visibility:hidden">Go.</p>', '<ul class="share-buttons"><li>Go.</ul>'])
def test_furniture_within_an_article_goes(part):
    page = f"<body><article><h1>T</h1>{TEXT}{part}</article></body>"
    assert ("Go." in html_density.main_text(page)) == part.startswith("<ul")


def test_boxes_of_links_go_by_density_alone():
    links = "".join(f'<a href="{i}">Another headline that leads away {i}</a> ' for i in range(8))
    page = f"<body><div><div>{links}</div><div><h1>T</h1>{TEXT * 5}</div><div>{links}</div></div></body>"
    assert "leads away" not in html_density.main_text(page) and html_density.main_text(page).startswith("T\n\n")


def test_pages_without_names_keep_the_article(spark, sf_dir):
    """Without names of elements, classes, ids and roles, densities keep the article and drop most of the rest."""
    left = before = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:nav|header|footer|aside|form|article|main)\b", r"<\1div", r.html)
        plain = re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", plain)
        want, got = html_density.main_text(r.html).split("\n\n"), html_density.main_text(plain).split("\n\n")
        assert set(want) <= set(got)
        page = html_density.Page(plain)
        left += len(got) - len(want)
        before += len(page.blocks({0})) - len(want)
    assert left < 0.2 * before


def brute_densities(page):
    """Characters, linked characters and elements of every node, counted below it one node at a time."""
    n = len(page.names)
    below = [[j for j in range(n) if i in list(up(page, j))] for i in range(n)]
    return [(len(x), sum(page.names[j] == "a" for j in x)) for x in below]


def up(page, i):
    while i >= 0:
        yield i
        i = page.parents[i]


def test_sums_over_subtrees_against_counting(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(5).collect():
        page = html_density.Page(r.html)
        ones = page._sums([1.0] * len(page.names))
        links = page._sums([float(x == "a") for x in page.names])
        assert list(zip(ones, links)) == brute_densities(page)


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<center>", "<p><span>", "<ul><li>", "<table><tr><td>", "<article>", "</div>", "<p>x", "<a href='"])
def test_deep_pages_take_linear_time(unit):
    began = time.time()
    html_density.main_text(unit * 50_000 + "text")
    assert time.time() - began < 5
