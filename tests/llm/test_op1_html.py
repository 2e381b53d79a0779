import itertools

import numpy as np
import pytest

from palaver.llm import html_text
from palaver.llm.labelled_pages import labelled_pages

LONG = "Kalomi ter sanver ple, ron dis akum ost figra elnu. Verple ron dis ka lomi, ter san ver ple ron."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. <a href="#">Accept</a></p></div><!-- ad --><div class="ad">{LONG}</div>
<article><h1>Head &amp; line</h1><p>{LONG}<br>{LONG}<p>Second&nbsp; <b>bold</b>\n text &lt;3 caf&eacute;
<div class="advert">Buy now. {LONG}</div><p>{LONG}</p></article>
<aside class="sidebar"><h3>More</h3><ul><li><a href="/c">Three</a></ul></aside>
<form action="/s"><label>Search</label><input><select><option>A</select></form>
<section class="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div></section>
<footer>&copy; Site. {LONG}</footer></body></html>"""


def texts(*sources):
    return html_text.main_texts(list(sources), *html_text.train())


def test_article_without_everything_else():
    assert texts(PAGE) == [f"Head & line\n{LONG} {LONG}\nSecond bold text <3 café\n{LONG}"]


def test_held_out_labelled_pages():
    pages = [html_text.Page(source) for source in labelled_pages(150, seed=77)]
    forest = html_text.Forest(pages)
    labels = np.array([label for page in pages for label in html_text.truth(page)])
    found = forest.marginals(*html_text.train())[0] >= 0.5
    assert (found == labels).mean() > 0.97


@pytest.mark.xfail(strict=True, reason="open: mark-up without names or wrappers")
@pytest.mark.parametrize("source, text", [
    (f"  {LONG}\n{LONG}", f"{LONG} {LONG}"), ("plain text only " * 20, " ".join(["plain text only"] * 20)),
    (f"<p>{LONG}</p>", LONG), (f"<p>{LONG}<p>Short one.", f"{LONG}\nShort one."), (f"<body>{LONG}<br>{LONG}</body>", f"{LONG} {LONG}"),
    (f"""<html><body><div class=x1><a href=/a>One</a> <a href=/b>Two</a></div><div class=x2><p>{LONG}</p><p>{LONG}</p></div>
      <div class=x3><ul><li><a href=/c>Three</a><li><a href=/d>Four</a></ul></div></body></html>""", f"{LONG}\n{LONG}")])
def test_pages_without_names_or_wrappers(source, text):
    assert texts(source) == [text]


def test_marginals_equal_enumeration():
    chance = np.random.default_rng(1)
    page = html_text.Page("<div><p>a <b>b</b></p><ul><li>c<li>d</ul><h1>e</h1></div><p>f")
    forest = html_text.Forest([page])
    unary, pairs = chance.normal(size=html_text.FEATURES), chance.normal(size=(4, 2, 2))
    count = len(page.tags)
    score = np.bincount(forest.element, unary[forest.feature], count)
    total, ones = 0.0, np.zeros(count)
    for labels in itertools.product((0, 1), repeat=count):
        value = sum(score[n] for n in range(count) if labels[n])
        value += sum(pairs[forest.kind[n], labels[page.parents[n]], labels[n]] for n in range(1, count))
        total += np.exp(value)
        ones += np.exp(value) * np.array(labels)
    assert np.allclose(forest.marginals(unary, pairs)[0], ones / total)


@pytest.mark.parametrize("source", [
    "", "<", "<<<", "<p", "</p></div>", "<!--", "<script>", "&amp", "<a href='x", "<div " * 500, "<p>" * 3000, "\x00<p>\x00",
    "<div>" * 3000 + "deep", "<b><p></b></p>", '<a title="<b>">x</a>', "plain text only " * 20])
def test_odd_sources_do_not_fail(source):
    assert isinstance(texts(source)[0], str)


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, PAGE, "old", 9), (2, None, "old", 9), (2, None, "old", 9), (3, "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    found = sorted((row.page_id, row.text, row.n_chars) for row in html_text.extract_pages(pages).collect())
    assert found[1:] == [(2, "", 0), (2, "", 0), (3, "", 0)]
    assert found[0][1] == texts(PAGE)[0] and found[0][2] == len(found[0][1])
    assert html_text.extract_pages(pages.limit(0)).collect() == []
