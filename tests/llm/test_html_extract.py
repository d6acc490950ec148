"""Main text of pages: parsing, decoding, held-out layouts, and the tables' own pages."""

from __future__ import annotations

import html
import itertools
import os
import random
import re

import numpy as np
import pytest

from tallyloom.llm import html_extract as h

FOLDER = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:1}</style></head><body>
<!-- a > b <p>no</p> --><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie">We use cookies, of course.</div><article class="post"><h1>A  heading &lt;here&gt;</h1>
<p>First   paragraph, with an <b>unclosed bold.<br><p>Second one&nbsp;&mdash; it says more &copy; things, and ends.
<ul><li>item one of the list<li>item two of the list</ul><script>var a = "</p><p>no";</script>
<blockquote>Quoted words, kept in the text.</blockquote></article>
<section id="comments"><div class="comment"><p>Nice article, thanks a lot!</p></div></section>
<form class="search"><label>Find</label><input></form><footer>&copy; someone, 2020</footer></body></html>"""


@pytest.fixture(scope="module")
def trees():
    texts = [f"Paragraph {i} tells of things, and of {i * 7} more; it ends here." for i in range(200)]
    layouts = h._Layouts(random.Random(1), texts)
    pages = [f"<html><body>{layouts.part('menu')}<article><h1>{t[:20]}</h1><p>{t}</p><p>{u}</p></article>{layouts.part('footer')}</body></html>" for t, u in zip(texts, texts[1:])]
    return h.fit_trees(pages[:120], h.FitPages(trees=40))


def test_parser_closes_what_pages_leave_open():
    page = h.Page(PAGE)
    runs = [(page.tags[n], text) for n, text, _ in page.runs]
    assert ("h1", "A heading <here>") in runs and ("p", "First paragraph, with an unclosed bold.") in runs
    assert ("p", "Second one — it says more © things, and ends.") in runs
    assert [t for tag, t in runs if tag == "li"] == ["Menu one", "Menu two", "item one of the list", "item two of the list"]
    assert not any("no" == t or "var" in t or "T & t" in t for _, t in runs)
    assert all(page.parents[i] < i for i in range(1, len(page.tags))) and page.ends[0] == len(page.tags)


@pytest.mark.parametrize("source", [None, "", "plain words", "<p", "<<<>>>", "<!-- open", "<script>x", "</div></p>", '<a href="x>y</a>', "<b><i>" * 300 + "x", "<div>" * 600 + "deep", "a < b & c &amp &bogus; &#65;"])
def test_broken_pages_do_not_crash(source, trees):
    (text,) = h.main_texts([source], trees)
    assert isinstance(text, str)


def test_main_text(trees):
    (text,) = h.main_texts([PAGE], trees)
    assert text.split("\n") == [
        "A heading <here>",
        "First paragraph, with an unclosed bold.",
        "Second one — it says more © things, and ends.",
        "item one of the list",
        "item two of the list",
        "Quoted words, kept in the text.",
    ]


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = np.random.default_rng(3)
    page = h.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><div><p>d</p></div>")
    n = len(page.tags)
    for _ in range(50):
        logits = rng.normal(0, 2, n)
        best = max(
            (labels for labels in itertools.product([False, True], repeat=n) if labels[0] and all(labels[page.parents[i]] or not labels[i] for i in range(1, n))),
            key=lambda labels: sum(-np.logaddexp(0, -z) if k else -np.logaddexp(0, z) for k, z in zip(labels[1:], logits[1:])),
        )
        assert h.decode(page, logits).tolist() == list(best)


def test_held_out_layouts(trees):
    rng = random.Random(99)
    layouts = h._Layouts(rng, [f"Other words {i}, said of {i * 3} matters; so it goes." for i in range(300)])
    right = kept = wanted = 0
    for _ in range(120):
        page = h.Page(layouts.page([layouts.words(4, 9) for _ in range(rng.randint(1, 6))]))
        truth = h._true_labels(page, marked=True)
        labels = h.decode(page, trees.logits(h.features(page, trees.odds)))
        for node, text, _ in page.runs:
            right += len(text) * (truth[node] and labels[node])
            kept += len(text) * labels[node]
            wanted += len(text) * truth[node]
    assert right / wanted > 0.95 and right / kept > 0.95


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = h.boost(x, y, h.FitPages(trees=30, depth=3), {})
    assert ((trees.logits(x) > 0) == y).mean() > 0.97


def test_pages_table(spark, trees):
    rows = [(1, "u", PAGE, "old"), (2, "u", None, None), (2, "u", "", None), (None, None, "<article><p>Only words, here.</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = h.page_texts(pages, trees)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert [(i, n) for i, t, n in got if i == 2] == [(2, 0), (2, 0)] and all(len(t) == n for _, t, n in got)
    assert h.page_texts(pages.limit(0), trees).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    out = h.page_texts(pages, h.fit_pages(pages, h.FitPages(trees=40))).collect()
    right = 0
    for r in out:
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", article)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in parts]
        right += r.text == "\n".join(b for b in blocks if b)
    assert right >= 0.95 * len(out)
