"""HTML extraction: known pages, the given pages' articles, odd markup."""

import html
import re

import pytest

from souk.llm.html_blocks import blocks, features, NAMES
from souk.llm.html_extract import extract, fit, grow, labelled_blocks, labelled_pages, main_text


@pytest.fixture(scope="module")
def tree(lspark):
    return fit(labelled_blocks(lspark))


LONG = "It was a long paragraph of the main text, with far more words than any menu entry has, and it goes on for a while. " * 2


def test_tree_fits_its_table(lspark, tree):
    rows = labelled_blocks(lspark).collect()
    hits = sum(tree.main(tuple(r)[:-1]) == bool(r["main"]) for r in rows)
    assert hits >= 0.97 * len(rows) and 500 < len(rows) < 5000
    assert {NAMES.index(k) for k in ("words", "in_main", "in_furniture")} <= splits(tree)


def splits(t):
    return set() if t.feature < 0 else {t.feature} | splits(t.low) | splits(t.high)


def test_held_out_templates():
    import numpy as np
    pages = labelled_pages()
    x = [[f for p, _ in pages[k::2] for f in features(blocks(p))] for k in (0, 1)]
    y = [[m for _, ms in pages[k::2] for m in ms] for k in (0, 1)]
    t = grow(np.array(x[0], float), np.array(y[0], float))
    assert sum(t.main(r) == m for r, m in zip(x[1], y[1])) >= 0.95 * len(y[1])


@pytest.mark.parametrize("furniture", [
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", f"<header><p>{LONG}</p></header>", f"<footer>{LONG}</footer>",
    f"<aside><p>{LONG}</p></aside>", f'<div class="sidebar"><p>{LONG}</p></div>', f'<div id="cookieNotice"><p>{LONG}</p></div>',
    f'<div class="advert">{LONG}</div>', f"<form><p>{LONG}</p><input value='x'><textarea>{LONG}</textarea></form>",
    f"<script>var a = '<p>{LONG}</p>';</script>", f"<style>p {{}} /* {LONG} */</style>", f"<!-- <p>{LONG}</p> -->",
    f'<section id="comments"><article class="comment"><p>{LONG}</p></article></section>', f'<div role="alert"><p>{LONG}</p></div>',
    f'<div hidden><p>{LONG}</p></div>', f'<div style="display:none"><p>{LONG}</p></div>', f"<template><p>{LONG}</p></template>"])
@pytest.mark.parametrize("place", ["before", "inside", "after"])
def test_furniture_goes(tree, furniture, place):
    p1, p2 = "<p>First paragraph, a short one.</p>", f"<p>{LONG}</p><p>End.</p>"
    inner = f"<h1>The Title</h1>{p1}{furniture if place == 'inside' else ''}{p2}"
    page = (f"<html><head><title>T</title></head><body>{furniture if place == 'before' else ''}<article>{inner}</article>"
            f"{furniture if place == 'after' else ''}</body></html>")
    assert main_text(page, tree)[0] == f"The Title First paragraph, a short one. {LONG.strip()} End."


def test_markup_details(tree):
    page = ("<article><h1>A&amp;B &lt;c&gt; &eacute;&#233;&#xe9;</h1><p>one<br>two <b>bo</b>ld\n\t  three<p>unclosed <i>four"
            "<ul><li>five<li>six</ul><p title='a>b'>seven</p></article><footer>x")
    assert main_text(page, tree)[0] == "A&B <c> ééé one two bold three unclosed four five six seven"
    assert main_text(None, tree) == ("", 0) and main_text("", tree) == ("", 0)
    assert main_text("<!-- never closed <article><p>x</p></article>", tree)[0] == ""
    assert main_text("<article><p>" + "w " * 200000 + "</p></article>", tree)[0] == ("w " * 200000).strip()


def test_no_marked_main_text(tree):
    page = f"<body><ul><li><a href=/>a</a></li><li><a href=/>b</a></li></ul><div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href=/>c</a></li></ul></body>"
    assert main_text(page, tree)[0] == f"{LONG.strip()} {LONG.strip()}"


def expected(page):
    if not page:
        return ""
    a = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    a = re.sub(r"</?b>", "", re.sub(r"<br\s*/?>", " ", a))
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", a)).split())


def test_given_pages_and_edges(lspark, tree):
    pages = lspark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extract(pages, tree).collect()
    want = {r["page_id"]: expected(r["html"]) for r in pages.collect()}
    assert len(rows) == len(want)
    for r in rows:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    odd = lspark.createDataFrame([(1, None, None, "x", 1), (2, "u", "", "x", 1), (2, "u", "", "x", 1)],
                                 "page_id long, url string, html string, text string, row int")
    out = extract(odd, tree)
    assert [(r["text"], r["n_chars"], r["row"]) for r in out.collect()] == [("", 0, 1)] * 3
    assert extract(odd.limit(0), tree).count() == 0
