"""Main text of web pages: flat text blocks classified by a decision tree.

Method.  A page is cut into flat text blocks (``html_blocks``).  Each block has
its word count and link density, those of the block before and the block after,
and what the surrounding elements say of it (inside an article or a content
container, inside page furniture such as menus, headers, footers, sidebars,
notices, adverts, forms or reader comments; a heading, a list item; whether the
page marks its main text at all).  A CART tree (Gini, ``max_depth``, ``min_leaf``) trained on a small
labelled table of blocks (``labelled_blocks``, built from page templates by
rule; or any table of the same columns) decides which blocks are main text.
The kept blocks are joined in page order.

Per page: one Arrow pass, the tree (a few dozen nodes) travels with the task.

Defined results: null/empty html -> empty text; no main block -> empty text;
character references are decoded after the markup is read, white space inside a
block becomes one space; unclosed elements end with their container, unclosed
comments with the page; repeated rows -> equal results; empty table -> empty;
input columns with the output names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, unpacked
from .html_blocks import NAMES, blocks, features

OUT = ("text", "n_chars", "n_blocks")


@dataclass
class Tree:
    """A binary tree over feature rows; leaves hold the share of main blocks."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def main(self, row: tuple) -> bool:
        t = self
        while t.feature >= 0:
            t = t.low if row[t.feature] <= t.threshold else t.high
        return t.share >= 0.5

    def lines(self, pad: str = "") -> list[str]:
        if self.feature < 0:
            return [f"{pad}main: {self.share:.3f}"]
        return [f"{pad}{NAMES[self.feature]} <= {self.threshold:g}", *self.low.lines(pad + "  "), f"{pad}else", *self.high.lines(pad + "  ")]


def grow(x: np.ndarray, y: np.ndarray, max_depth: int = 8, min_leaf: int = 4) -> Tree:
    """CART by Gini impurity; ties take the first feature and the lowest threshold."""
    node = Tree(float(y.mean()) if len(y) else 0.0)
    if max_depth == 0 or len(y) < 2 * min_leaf or y.min() == y.max():
        return node
    best = len(y) * 2 * node.share * (1 - node.share) - 1e-9
    pick = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, p = x[order, j], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= min_leaf) & (len(y) - k >= min_leaf)
        if not ok.any():
            continue
        a, b = p[:-1] / k, (p[-1] - p[:-1]) / (len(y) - k)
        cost = np.where(ok, 2 * k * a * (1 - a) + 2 * (len(y) - k) * b * (1 - b), np.inf)
        i = int(cost.argmin())
        if cost[i] < best:
            best, pick = cost[i], (j, float((v[i] + v[i + 1]) / 2))
    if pick is None:
        return node
    low = x[:, pick[0]] <= pick[1]
    node.feature, node.threshold = pick
    node.low, node.high = grow(x[low], y[low], max_depth - 1, min_leaf), grow(x[~low], y[~low], max_depth - 1, min_leaf)
    return node


def _sentence(k: int, stop: bool = True) -> str:
    return " ".join(f"w{j % 7}" for j in range(k)) + ("." if stop else "")


def _links(k: int) -> str:
    return "".join(f'<li><a href="/{j}">{_sentence(1 + j % 3, False)}</a></li>' for j in range(k))


#: Containers that hold the main text, page furniture that does not.
CONTAINERS = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div>{}</div>",
              '<div id="post-body">{}</div>', "<main><article>{}</article></main>", "<section>{}</section>", "<article>{}</article>")
BEFORE = ("<nav><ul>{links}</ul></nav>", "<header><p>{short}</p><ul>{links}</ul></header>", '<div class="menu"><ul>{links}</ul></div>',
          '<div class="cookie-notice"><p>{long}</p></div>', '<div class="ad">{short}</div>', "<ul>{links}</ul>",
          "<div>{short}</div>", '<p><a href="/">{short}</a> {one}</p>', "<table><tr><td>{short}</td><td>{one}</td></tr></table>")
INSIDE = ('<aside><p>{long}</p></aside>', '<div class="ad"><p>{short}</p></div>', '<form><p>{short}</p></form>', "",
          '<div class="share"><ul>{links}</ul></div>', "")
AFTER = ("<footer>{short}</footer>", '<div id="comments"><h3>{short}</h3><p>{long}</p><p>{short}</p></div>',
         '<aside class="sidebar"><h3>{short}</h3><ul>{links}</ul></aside>', "<form><p>{short}</p></form>",
         '<section class="related"><ul>{links}</ul></section>', "<footer><p>{long}</p></footer>",
         "<div>{short}</div>", "<p>{one}</p><ul>{links}</ul>", '<div>{short} <a href="/a">{short}</a></div>')


def labelled_pages() -> list[tuple[str, list[bool]]]:
    """Small pages made from the templates above with, per block, whether it is main text."""
    pages = []
    for i in range(144):
        body, marks = [], []

        def put(part: str, label: bool):
            part = part.format(links=_links(3 + i % 4), short=_sentence(2 + i % 5, i % 3 == 0), one=_sentence(1 + i % 2, False), long=_sentence(12 + 15 * (i % 7)))
            body.append(part)
            marks.extend([label] * len(blocks(part)))

        put(BEFORE[i % 9], False)
        put(BEFORE[(i // 3 + 1) % 9], False)
        outer, body = body, []
        if i % 3:  # a third of the pages begin with a paragraph
            put(f"<h1>{_sentence(2 + i % 11, i % 2 == 0)}</h1>", True)
        for j in range(3 + i % 5):  # paragraphs of every length, short ones among long ones
            k = (2, 45, 9, 80, 1, 25, 140)[(i + j) % 7] if j else 30 + i
            put(f"<p>{_sentence(k, (i + j) % 9 != 0)}</p>", True)
            if j == 1:
                put(INSIDE[(i // 6) % 6], False)
            if j == 2 and i % 4 == 0:
                put(f"<ul><li>{_sentence(6)}</li><li>{_sentence(11)}</li></ul>", True)
            if j == 2 and i % 5 == 0:
                put(f'<p>{_sentence(20)} <a href="/x">{_sentence(2, False)}</a> {_sentence(7)}</p>', True)
        outer.append(CONTAINERS[(i // 2) % 8].format("".join(body)))
        body = outer
        put(AFTER[(i + i // 9) % 9], False)
        put(AFTER[(i // 4 + 2) % 9], False)
        pages.append(("<html><body>" + "".join(body) + "</body></html>", marks))
    return pages


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """The labelled table: the features of every block of ``labelled_pages`` and ``main`` (0/1)."""
    rows = [(*f, float(m)) for page, marks in labelled_pages() for f, m in zip(features(blocks(page)), marks)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in (*NAMES, "main")))


def fit(labelled: DataFrame, max_blocks: int = 20000, **params) -> Tree:
    """The tree of at most ``max_blocks`` labelled blocks."""
    rows = labelled.select(*NAMES, "main").orderBy(F.xxhash64(*NAMES)).limit(max_blocks).collect()
    rows.sort()
    a = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(NAMES) + 1)
    return grow(a[:, :-1], a[:, -1], **params)


def main_text(page: str | None, tree: Tree) -> tuple[str, int]:
    """(main text, its number of blocks)."""
    if not page:
        return "", 0
    bs = blocks(page)
    keep = [b.text for b, row in zip(bs, features(bs)) if tree.main(row)]
    return " ".join(keep), len(keep)


def extract(pages: DataFrame, tree: Tree, html_col: str = "html") -> DataFrame:
    """Input rows plus text, n_chars and n_blocks."""

    @F.pandas_udf("text string, n_blocks long")
    def pick(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(p, tree) for p in col], columns=["text", "n_blocks"])

    d = packed(pages, F.col(f"`{html_col}`").alias("h"), drop=OUT)
    d = d.select("row", pick(F.col("h")).alias("x")).select("row", "x.text", F.length("x.text").cast("long").alias("n_chars"), "x.n_blocks")
    return unpacked(d, *OUT)
