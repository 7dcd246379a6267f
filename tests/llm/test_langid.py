"""Language identification: the fused posterior recomputed with plain numpy."""

import collections
import math
import re

import numpy as np
import pytest

from souk.llm.html_extract import fit, labelled_blocks, main_text
from souk.llm.langid import identify, train, trigrams

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tree(lspark):
    return fit(labelled_blocks(lspark))


def plain(pages, known, logp, tree, temper=4.0, strength=5.0):
    n, rows = len(known), []
    for url, page in pages:
        m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (url or "").lower())
        host = (m.group(1) if m else "").rstrip(".")
        dom, suf = ".".join(host.split(".")[-2:]), host.split(".")[-1]
        d = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", page or "", re.I | re.S)
        d = d.group(1).lower() if d else ""
        says = n + 1 if not d else known.index(d) if d in known else n
        ll = logp @ trigrams(main_text(page, tree)[0], logp.shape[1]) / temper
        flat = ll.max() == ll.min()
        rows.append((host, dom, suf, says, ll, None if flat else int(ll.argmax())))
    count = collections.Counter()
    for h, d, s, y, _, v in rows:
        if v is not None:
            for key in (("h", h, v), ("d", d, v), ("s", s, v), ("y", y, v), ("g", v)):
                count[key] += 1
    g = np.array([count["g", i] for i in range(n)], float)
    out = []
    for h, d, s, y, ll, v in rows:
        own = np.array([float(i == v) for i in range(n)])
        dv = np.array([count["d", d, i] for i in range(n)]) - own
        hv = np.array([count["h", h, i] for i in range(n)]) - own
        dp = (dv + strength * (g + 1) / (g.sum() + n)) / (dv.sum() + strength)
        hp = (hv + strength * dp) / (hv.sum() + strength)
        yl = [math.log((count["y", y, i] + 1) / (g[i] + n + 2)) for i in range(n)]
        sl = [math.log((count["s", s, i] + 1) / (g[i] + n)) for i in range(n)]
        sc = ll + np.log(hp) + yl + sl
        p = np.exp(sc - sc.max())
        out.append((known[int(sc.argmax())], p / p.sum()))
    return out


def test_against_plain_numpy(lspark, tree):
    docs = lspark.read.parquet(f"{SF}/documents.parquet")
    pages = lspark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = [(9001, None, None), (9002, "http://www.x.de/a", ""), (9003, "http://tiontion.example.net/q", None), (9004, "nonsense", "<html lang='xx'><p>12 34</p>"),
             (9005, "http://tiontion.example.net/q", "<html lang=fr><body><article><p>le la</p></article>"), (9006, "http://U@Www.X.DE:80", None)]
    pages = pages.unionByName(lspark.createDataFrame(extra, pages.schema)).repartition(5)
    known, logp = train(docs)
    assert known == ["de", "en", "es", "fr"]
    got = identify(pages, docs, tree).collect()
    want = plain([(r["url"], r["html"]) for r in got], known, logp, tree)
    assert len(got) == 250 + len(extra)
    for r, (lang, p) in zip(got, want):
        assert r["lang"] == lang
        assert np.allclose([r["posterior"][k] for k in known], p, atol=1e-9)
    shuffled = {r["page_id"]: r["lang"] for r in identify(pages, docs, tree, broadcast_rows=0).collect()}
    by = {r["page_id"]: r for r in got}
    assert shuffled == {i: r["lang"] for i, r in by.items()}
    assert by[9003]["text_lang"] is None and by[9006]["host"] == "www.x.de" and by[9002]["declared"] == ""


def test_training_counts_every_document(lspark):
    rows = [("aa", "abab abab"), ("bb", "xyxy zz"), ("aa", None), (None, "qq"), ("bb", ""), ("aa", "abab abab")]
    known, logp = train(lspark.createDataFrame(rows, "lang string, text string").repartition(4), buckets=64)
    assert known == ["aa", "bb"]
    for i, texts in enumerate((["abab abab"] * 2, ["xyxy zz", ""])):
        c = sum(trigrams(t, 64) for t in texts) + 0.5
        assert np.allclose(logp[i], np.log(c / c.sum()))


def test_given_pages_and_odd_tables(lspark, tree):
    docs = lspark.read.parquet(f"{SF}/documents.parquet")
    pages = lspark.read.parquet(f"{SF}/pages.parquet")
    rows = identify(pages, docs, tree).collect()
    right = sum(r["lang"] == re.search(r"//[^/]+/(\w\w)/", r["url"]).group(1) for r in rows)
    assert right >= 0.99 * len(rows)
    clash = pages.selectExpr("page_id", "url", "html", "1 as host", "'x' as text", "2 as vote", "3 as row")
    out = identify(clash, docs, tree)
    assert out.count() == 250 and out.first()["text"] == "x"
    assert identify(pages.limit(0), docs, tree).count() == 0
    none = identify(pages, docs.limit(0), tree).collect()
    assert {(r["lang"], r["confidence"]) for r in none} == {(None, 0.0)} and len(none) == 250
