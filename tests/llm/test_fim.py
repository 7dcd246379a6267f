"""Fill-in-middle against a plain Python version."""

import hashlib
import re

from souk.llm.fim import fill_in_middle, restored
from pyspark.sql import functions as F


def plain(doc_id, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "word", "two words", "line\nbreak\r\n\ttab", "é😀ü x𝔘y", "<P> inside", "ends with <", "> starts", "$1 \\2 {x}",
         "a<S", "<<<", "S>P>M>", "one two three four five six. " * 7, "x " * 200000, "é" * 50000, "a" * 100000]


def test_against_plain_python(lspark):
    rows = [(i, TEXTS[i % len(TEXTS)], "x", 3) for i in range(40 * len(TEXTS)) if i < 400 or len(TEXTS[i % len(TEXTS)] or "") < 1000]
    rows += [(None, "null id text", "x", 3), (5, "again", "x", 3), (5, "again", "x", 3)]
    df = lspark.createDataFrame(rows, "doc_id long, text string, form string, h1 int")
    got = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"} and got[0]["h1"] == 3


def test_empty_table_and_plan(lspark):
    df = lspark.createDataFrame([], "doc_id long, text string")
    out = fill_in_middle(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
