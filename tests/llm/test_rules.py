"""Decision lists: base statistics by brute force, learning on made rows, held-out labels."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from souk.llm.rules import Condition, RuleList, count_text, features, fit, learn, quality_rules, with_statistics

SF = "/root/testdata/sf0.01"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    rep = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep))


TEXTS = [None, "", " \n\t", "a b c d e", "a a a a a a", "x y z w v x y z w v", "# * $ % & | < >", "é😀 ü x \x0b y\x0c",
         "l1\nl1\n\nl1\n l1\nl2", "one two three four five six seven eight nine ten eleven", "a b a b a b a b a b a b q"]


def test_counts_against_brute_force():
    rnd = random.Random(4)
    some = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))).replace("b", "b\n") for _ in range(300)]
    for t in TEXTS + some:
        assert count_text(t)[:5] == brute(t), t


def test_query_columns(lspark):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "t " * 30, 1, 2), (3, TEXTS[4], 1, 2), (99, "word " * 100000 + "end", 1, 2)]
    df = lspark.createDataFrame(rows, "doc_id long, text string, c int, s int")
    out = quality_rules(df, RuleList()).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] != 99:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed) and r["c"] == 1
    assert {r["n_repeat_words"] for r in out if r["doc_id"] == 99} == {100000}
    assert quality_rules(df.limit(0), RuleList()).count() == 0


def test_learns_planted_conjunctions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.93)
    rl = learn(x, y, list("abcd"))
    z = rng.random((3000, 4))
    want = ((z[:, 0] > 0.8) & (z[:, 1] <= 0.5)) | (z[:, 2] > 0.93)
    assert (rl.covers(z, list("abcd")) == want).mean() > 0.98
    assert all(c.feature != "d" for r in rl.rules for c in r) and rl.lines()[0].startswith("if ")
    noise = rng.random(3000) < 0.2
    assert learn(x, noise, list("abcd")).covers(z, list("abcd")).mean() < 0.05  # nothing to learn: nothing caught
    assert learn(x[:0], y[:0], list("abcd")).rules == [] and learn(x, y & False, list("abcd")).rules == []


def test_expression_equals_the_list(lspark):
    docs, names = lspark.read.parquet(f"{SF}/documents.parquet"), list(features())
    rl = RuleList([[Condition("distinct_share", False, 0.5), Condition("n_words", True, 50.0)], [Condition("symbols_per_word", True, 0.1)]])
    rows = with_statistics(docs, "text").withColumn("v", rl.verdict({k: F.col(f"s.{k}") for k in names})).select("s", "v").collect()
    x = np.array([[r["s"][k] for k in names] for r in rows])
    assert rl.covers(x, names).tolist() == [r["v"] for r in rows]


def test_held_out_labels(lspark):
    docs, labels = (lspark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rl = fit(docs, labels)
    assert rl.rules and fit(docs.repartition(5), labels).lines() == rl.lines()
    rows = quality_rules(docs, rl).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    assert sum(r["kept"] == bool(r["quality"]) for r in held) >= 0.95 * len(held)
    assert fit(docs, labels.limit(0)).rules == [] and fit(docs.limit(0), labels).rules == []
    both = labels.limit(5).unionByName(labels.limit(5).withColumn("quality", F.lit(0)))
    assert isinstance(fit(docs, both), RuleList)
