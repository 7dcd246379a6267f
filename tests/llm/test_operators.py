"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns; each operator against a brute-force version."""

import re
import zlib

import numpy as np
import pytest

TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def W(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(TR)) if x]


def shingles(t):
    w = W(t)
    if not w:
        return frozenset()
    return frozenset([" ".join(w)]) if len(w) < 5 else frozenset(" ".join(w[i:i + 5]) for i in range(len(w) - 4))


BASE = " ".join(f"w{i}" for i in range(40))
NEAR = BASE.replace("w20", "X20")
FAR = " ".join(f"v{i}" for i in range(40))
DOCS = [(1, BASE, "a"), (2, BASE, "a"), (3, NEAR, "b"), (4, FAR, None), (5, None, "a"), (6, "", "b"),
        (7, "Short Text", "a"), (8, "short text", "c"), (None, BASE, "a"), (9, " ".join(["long"] * 20000), "c"),
        (1, BASE, "a")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("kept", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))


def brute_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    S = {}
    for i, t in rows:
        if i is not None:
            S[i] = shingles(t)
    par = {i: i for i in ids}

    def f(x):
        while par[x] != x:
            x = par[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and S[a] and S[b]:
                i = len(S[a] & S[b])
                if 100 * i >= 75 * (len(S[a]) + len(S[b]) - i):
                    par[max(f(a), f(b))] = min(f(a), f(b))
    return {i: f(i) for i in ids}


def test_near_duplicates_match_brute_force(lspark):
    from souk.llm.dedup import near_duplicates
    out = near_duplicates(docs(lspark)).collect()
    assert len(out) == len(DOCS)
    exp = brute_components([(r[0], r[1]) for r in DOCS])
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False
        else:
            assert r.component_id == exp[r.doc_id]
            assert r.kept == (r.doc_id == exp[r.doc_id])
            assert r.n_shingles == len(shingles(r.text))
    assert {r.doc_id: r.component_id for r in out if r.doc_id}[7] == 7 and exp[8] == 7  # A-Z folded


def test_near_duplicates_template_group_with_outsiders_at_the_ends(lspark):
    from souk.llm.dedup import near_duplicates
    tpl = " ".join(f"t{i}" for i in range(76))  # 72 shingles that every document holds
    rows = [(i, tpl + " " + " ".join(f"o{i}x{j}" for j in range(40))) for i in (1, 2, 998, 999)]
    for k in range(16):  # pairs at 76/100, other pairs at most 72/104
        both = " ".join(f"c{k}x{j}" for j in range(4))
        rows += [(100 + 2 * k + e, tpl + " " + both + " " + " ".join(f"p{k}x{e}x{j}" for j in range(12))) for e in (0, 1)]
    exp = brute_components(rows)
    assert sum(exp[100 + 2 * k + 1] == 100 + 2 * k for k in range(16)) == 16 and len(set(exp.values())) == 20
    out = near_duplicates(lspark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == exp


def test_near_duplicates_empty_table(lspark):
    from souk.llm.dedup import near_duplicates
    assert near_duplicates(docs(lspark).limit(0)).count() == 0


def test_decontaminate_finds_planted_passage(lspark):
    from souk.llm.decontam import decontaminate
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, "pre " * 30 + item + " post" * 30), (2, FAR), (3, None), (4, ""), (None, item), (1, "pre " * 30 + item)]
    d = lspark.createDataFrame(rows, "doc_id long, text string").withColumn("similarity", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    items = lspark.createDataFrame([(10, item), (11, None), (12, FAR.upper())], "item_id long, text string")
    got = {(r.doc_id, r.text): (r.contaminated, list(r.item_ids)) for r in decontaminate(d, items).collect()}
    assert got[(1, rows[0][1])] == (True, [10])
    assert got[(2, FAR)] == (True, [12])
    assert got[(3, None)] == (False, []) and got[(4, "")] == (False, [])
    assert got[(None, item)] == (False, [])
    empty = lspark.createDataFrame([], "item_id long, text string")
    assert decontaminate(d, empty).where("contaminated").count() == 0


def test_water_fill_and_mix(lspark):
    from souk.llm.mixing import mix, water_fill
    t = water_fill([10, 10, 100], [5, 2, 1], 3.0)
    assert abs(sum(t) - 120) < 1e-9 and t[0] == 30 and t[1] <= 30
    d = docs(lspark)
    a = sorted(mix(d, block=8, min_slots=1, shard_blocks=4).select("doc_id", "size", "taken", "target").collect(), key=str)
    b = sorted(mix(d, block=8, min_slots=1, shard_blocks=4).select("doc_id", "size", "taken", "target").collect(), key=str)
    assert a == b
    for r in a:
        assert r.taken <= 3 * r.size
        if r.doc_id is None:
            assert r.taken == 0
    assert mix(d.limit(0)).count() == 0


def test_mix_keeps_every_row_of_a_null_source(lspark):
    from souk.llm.mixing import mix
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7)), (None, "a", "b")[i % 3]) for i in range(60)]
    rows += [(None, "no id", None), (3, "again 3", None)]
    out = mix(lspark.createDataFrame(rows, "doc_id long, text string, source string"), block=8, min_slots=1, shard_blocks=4).collect()
    assert sorted((str(r.doc_id), r.text, str(r.source)) for r in out) == sorted((str(i), t, str(s)) for i, t, s in rows)
    null = [r for r in out if r.source is None and r.doc_id is not None]
    assert {r.source_size for r in null} == {sum(r.size for r in null)} and sum(r.taken for r in null) > 0


def test_mixed_rows_are_the_mix(lspark):
    from collections import Counter

    from souk.llm.mixing import mix, mixed, mixed_documents
    rows = [(i, "  " * (i % 2) + " \n".join(f"d{i}x{j}" for j in range(i % 23)) + " " * (i % 3), ("a", "b", None, "c")[min(i % 7, 3)]) for i in range(120)]
    d = lspark.createDataFrame(rows, "doc_id long, text string, source string")
    kw = dict(block=8, min_slots=1, shard_blocks=16)
    out = mixed(d, **kw).collect()
    assert sorted(out) == sorted(mixed(d, **kw).collect())
    taken = {r.doc_id: r.taken for r in mix(d, **kw).collect()}
    words = Counter()
    for r in out:
        words[r.doc_id] += len(W(r.text))
    assert words == Counter({i: n for i, n in taken.items() if n}) and max(words[i] / max(len(W(t)), 1) for i, t, _ in rows) > 1
    per = Counter()
    for r in out:
        per[r.shard, r.slot] += len(W(r.text))
        assert r.text in rows[r.doc_id][1]
    assert max(per.values()) <= 8 and all(0 <= s < 16 for _, s in per)
    once = {r.doc_id: set() for r in out}
    for r in out:
        once[r.doc_id].add(r.text)
    assert any("".join(sorted(v, key=rows[i][1].index)) == rows[i][1] and len(v) > 1 for i, v in once.items())
    joined = mixed_documents(d, **kw).collect()
    assert {r.doc_id: len(W(r.text)) for r in joined} == dict(words) and len(joined) == len(words)
    assert any(r.text == rows[r.doc_id][1] + "\n" + rows[r.doc_id][1] for r in joined)


def test_pipeline_mix_stage_passes_on_the_mix(lspark):
    import corpus_pipeline as P
    from souk.llm.mixing import mix
    d = lspark.read.parquet(f"{SF}/documents.parquet")
    out = P.mixing(lspark, d, SF)
    assert out.columns == d.columns
    taken = {r.doc_id: r.taken for r in mix(d).where("taken > 0").collect()}
    got = out.collect()
    assert {r.doc_id: len(W(r.text)) for r in got} == taken and all(r.n_chars == len(r.text) for r in got)


def test_repair_round_trip():
    from souk.llm.tokens import expand, repair
    rng = np.random.default_rng(1)
    for _ in range(20):
        docs_ = [np.append(rng.integers(1, 6, rng.integers(0, 200)), 0) for _ in range(rng.integers(1, 8))]
        seq = np.concatenate(docs_).astype(np.int64)
        c, rules, explen = repair(seq, 10, 0, min_count=2)
        assert np.array_equal(expand(c, rules.astype(np.int64), 10), seq)
        assert len(explen) == len(rules)


def test_token_shards_and_counts(lspark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from souk.llm.token_counts import token_counts
    from souk.llm.tokens import token_shards
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(3, "héllo  world  x<|endoftext|>y"), (1, None), (2, ""), (5, "Zürich 12 345 !!"), (4, "a" * 5000)]
    d = lspark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    exp, start = {}, 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        exp[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards(d, shard_bytes=40).collect()}
    assert got == exp
    cnt = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts(d).collect()}
    for i, t in rows:
        assert cnt[i] == (len(tok.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))


def test_token_shards_keep_texts_that_hold_the_end_id(lspark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from souk.llm.tokens import token_shards
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert 0 in tok.encode("hello! world.").ids
    rows = [(i, "hello! world. " * (i % 4) + f"Stop! {i}") for i in range(30)] + [(30, "!"), (31, "no mark"), (32, None)]
    rows += [(33, "Same! row"), (33, "Same! row")] + [(None, f"Null! id {i}") for i in range(6)]
    d = lspark.createDataFrame(rows, "doc_id long, text string")
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")) for i, t in rows]
    for per in (20, 100, 4000):
        got = sorted(token_shards(d, shard_bytes=per).collect(), key=lambda r: r.start)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in ids)
        assert [r.doc_id for r in got] == [i for i, _ in rows]  # null ids last
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_exact_topk_matches_brute_force(lspark):
    from souk.llm.topk import exact_topk
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 4)]) for i in range(1, 90)]
    rows += [(90, rows[0][1]), (91, rows[0][1]), (92, None), (93, [1.0, None, 0.0, 0.0]), (94, [float("nan"), 0.0, 0.0, 0.0]), (100, rows[5][1])]
    d = lspark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in exact_topk(d, k=5, query_every=20, qblock=2, cblock=7).orderBy("query_id", "rank").collect()]
    valid = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    exp = []
    for q in sorted(i for i in valid if i % 20 == 0):
        s = sorted(((-int(valid[q] @ valid[c]), c) for c in valid if c != q))[:5]
        exp += [(q, r + 1, c, -ns) for r, (ns, c) in enumerate(s)]
    assert got == exp


def test_quality_scores_defined(lspark):
    from souk.llm.quality import quality_scores
    from pyspark.sql import functions as F
    d = lspark.read.parquet(f"{SF}/documents.parquet").unionByName(
        lspark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    lab = lspark.read.parquet(f"{SF}/labels.parquet")
    out = quality_scores(d.withColumn("score", F.lit("x")), lab).collect()
    assert len(out) == d.count()
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    e = [r.score for r in out if r.doc_id >= 10**9]
    assert e[0] == e[1]  # null and empty text: both the training prior


def test_pipeline_stages(lspark):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    r = P.run(lspark, SF)
    assert r.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert 0 < r.count() <= lspark.read.parquet(f"{SF}/documents.parquet").count()
