"""Each stage of the pipeline on its predecessor's rows, against an independent version."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from souk.llm.common import stored
from tests.llm.test_operators import W, brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(lspark):
    """[(name, input rows, output rows)] with every stage written and read again."""
    docs, out = lspark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        got = stored(f(lspark, docs, SF))
        out.append((name, docs, got))
        docs = got
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    for _, a, b in stages[:4]:
        assert a.columns == b.columns
    assert stages[4][2].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_keeps_good_and_drops_bad(lspark, stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    labels = {r["doc_id"]: r["quality"] for r in lspark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = before.collect()
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in rows}
    good = [r["doc_id"] for r in rows if labels.get(r["doc_id"]) == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    from souk.llm.quality import quality_scores
    want = {r["doc_id"] for r in quality_scores(before, lspark.read.parquet(f"{SF}/labels.parquet")).collect() if r["score"] >= 0.3}
    assert kept == want


def test_near_dedup_keeps_the_smallest_of_each_group(stages):
    _, before, after = stages[1]
    comp = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in comp.items() if i == c}


def test_decontaminate_drops_documents_with_passages(lspark, stages):
    _, before, after = stages[2]
    norm = lambda t: " " + " ".join(W(t)) + " "
    items = [norm(r["text"]) for r in lspark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shingles = {tuple(x.split()[i:i + 5]) for x in items for i in range(len(x.split()) - 4)}
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        t = norm(r["text"])
        if any(x in t for x in items):
            assert r["doc_id"] not in kept
        w = W(r["text"])
        if not any(tuple(w[i:i + 5]) in shingles for i in range(len(w) - 4)):
            assert r["doc_id"] in kept  # clean documents stay


def test_mix_passes_on_what_it_takes(stages):
    from souk.llm.mixing import mix
    _, before, after = stages[3]
    taken = {r["doc_id"]: r["taken"] for r in mix(before).collect()}
    got = after.collect()
    assert {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in got} == {i: n for i, n in taken.items() if n}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_tokens_are_the_librarys(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    _, before, after = stages[4]
    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in after.collect()}
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        x = got.pop(r["doc_id"])
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_empty_documents(lspark):
    docs = lspark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        docs = f(lspark, docs, SF)
        assert docs.count() == 0
