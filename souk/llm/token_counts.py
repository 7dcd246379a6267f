"""Token counts without materialising ids: count pieces once per distinct pre-token.

Method.

1. One Arrow pass cuts every text into pre-tokens with the tokenizer's
   pre-tokenizer (``pretokens``; after cutting it at the vocabulary's special strings, one
   token each).  Per block of documents, a pre-token that many of them hold
   is written once as a string, and per document as its 64-bit hash; any other
   as a string of its document; each with its frequency in the document.
   Texts are read and cut once, and strings are hardly repeated.
2. The distinct pre-tokens of the corpus (one grouped aggregate) are split into
   pieces by the tokenizer's model once each.  Should two strings share a
   hash, the passes run again with another hash seed: exact, not likely.
3. The widespread pre-tokens (those that one in ``share`` documents holds, two
   documents at least; of them at most ``frequent``, 16 bytes each) are
   sent to the tasks, where documents add up their counts locally.  They are
   the hot join keys; all others are joined by shuffle and summed.  What is
   hot goes by the number of documents, so the joined rows grow with the input.
4. Documents are known by a 128-bit hash of their text, never by row numbers
   of the input (a shuffled input would number them anew in each branch).  Only
   the stored table of the first pass numbers its rows, written with them: short
   keys for the join.  All copies of a text have one total.

Output per input row: n_bytes (UTF-8), n_tokens, over_limit (> ``limit``).
Defined results: null/empty text -> 0 bytes, 0 tokens; repeated rows -> equal
results; empty table -> empty; input columns with the output names are
replaced.  ``vocab``: a byte-level ``.json`` of public tokenizers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, release_memory, scratch_path, stored, unpacked

OUT = ("n_bytes", "n_tokens", "over_limit")


def _text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text under different seeds."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _cut_pass(texts: DataFrame, vocab: str, seed: int, rows: int = 512, common: int = 8):
    """(k1, k2, text) -> rows of documents (k1, k2, d, special, hs, cs, rare, rc; ``d`` numbers them) and of pre-tokens (pt, seen).

    Per block of ``rows`` documents: pre-tokens that ``common`` or more of them hold are written once as a
    string (with the number of documents) and per document as a hash; others as strings of their documents.  ``hs`` are the hashes that ``xxhash64(lit, pt)`` gives: 64-bit xxHash seeded by ``seed``.
    """

    def run(batches):
        import xxhash

        from .pretokens import pretokens
        pre, d = pretokens(vocab), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                marks, counts, seen = [], [], Counter()
                for t in part.column(2).to_pylist():
                    pieces = pre.parts(t)
                    count: Counter = Counter()
                    for p in pieces[::2]:
                        count.update(pre.cut(p))
                    marks.append(len(pieces) // 2)
                    counts.append(count)
                    seen.update(count.keys())
                shared = {p: xxhash.xxh64_intdigest(p.encode(), seed) for p, k in seen.items() if k >= common}
                hs, cs, rare, rc = [], [], [], []
                for count in counts:
                    both = [p for p in count if p in shared]
                    hs.append(np.array([shared[p] for p in both], dtype=np.uint64).view(np.int64))
                    cs.append([count[p] for p in both])
                    alone = [p for p in count if p not in shared]
                    rare.append(alone)
                    rc.append([count[p] for p in alone])
                n, m = len(marks), len(shared)
                yield _batch(part.column(0), part.column(1), range(d, d + n), marks, hs, cs, rare, rc, [None] * n, [None] * n)
                d += n
                yield _batch(*[[None] * m] * 8, list(shared), [seen[p] for p in shared])
        release_memory()

    return texts.mapInArrow(run, "k1 long, k2 long, d long, special long, hs array<long>, cs array<int>, rare array<string>, rc array<int>, "
                                 "pt string, seen int")


_TYPES = {"k1": pa.int64(), "k2": pa.int64(), "d": pa.int64(), "special": pa.int64(), "hs": pa.list_(pa.int64()), "cs": pa.list_(pa.int32()),
          "rare": pa.list_(pa.string()), "rc": pa.list_(pa.int32()), "pt": pa.string(), "seen": pa.int32()}


def _batch(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _TYPES.values())],
                                      names=list(_TYPES))


def _pieces(strings: DataFrame, vocab: str) -> DataFrame:
    """(h, n, seen): pieces of each distinct pre-token."""

    def count(batches):
        from .pretokens import model_ids, pretokens
        pre = pretokens(vocab)
        for b in batches:
            n = [len(model_ids(pre.model, p)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2)], names=["h", "n", "seen"])

    return strings.select("h", "pt", "seen").mapInArrow(count, "h long, n long, seen long")


def token_counts(docs: DataFrame, text_col: str = "text", vocab: str = "byte_bpe_50k.json", limit: int = 1024,
                 frequent: int = 1 << 20, rows: int = 512, share: int = 1 << 15) -> DataFrame:
    """Input rows plus n_bytes, n_tokens and over_limit."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = packed(docs, *_text_key(text), F.octet_length(text).cast("long").alias("n_bytes"), drop=OUT)
    texts = docs.select(*_text_key(text), text.alias("t"))
    for trial in range(8):
        path = scratch_path(spark, "pretokens")
        seed = spark.range(1).select(F.xxhash64(F.lit(trial))).first()[0] % (1 << 64)
        _cut_pass(texts, vocab, seed, rows).write.option("compression", "zstd").parquet(path)
        first = spark.read.parquet(path)
        strings = (first.where("pt is not null").select("pt", "seen")
                   .unionByName(first.where("k1 is not null").select(F.explode("rare").alias("pt")).withColumn("seen", F.lit(1)))
                   .groupBy("pt").agg(F.sum("seen").alias("seen")).select("pt", "seen", F.xxhash64(F.lit(trial), "pt").alias("h")))
        pieces = stored(_pieces(strings, vocab), "pieces")
        if not pieces.groupBy("h").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("pre-tokens share a hash under every seed")
    per = first.where("k1 is not null").select("k1", "k2", "d", "special", "hs", "cs", "rare", "rc")
    top = pieces.where(F.col("seen") >= _widespread(pieces, max(2, -(-per.count() // share)), frequent)).select("h", "n").toArrow()
    hot, cost = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(hot)
    bc = spark.sparkContext.broadcast((hot[order], cost[order]))

    def split(batches):
        """Per document one row (its keys, h null, s: tokens of the special strings and the frequent pre-tokens) and one
        row per other pre-token (its hash h, s: its frequency); d: the document's number."""
        hot, cost = bc.value
        for b in (batch.slice(at, 512) for batch in batches for at in range(0, len(batch), 512)):
            h, c, doc = _flat(b, seed)
            hit, place = _find(hot, h)
            got = np.bincount(doc[hit], weights=c[hit] * cost[place[hit]], minlength=len(b)).astype(np.int64) if len(hot) else 0
            miss, (k1, k2, d, special) = ~hit, (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            n, m = len(b), int(miss.sum())
            of_doc, none = np.arange(n + m) < n, np.zeros(m, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate((k, none)), mask=~of_doc) for k in (k1, k2)),
                 pa.array(np.concatenate((d, d[doc[miss]]))),
                 pa.array(np.concatenate((np.zeros(n, dtype=np.int64), h[miss])), mask=of_doc),
                 pa.array(np.concatenate((special + got, c[miss])))], names=["k1", "k2", "d", "h", "s"])
        release_memory()

    # document rows join nothing; a key of their own spreads them over the partitions
    counted = per.mapInArrow(split, "k1 long, k2 long, d long, h long, s long").withColumn("h", F.coalesce("h", F.xxhash64("k1", "k2")))
    total = (counted.join(pieces.select("h", "n"), "h", "left").groupBy("d")
             .agg(F.max("k1").alias("k1"), F.max("k2").alias("k2"), F.expr("sum(CASE WHEN k1 IS NOT NULL THEN s ELSE s * n END)").alias("n_tokens"))
             .groupBy("k1", "k2").agg(F.max("n_tokens").alias("n_tokens")))  # copies of a text: equal totals
    out = whole.join(total, ["k1", "k2"]).withColumn("over_limit", F.col("n_tokens") > limit)
    return unpacked(out, *OUT)


def _widespread(pieces: DataFrame, least: int, most: int) -> int:
    """The smallest bound from ``least`` on that at most ``most`` pre-tokens reach, to a sixteenth of a power of two."""
    steps = (pieces.where(F.col("seen") >= least).groupBy(F.floor(F.log2("seen") * 16).alias("step"))
             .agg(F.count("*").alias("n"), F.min("seen").alias("seen")).orderBy(F.desc("step")).collect())  # some hundreds at most
    bound = (1 << 63) - 1
    for r in steps:
        most -= r["n"]
        if most < 0:
            break
        bound = r["seen"]
    return bound


def _flat(b: pa.RecordBatch, seed: int):
    """Hashes, counts and document numbers of a batch's pre-tokens, shared and rare ones."""
    import xxhash
    hs, rare = b.column(4), b.column(6)
    h = np.concatenate((hs.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                        np.array([xxhash.xxh64_intdigest(p.encode(), seed) for p in rare.flatten().to_pylist()], dtype=np.uint64).view(np.int64)))
    c = np.concatenate([b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 7)])
    doc = np.concatenate([np.repeat(np.arange(len(b)), np.diff(x.offsets.to_numpy())) for x in (hs, rare)])
    return h, c, doc


def _find(table: np.ndarray, h: np.ndarray):
    """(is in the sorted table, place)."""
    if not len(table):
        return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
    place = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[place] == h, place
