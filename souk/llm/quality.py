"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Method.  A text is a hashed bag of terms (``n_features`` buckets, sublinear
term frequency): its words, the shapes of its unusual words (all capitals,
symbols, digits) and a mark for each word that repeats the one before it.
Document frequencies over **all** documents come from one Arrow pass with a
count vector per task and a grouped sum (at most ``n_features`` rows).  The
latent space is fitted on a bounded, documented sample of labelled training rows
(at most ``max_train``, the smallest hashes of their ids, half of them of each
label as far as they go): TF-IDF rows, L2-normalised, reduced by a randomized
SVD to ``rank`` dimensions on the driver.  The projection, the IDF vector and
the labelled vectors (``max_train x rank`` floats) are broadcast; every document
is scored in blocks of ``block`` rows by exact cosine products with all labelled
vectors; the ``k`` most similar vote with weight ``max(cosine, 0)``.  Nothing but
the text column goes through Python, and no feature is stored.

Training rows are those with a label whose ``crc32(id as text) % 5 != 0``;
labels, language, source and ids never enter a score: equal texts get equal
scores whatever their ids.

Defined results: null/empty text -> zero vector -> the mean label of the training rows;
null id -> held_out false, scored like any row; repeated rows -> equal scores;
several labels for one id -> the smallest; no training rows -> every score is 0.5;
empty table -> empty; ids of any type.  Input columns named ``held_out``,
``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, release_memory, unpacked

OUT = ("held_out", "score", "predicted")
_ODD = re.compile(r"[^\w.,;:'()\"-]|\d|_")


def word_terms(w: str) -> list[str]:
    """A word's terms: itself and the shapes it has."""
    out = [w.lower()]
    if len(w) > 1 and w.upper() == w and w.lower() != w:
        out.append("\0capitals")
    m = _ODD.search(w)
    if m:
        out.append("\0digit" if m.group().isdigit() else "\0" + m.group())
    return out


class Buckets:
    """Bucket counts of a text's terms; remembers the buckets of up to ``keep`` words."""

    def __init__(self, n: int, keep: int = 50_000):
        self.n, self.keep, self.known = n, keep, {}

    def _of(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) % self.n

    def __call__(self, text: str | None) -> dict[int, int]:
        words = (text or "").split()
        out: dict[int, int] = {}
        if len(self.known) > self.keep:
            self.known.clear()
        for w, c in Counter(words).items():
            bs = self.known.get(w)
            if bs is None:
                bs = self.known[w] = [self._of(t) for t in word_terms(w)]
            for b in bs:
                out[b] = out.get(b, 0) + c
        again = sum(map(eq, words, islice(words, 1, None)))
        if again:
            b = self._of("\0again")
            out[b] = out.get(b, 0) + again
        return out


def _dense(bags: list, idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(bags), idf.shape[0]), dtype=np.float32)
    for r, bag in enumerate(bags):
        for b, c in bag.items():
            x[r, b] = 1.0 + math.log(c)
    x *= idf
    nrm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(nrm > 0, nrm, 1.0)


def _unit(z: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return z / np.where(n > 1e-12, n, 1.0)


def document_frequencies(docs: DataFrame, text_col: str, n_features: int) -> tuple[int, np.ndarray]:
    """(documents, documents per bucket) over the whole table."""

    def count(batches):
        df, n, buckets = np.zeros(n_features, dtype=np.int64), 0, Buckets(n_features)
        for pdf in batches:
            for t in pdf["t"]:
                n += 1
                for b in buckets(t):
                    df[b] += 1
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"b": np.append(hit, -1), "c": np.append(df[hit], n)})
        del df, buckets
        release_memory()

    rows = (docs.select(F.col(f"`{text_col}`").alias("t")).mapInPandas(count, "b long, c long")
            .groupBy("b").agg(F.sum("c").alias("c")).collect())  # at most n_features + 1 rows
    df, n = np.zeros(n_features), 0
    for r in rows:
        if r["b"] < 0:
            n = r["c"]
        else:
            df[r["b"]] = r["c"]
    return n, df


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> list:
    """(text, label) of at most ``max_train`` labelled rows outside the held-out fold."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("id").cast("string")) % 5 != 0))
           .groupBy("id").agg(F.min("y").alias("y")))
    half = [lab.where(c).orderBy(F.xxhash64("id"), "id").limit(max_train) for c in (F.col("y") == 0, F.col("y") != 0)]
    sizes = [h.count() for h in half]
    few = min(sizes)
    take = [min(s, max_train - min(few, max_train // 2)) if s > few else min(s, max_train // 2) for s in sizes]
    lab = half[0].limit(take[0]).unionByName(half[1].orderBy(F.xxhash64("id"), "id").limit(take[1]))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    rows = text.join(F.broadcast(lab), "id").groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).collect()
    return sorted((r["t"], int(r["y"] != 0)) for r in rows)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", n_features: int = 4096, rank: int = 64,
                   max_train: int = 6000, k: int = 25, threshold: float = 0.3, block: int = 128,
                   seed: int = 17) -> DataFrame:
    """Input rows plus held_out, score (0..1) and predicted (score >= threshold)."""
    n_docs, df = document_frequencies(docs, text_col, n_features)
    idf = (np.log((n_docs + 1.0) / (df + 1.0)) + 1.0).astype(np.float32)
    train = training_rows(docs, labels, id_col, text_col, label_col, max_train)
    ty = np.array([y for _, y in train], dtype=np.float32)
    prior = float(ty.mean()) if len(ty) else 0.5
    if len(train):
        buckets = Buckets(n_features)
        bags = [buckets(t) for t, _ in train]
        parts = [slice(i, i + block) for i in range(0, len(bags), block)]  # the dense matrix is never held whole
        r_ = min(rank, len(bags), n_features)
        toss = np.random.default_rng(seed).standard_normal((n_features, r_ + 16)).astype(np.float32)
        q, _ = np.linalg.qr(np.concatenate([_dense(bags[p], idf) @ toss for p in parts]))
        small = sum(q[p].T @ _dense(bags[p], idf) for p in parts)
        _, _, vt = np.linalg.svd(small, full_matrices=False)
        proj = vt[:r_].T.astype(np.float32)  # n_features x rank
        zt = _unit(np.concatenate([_dense(bags[p], idf) @ proj for p in parts])).astype(np.float32)
    else:
        proj, zt = np.zeros((n_features, 1), np.float32), np.zeros((0, 1), np.float32)
    bc = docs.sparkSession.sparkContext.broadcast((idf, proj, zt, ty, prior))
    train = bags = buckets = toss = q = small = vt = None
    release_memory()  # the driver keeps the model only

    def votes(texts: pd.Series) -> pd.Series:
        idf_, proj_, zt_, ty_, prior_ = bc.value
        out, buckets = np.full(len(texts), prior_, dtype=np.float64), Buckets(n_features)
        for s in range(0, len(texts), block):
            z = _unit(_dense([buckets(t) for t in texts.iloc[s:s + block]], idf_) @ proj_)
            if not len(ty_):
                continue
            sim = np.maximum(np.round((z @ zt_.T).astype(np.float32), 5), np.float32(0.0))  # rounded: block shapes do not decide ties
            kth = np.partition(sim, -min(k, sim.shape[1]), axis=1)[:, -min(k, sim.shape[1])]
            w = np.where(sim >= kth[:, None], sim, 0.0)  # all that tie with the k-th vote
            tot = w.sum(axis=1)
            out[s:s + block] = np.where(tot > 0, (w @ ty_) / np.where(tot > 0, tot, 1.0), prior_)
        del buckets
        release_memory()
        return pd.Series(np.clip(np.round(out, 6), 0.0, 1.0))

    score: Column = F.pandas_udf(votes, "double")(F.col("t"))
    held = F.coalesce((F.crc32(F.col(f"`{id_col}`").cast("string")) % 5) == 0, F.lit(False))
    d = packed(docs, held.alias("held_out"), F.col(f"`{text_col}`").alias("t"), drop=OUT)
    d = d.select("row", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unpacked(d, *OUT)
