"""Language identification of web pages by Bayesian evidence fusion.

Every page gets a posterior over the known languages from four pieces of
evidence, added as logarithms:

* text: character-trigram likelihoods of the page's main text.  The trigram
  counts per language come from **all** labelled documents, added up per Arrow
  batch and then by a grouped aggregate; trigrams are hashed into ``buckets``
  (so the model is at most ``max_langs x buckets`` numbers, whatever the input).
  Trigrams overlap, so their log-likelihood is divided by ``temper``;
* the language the markup declares (``<html lang>``, else a ``content-language``
  meta tag): ``P(declared | language)``;
* the address suffix (the host's last label): ``P(suffix | language)``;
* the host: a prior smoothed along host -> domain -> all pages, each level's
  counts mixed with ``strength`` pseudo-counts of the level above.

The last three are learned without labels from grouped counts of the pages' own
text votes: one aggregate per (host, domain, suffix, declared, vote) gives all
levels; a page's own vote is taken out of its host's and domain's counts, so it
is not used twice.  The tables of hosts, domains and suffixes have one row per key and may
grow with the pages: each is counted, broadcast up to ``broadcast_rows`` rows and joined
by shuffle beyond.  The declared table is bounded (known languages + other + none).

Defined results: null/empty html or no letters -> text evidence flat, the other
pieces decide; null url -> host, domain and suffix are the empty string (shared
by all such pages); repeated rows -> each counts and is reported; no labelled
documents -> ``lang`` null, confidence 0; empty table -> empty; input columns
with the output names are replaced.  Ties go to the language first in code
point order.  At most ``max_langs`` languages, the most frequent ones.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, unpacked
from .html_extract import Tree, main_text

OUT = ("host", "declared", "text_lang", "lang", "confidence", "posterior")
_SKIP = re.compile(r"[\d\W_]+")


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Bucket counts of the character trigrams of ``text`` (lower case, words padded by one space)."""
    t = f" {_SKIP.sub(' ', text.lower()).strip()} "
    if len(t) < 4:
        return np.zeros(buckets, dtype=np.int64)
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = (cp[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (cp[2:] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = 8192, max_langs: int = 64,
          smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from all documents with a language."""
    d = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    known = [r[0] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    known.sort()
    if not known:
        return [], np.zeros((0, buckets))

    def count(batches):
        place = {k: i for i, k in enumerate(known)}
        total = np.zeros((len(known), buckets), dtype=np.int64)
        for pdf in batches:
            for lang, part in pdf.groupby("lang")["text"]:
                if lang in place:
                    for t in part:
                        total[place[lang]] += trigrams(t, buckets)
        i, b = np.nonzero(total)
        yield pd.DataFrame({"i": i, "b": b, "c": total[i, b]})

    table = np.full((len(known), buckets), smooth)
    for r in d.mapInPandas(count, "i long, b long, c long").groupBy("i", "b").agg(F.sum("c").alias("c")).collect():
        table[r["i"], r["b"]] += r["c"]  # at most max_langs x buckets rows
    return known, np.log(table / table.sum(axis=1, keepdims=True))


def host_of(url: Column) -> Column:
    """Lower-case host of an address, '' when there is none."""
    h = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(h, r"\.+$", "")


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.[^.]*|[^.]*)$", 1)


def declared_in(page: Column) -> Column:
    """Primary tag of the declared language, '' when none is declared."""
    tag = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", 1)
    meta = F.regexp_extract(page, r"(?is)<meta\b[^>]*?content-language[^>]*?\bcontent\s*=\s*[\"']?\s*([a-z]+)", 1)
    return F.lower(F.coalesce(F.when(tag != "", tag).otherwise(meta), F.lit("")))


def _level(votes: DataFrame, key: str, n_langs: int) -> DataFrame:
    """Votes per language of each value of ``key`` (array in language order)."""
    return votes.groupBy(key).agg(F.array(*[F.sum(F.when(F.col("vote") == i, F.col("n")).otherwise(0)) for i in range(n_langs)])
                                  .alias(f"{key}_votes"))


def identify(pages: DataFrame, docs: DataFrame, tree: Tree, url_col: str = "url", html_col: str = "html", temper: float = 4.0,
             strength: float = 5.0, broadcast_rows: int = 100_000, **training) -> DataFrame:
    """Input rows plus host, declared, text_lang, lang, confidence and posterior (language -> probability)."""
    known, logp = train(docs, **training)
    d = packed(pages, host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("h"), drop=OUT)
    if not known:
        none = {"declared": declared_in(F.col("h")), "text_lang": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"),
                "confidence": F.lit(0.0), "posterior": F.create_map().cast("map<string,double>")}
        return unpacked(d.withColumns(none), *OUT)
    n, buckets = len(known), logp.shape[1]
    bc = pages.sparkSession.sparkContext.broadcast(logp)

    @F.pandas_udf("array<double>")
    def text_scores(col: pd.Series) -> pd.Series:
        table = bc.value
        return pd.Series([(table @ trigrams(main_text(p, tree)[0], buckets) / temper).tolist() for p in col])

    codes = F.array(*[F.lit(k) for k in known])
    d = d.select("row", "host", domain_of(F.col("host")).alias("domain"), F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
                 declared_in(F.col("h")).alias("declared"), text_scores(F.col("h")).alias("text"))
    says = F.array_position(codes, F.col("declared")) - 1
    d = d.withColumns({"says": F.when(F.col("declared") == "", n + 1).when(says < 0, n).otherwise(says),
                       "vote": (F.array_position("text", F.array_max("text")) - 1).cast("int"),
                       "flat": F.array_max("text") == F.array_min("text")})

    votes = cut(d.where(~F.col("flat")).groupBy("host", "domain", "suffix", "says", "vote").agg(F.count(F.lit(1)).alias("n")))
    every = {(r["says"], r["vote"]): r["n"] for r in votes.groupBy("says", "vote").agg(F.sum("n").alias("n")).collect()}  # (n + 2) x n rows
    by_lang = np.array([sum(v for (s, l), v in every.items() if l == i) for i in range(n)], dtype=float)
    prior = (by_lang + 1.0) / (by_lang.sum() + n)  # all pages
    says_given = np.array([[every.get((s, l), 0) + 1.0 for l in range(n)] for s in range(n + 2)])
    says_log = np.log(says_given / says_given.sum(axis=0))

    for key in ("suffix", "domain", "host"):  # few suffixes, often hot hosts: counted first, broadcast while small
        level = cut(_level(votes, key, n))
        d = d.join(F.broadcast(level) if level.count() <= broadcast_rows else level, key, "left")
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    zero = lit(np.zeros(n))
    own = lambda key: F.transform(F.coalesce(f"{key}_votes", zero), lambda v, i: v - F.when(~F.col("flat") & (i == F.col("vote")), 1.0).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    d = d.withColumns({"dv": own("domain"), "hv": own("host"), "sv": F.coalesce("suffix_votes", zero)})
    d = d.withColumns({"dn": total(F.col("dv")), "hn": total(F.col("hv"))})
    d = d.withColumn("dp", F.transform("dv", lambda v, i: (v + strength * lit(prior)[i]) / (F.col("dn") + strength)))
    d = d.withColumn("hp", F.transform("hv", lambda v, i: (v + strength * F.col("dp")[i]) / (F.col("hn") + strength)))
    says_rows = F.array(*[lit(r) for r in says_log])
    d = d.withColumn("score", F.transform("text", lambda t, i: t + F.log(F.col("hp")[i]) + says_rows[F.col("says").cast("int")][i]
                                          + F.log((F.col("sv")[i] + 1.0) / (lit(by_lang)[i] + n))))
    d = d.withColumn("top", F.array_max("score"))
    d = d.withColumn("odds", F.transform("score", lambda s: F.exp(s - F.col("top"))))
    d = d.withColumn("p", F.transform("odds", lambda o: o / total(F.col("odds"))))
    best = F.array_position("score", F.col("top")).cast("int")
    d = d.withColumns({"lang": F.element_at(codes, best), "confidence": F.array_max("p"), "posterior": F.map_from_arrays(codes, "p"),
                       "text_lang": F.when(~F.col("flat"), codes[F.col("vote")])})
    return unpacked(d, *OUT)
