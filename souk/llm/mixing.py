"""Mixing sources to target weights by fixed-length blocks and permuted slots.

Method.  A document's size is its number of words (runs of non-white-space;
null text: 0).  Sources are ordered by code point (null last) and weighted
``weights[i % len(weights)]``; together the targets share all words of the
corpus, a target stops at ``cap`` times its source's size and the excess is
reshared by weight among the others until none is above (water-filling over
the per-source table, one row per source).

Each source's words are packed into blocks of one length per source: ``block``
words, fewer where the source's target would not make ``min_slots`` blocks (one
word at least).  Multinomial counts of ``min_slots`` draws deviate by about
1 / sqrt(min_slots) = 1.6 %, so every source's taken words come near its
target, whatever the size of the corpus.  Offsets are a two-level prefix sum:
documents are dealt by a hash of their id into buckets of about ``bucket_docs``;
totals per (source, bucket), then a window inside each bucket, so a hot source
and any kind of ids spread over many tasks.

The output is cut into shards of ``shard_blocks`` slots; every shard draws its
source counts from a multinomial with the targets' shares of the slots (numpy
generator seeded by (seed, shard): reruns agree) and deals them to its slots.
A source's ``k``-th slot takes the block ``b`` with ``rank(b) = k mod m``, a
per-source pseudorandom permutation ``rank(b) = (a*b + c) mod m`` (``a`` coprime
to ``m``), repeated in epochs.  The slot rows (shard, slot, source, block) are
joined by (source, block) with the block table: the pieces of documents each
block holds.  ``mix`` sums the joined words per document, ``mixed`` returns the
joined pieces as text, ``mixed_documents`` puts them together per document.
Slot totals are clamped to ``floor(cap)`` epochs, so no document is taken more
than ``cap`` times its size.

The tables of one row per source (sizes, targets, parameters) are collected and
broadcast: sources are names given by the corpus's owners, thousands at most;
``max_sources`` refuses more.

Output per input row: size, source_size, target (its source's), taken.
Defined results: null id -> size counted nowhere, taken 0, target of its
source; empty/null text -> size 0, taken 0; null source is its own source
(last); repeated rows are packed one after the other; empty table -> empty;
input columns of any name are kept (the input row travels as one struct), those
with the output names are replaced.
``mixed`` output: the input columns, one row per (slot, piece), plus shard, slot
and piece (the word position in the block); the pieces of a document put
together are its text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, packed, unpacked

OUT = ("size", "source_size", "target", "taken")
SLOT = ("shard", "slot", "piece")


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above cap * size."""
    total = float(sum(sizes))
    fixed = [None] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if fixed[i] is None]
        rest = total - sum(f for f in fixed if f is not None)
        wsum = sum(weights[i] for i in free)
        if not free or wsum <= 0:
            return [f or 0.0 for f in fixed]
        over = [i for i in free if rest * weights[i] / wsum > cap * sizes[i]]
        if not over:
            for i in free:
                fixed[i] = rest * weights[i] / wsum
            return fixed
        for i in over:
            fixed[i] = cap * float(sizes[i])


def _multiplier(m: int, salt: int) -> int:
    a = (salt % max(m, 1)) | 1
    while math.gcd(a, m) != 1:
        a += 2
    return a % max(m, 1) if m > 1 else 1


def _deal(docs: DataFrame, out: tuple, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple = (5, 2, 1), cap: float = 3.0, block: int = 1024, min_slots: int = 4000, shard_blocks: int = 4096,
          bucket_docs: int = 4096, max_sources: int = 10000, seed: int = 7):
    """(sized rows, parameters per source, placed documents, slots, block table); the input row
    without ``out`` is the column ``row``, its text ``t``."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    sized = packed(docs, F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("src"),
                   n_words(text).alias("size"), F.xxhash64(text).alias("tie"), text.alias("t"), drop=out)
    live = sized.where(F.col("id").isNotNull())
    summary = (live.groupBy("src").agg(F.sum("size").alias("ss"), F.count(F.lit(1)).alias("docs"))
               .limit(max_sources + 1).collect())  # one row per source
    if len(summary) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = sorted([r["src"] for r in summary if r["src"] is not None]) + [None] * any(r["src"] is None for r in summary)
    ss = {r["src"]: int(r["ss"]) for r in summary}
    sizes = [ss[s] for s in names]
    targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], cap)
    blocks = [max(1, min(block, int(t // min_slots))) for t in targets]
    share = np.array([t / b for t, b in zip(targets, blocks)], dtype=np.float64)  # expected slots
    n_slots = int(round(share.sum()))
    n_shards = -(-n_slots // shard_blocks) if n_slots else 0
    p = share / share.sum() if share.sum() > 0 else share
    n_buckets = max(1, sum(r["docs"] for r in summary) // bucket_docs)

    def draw(batches):
        for pdf in batches:
            for sh in pdf["id"].tolist():
                slots = min(shard_blocks, n_slots - sh * shard_blocks)
                rng = np.random.default_rng([seed, int(sh)])
                c = rng.multinomial(slots, p)
                at = rng.permutation(slots)  # the slots, source after source
                yield pd.DataFrame({"shard": np.full(slots, sh), "slot": at, "si": np.repeat(np.arange(len(c)), c).astype(np.int32),
                                    "j": np.arange(slots) - np.repeat(np.cumsum(c) - c, c)})

    draws = spark.range(n_shards).mapInPandas(draw, "shard long, slot long, si int, j long")
    counts = draws.groupBy("shard", "si").agg(F.count(F.lit(1)).alias("cnt"))  # at most shards x sources rows
    got = {r["si"]: int(r["n"]) for r in counts.groupBy("si").agg(F.sum("cnt").alias("n")).collect()} if len(names) else {}
    params = []
    for i, s in enumerate(names):
        m = -(-sizes[i] // blocks[i])
        n = min(got.get(i, 0), int(math.floor(cap)) * m)
        a = _multiplier(m, 2654435761 * (i + 1) + seed)
        params.append((s, i, sizes[i], float(targets[i]), blocks[i], m, n, pow(a, -1, m) if m > 1 else 0, (seed * 40503 + i) % max(m, 1)))
    pt = spark.createDataFrame(params, "psrc string, si int, source_size long, target double, blk long, m long, n long, inv long, c long")
    pt = F.broadcast(pt)  # one row per source, at most max_sources

    # a source's draws before each shard, summed over blocks of shards and inside them
    wide = counts.withColumn("sb", F.floor(F.col("shard") / 4096))
    before = wide.groupBy("si", "sb").agg(F.sum("cnt").alias("bc"))
    before = before.select("si", "sb", (F.sum("bc").over(Window.partitionBy("si").orderBy("sb")) - F.col("bc")).alias("b0"))
    inside = F.sum("cnt").over(Window.partitionBy("si", "sb").orderBy("shard")) - F.col("cnt")
    counts = (wide.select("shard", "si", "sb", inside.alias("b1")).join(before, ["si", "sb"])
              .select("shard", "si", (F.col("b0") + F.col("b1")).alias("soff")))
    k = F.col("soff") + F.col("j")
    slots = (draws.join(counts, ["shard", "si"]).join(pt.select("si", "m", "n", "inv", "c"), "si")
             .where(k < F.col("n"))
             .select("shard", "slot", "si", F.pmod(F.col("inv") * (F.pmod(k, F.col("m")) - F.col("c")), F.col("m")).alias("b")))

    live = live.join(pt, F.col("src").eqNullSafe(F.col("psrc"))).withColumn("bk", F.pmod(F.xxhash64("id"), F.lit(n_buckets)))
    bsum = live.groupBy("si", "bk").agg(F.sum("size").alias("bs"))
    bsum = bsum.select(F.col("si").alias("bsi"), F.col("bk").alias("bbk"),
                       (F.sum("bs").over(Window.partitionBy("si").orderBy("bk")) - F.col("bs")).alias("boff"))
    # rows, not range: repeated rows lie one after the other
    w_in = Window.partitionBy("si", "bk").orderBy("id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (live.withColumn("inn", F.sum("size").over(w_in) - F.col("size"))
              .join(bsum, (F.col("si") == F.col("bsi")) & (F.col("bk") == F.col("bbk")))
              .withColumn("off", F.col("boff") + F.col("inn")))
    first, last = F.floor(F.col("off") / F.col("blk")), F.floor((F.col("off") + F.col("size") - 1) / F.col("blk"))
    # a document is known by its source and offset: documents of size 0 are in no block
    table = (placed.where(F.col("size") > 0)
             .select("si", "off", "size", "blk", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("b"))
             .select("si", "b", "off", F.greatest(F.col("off"), F.col("b") * F.col("blk")).alias("lo"),
                     F.least(F.col("off") + F.col("size"), (F.col("b") + 1) * F.col("blk")).alias("hi")))
    return sized, pt, placed, slots, table


def mix(docs: DataFrame, **kw) -> DataFrame:
    """Input rows plus size, source_size, target and taken (parameters: see ``_deal``)."""
    sized, pt, placed, slots, table = _deal(docs, OUT, **kw)
    times = slots.groupBy("si", "b").agg(F.count(F.lit(1)).alias("k"))
    got = (table.join(times, ["si", "b"]).groupBy(F.col("si").alias("gsi"), F.col("off").alias("goff"))
           .agg(F.sum((F.col("hi") - F.col("lo")) * F.col("k")).alias("taken")))
    done = (placed.join(got, (F.col("si") == F.col("gsi")) & (F.col("off") == F.col("goff")) & (F.col("size") > 0), "left")
            .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")))
    nulls = (sized.where(F.col("id").isNull()).join(pt, F.col("src").eqNullSafe(F.col("psrc")), "left")
             .withColumn("taken", F.lit(0).cast("long")))
    return unpacked(done.select("row", *OUT).unionByName(nulls.select("row", *OUT)), *OUT)


def _units(text):
    """Every word with the white space before it, the last one also with the white space behind it."""
    return F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"), F.lit(0))


def _pieces(slots: DataFrame, table: DataFrame) -> DataFrame:
    """Slot rows joined with the block table: shard, slot, and the words lo to hi of document (gsi, goff)."""
    t = table.select(F.col("si").alias("gsi"), F.col("b").alias("gb"), F.col("off").alias("goff"), "lo", "hi")
    return slots.join(t, (F.col("si") == F.col("gsi")) & (F.col("b") == F.col("gb"))).select("shard", "slot", "gsi", "goff", "lo", "hi")


def mixed(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The mix itself: per (shard, slot) the pieces of documents of its block, as text."""
    _, _, placed, slots, table = _deal(docs, SLOT, text_col=text_col, **kw)
    n = F.col("hi") - F.col("lo")
    part = F.array_join(F.slice(_units(F.col("t")), (F.col("lo") - F.col("off") + 1).cast("int"), n.cast("int")), "")
    rows = placed.where(F.col("size") > 0).join(_pieces(slots, table), (F.col("si") == F.col("gsi")) & (F.col("off") == F.col("goff")))
    row = F.col("row").withField(f"`{text_col}`", F.when(n == F.col("size"), F.col("t")).otherwise(part))
    return unpacked(rows.select(row.alias("row"), "shard", "slot", F.pmod("lo", "blk").alias("piece")), *SLOT)


def mixed_documents(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The mixed rows put together per document: the input columns, one row per document that is
    taken, its text the drawn pieces (in order, copy after copy, a line feed between copies)."""
    _, _, placed, slots, table = _deal(docs, (), text_col=text_col, **kw)
    copy = F.row_number().over(Window.partitionBy("gsi", "goff", "lo").orderBy("shard", "slot"))
    got = (_pieces(slots, table).select("gsi", "goff", copy.alias("copy"), "lo", "hi").groupBy("gsi", "goff")
           .agg(F.array_sort(F.collect_list(F.struct("copy", "lo", "hi"))).alias("ps")))

    def part(x, i):
        n = x["hi"] - x["lo"]
        piece = F.when(n == F.col("size"), F.col("t")).otherwise(
            F.array_join(F.slice(F.col("u"), (x["lo"] - F.col("off") + 1).cast("int"), n.cast("int")), ""))
        new = (i > 0) & (F.get(F.col("ps"), i - 1)["copy"] != x["copy"])
        return F.concat(F.when(new, "\n").otherwise(""), piece)

    whole = F.forall("ps", lambda x: x["hi"] - x["lo"] == F.col("size"))
    rows = (placed.where(F.col("size") > 0).join(got, (F.col("si") == F.col("gsi")) & (F.col("off") == F.col("goff")))
            .withColumn("u", F.when(~whole, _units(F.col("t"))))
            .withColumn("mixed", F.array_join(F.transform("ps", part), "")))
    return unpacked(rows.select(F.col("row").withField(f"`{text_col}`", F.col("mixed")).alias("row")))
