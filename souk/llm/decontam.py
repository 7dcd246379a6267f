"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

Method (DataFrame functions only: no Python, pandas or Arrow on the path).

* Words are runs of non-white-space, A-Z lower-cased; every word has a 64-bit hash.
* Windows are item-sized: for every item of ``m`` words, windows of ``m`` words
  (and of 0.9 m and 0.8 m, for passages that lost an end) slide over the documents
  at every word (from 128 words on, at every ``L div 128`` words).  A window of
  ``L`` words can only reach the similarity wanted when ``threshold`` of its
  shingles belong to one item; the positions of such shingles come from one join
  of the documents' shingle hashes with the items', and windows with fewer are
  not fingerprinted.  This drops no window that could be verified.
* SimHash: bit ``b`` is set when more than half of the window's words have it
  set.  The per-bit counts are summed as sixteen longs of four 12-bit counters
  by one grouped aggregate; windows have at most ``max_window`` = 4,000 words, so no
  counter can overflow (longer items are compared through windows of that size).
* Items get the fingerprints of their own windows of the same lengths, at the
  first and last offset and about eight between.
* Multi-index Hamming search: 64 bits in ``blocks`` blocks.  Two
  fingerprints within ``radius`` bits agree on some block up to ``radius div blocks``
  = 1 bit, by pigeonhole; the items' side lists each block value and its
  one-bit neighbours, so one equi-join on (length, block, value) finds every pair
  within the radius, and the distance is then checked exactly.
* Verification, exact: for each candidate the window itself and the whole
  item's span aligned with it are compared with the item by their 5-word
  shingles, weighted by occurrences: ``sum min(counts) / sum max(counts) >=
  threshold``.

Sizes: the join with the items' shingles and the second reading of the few documents that
have windows are broadcast joins up to ``broadcast_rows`` rows (counted first),
shuffle joins beyond.  Texts are never shuffled but for those documents.

Output per input row: ``contaminated`` (bool), ``item_ids`` (sorted array of
matched items, empty if none), ``similarity`` (best, 0.0 if none).
Defined results: null/empty text or null id -> not contaminated; repeated rows
-> same result each (a document is its id and text); items without words or id
match nothing; items of fewer than five words match documents that hold their
words in a row; no items -> nothing contaminated; empty table -> empty; input
columns of any name are kept, those with the output names replaced.
The radius is a recall parameter: one replaced word of 40 moves 4.6 bits on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_az, packed, unpacked, words

OUT = ("contaminated", "item_ids", "similarity")
LONGS, PER, WIDTH = 16, 4, 12  # sixteen longs of four 12-bit counters cover 64 bits


def _fingerprints(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(keys, size, ws: words of a window) -> keys, size, fp: one SimHash per window."""
    one = rows.select(*keys, size, F.explode_outer("ws").alias("x")).select(*keys, size, F.xxhash64("x").alias("h"))
    counters = []
    for g in range(LONGS):
        terms = [F.shiftleft(F.shiftright("h", g * PER + j).bitwiseAND(F.lit(1)), WIDTH * j) for j in range(PER)]
        counters.append(F.sum(terms[0] + terms[1] + terms[2] + terms[3]).alias(f"c{g}"))
    sums = one.groupBy(*keys, size).agg(*counters)
    fp = F.lit(0).cast("long")
    for b in range(64):
        c = F.shiftright(f"c{b // PER}", WIDTH * (b % PER)).bitwiseAND(F.lit((1 << WIDTH) - 1))
        fp = fp.bitwiseOR(F.when(2 * c > F.col(size), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, size, fp.alias("fp"))


def _spread(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _block_values(fp: Column, blocks: int, neighbours: bool) -> Column:
    """(blk, val) structs of a fingerprint; with ``neighbours`` also every value one bit away."""
    out = []
    for i, (first, width) in enumerate(_spread(blocks)):
        v = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for flip in [0] + [1 << j for j in range(width)] * neighbours:
            out.append(F.struct(F.lit(i).alias("blk"), v.bitwiseXOR(F.lit(flip).cast("long")).alias("val")))
    return F.array(*out)


def _shingles(w: Column, g: int) -> Column:
    """Hashes of the ``g``-word shingles of a words column, one per position."""
    return (F.when(F.size(w) >= g, F.transform(F.sequence(F.lit(0), F.size(w) - g), lambda i: F.xxhash64(*[w[i + j] for j in range(g)])))
            .otherwise(F.array().cast("array<bigint>")))


def _sizes(m: Column, max_window: int) -> Column:
    """Window lengths for an item of ``m`` words."""
    return F.array_distinct(F.transform(F.array(m, F.ceil(m * 0.9).cast("int"), F.ceil(m * 0.8).cast("int")), lambda x: F.least(x, F.lit(max_window))))


def _starts(p: Column, size: Column, n_shingles: Column, need: Column, n_words: Column) -> Column:
    """Starts of the windows of ``size`` words with at least ``need`` of the positions ``p``."""
    step = F.greatest(F.lit(1), F.floor(size / 128).cast("int"))

    def span(i):
        lo = F.greatest(p[i + need - 1] - n_shingles + 1, F.when(i > 0, F.get(p, i - 1) + 1).otherwise(0), F.lit(0))
        lo = F.ceil(lo / step).cast("int") * step
        hi = F.least(p[i], n_words - size)
        return F.when(lo <= hi, F.sequence(lo, hi, step)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), span))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", n: int = 5, radius: int = 11, blocks: int = 6,
                  threshold: float = 0.75, max_window: int = 4000, broadcast_rows: int = 200_000) -> DataFrame:
    """Input rows plus contaminated, item_ids and similarity."""
    if radius // blocks > 1 or max_window >= 1 << WIDTH:
        raise ValueError("the probes cover one bit per block, the counters windows below 4096 words")
    t100 = int(round(100 * threshold))
    text = F.col(f"`{text_col}`")
    base = packed(docs, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), drop=OUT)
    it = cut(items.select(F.col(f"`{item_id_col}`").cast("long").alias("item"), words(fold_az(F.col(f"`{item_text_col}`"))).alias("iw"))
             .where(F.col("item").isNotNull()).select("item", "iw", F.size("iw").alias("m")).where("m > 0"))
    keyed = (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), words(fold_az(text)).alias("w"))
             .where(F.col("id").isNotNull()))

    # positions of the items' shingles in the documents
    found = None
    for (g,) in it.select(F.least(F.lit(n), "m").alias("g")).distinct().orderBy("g").collect():  # at most n values
        sh = (it.where(F.least(F.lit(n), "m") == g).select("item", "m", F.explode_outer(_shingles(F.col("iw"), g)).alias("h"))
              .groupBy("item", "m", "h").agg(F.count(F.lit(1)).cast("int").alias("ci")))
        sh = F.broadcast(sh) if sh.count() <= broadcast_rows else sh
        at = keyed.select("id", "th", F.size("w").alias("nw"), F.posexplode_outer(_shingles(F.col("w"), g)).alias("pos", "h"))
        at = at.where(F.col("h").isNotNull()).join(sh, "h").select("id", "th", "nw", "item", "m", F.lit(g).alias("g"), "pos", "h", "ci")
        found = at if found is None else found.unionByName(at)
    none = {"contaminated": F.lit(False), "item_ids": F.array().cast("array<bigint>"), "similarity": F.lit(0.0)}
    if found is None:
        return unpacked(base.withColumns(none), *OUT)
    need = lambda k: F.greatest(F.lit(1), F.ceil(k * t100 / 100).cast("int"))
    least = need(F.least(F.ceil(F.col("m") * 0.8).cast("int"), F.lit(max_window)) - F.col("g") + 1)
    per = cut(found.groupBy("id", "th", "nw", "item", "m", "g").agg(F.array_sort(F.collect_set(F.struct("pos", "h", "ci"))).alias("p"))
              .where(F.size("p") >= least))

    # item-sized windows with enough of them, and their fingerprints
    wins = per.select("*", F.explode(_sizes(F.col("m"), max_window)).alias("len")).where((F.col("len") >= F.col("g")) & (F.col("len") <= F.col("nw")))
    wins = wins.withColumns({"ns": F.col("len") - F.col("g") + 1, "pp": F.col("p.pos")})
    wins = wins.withColumn("need", need(F.col("ns"))).where(F.size("pp") >= F.col("need"))
    wins = wins.select("id", "th", "len", F.explode_outer(_starts(F.col("pp"), F.col("len"), F.col("ns"), F.col("need"), F.col("nw"))).alias("s"))
    wins = cut(wins.where(F.col("s").isNotNull()).groupBy("id", "th").agg(F.collect_set(F.struct("len", "s")).alias("x")))
    keys = wins.select("id", "th")
    few = keys.count() <= broadcast_rows
    hot = keyed.join(F.broadcast(keys) if few else keys, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    rows = hot.join(wins, ["id", "th"]).select("id", "th", "w", F.explode_outer("x").alias("x"))
    dfp = _fingerprints(rows.select("id", "th", F.col("x.s").alias("s"), F.col("x.len").alias("len"), F.slice("w", F.col("x.s") + 1, F.col("x.len")).alias("ws")),
                        ["id", "th", "s"], "len")
    io = it.select("item", "iw", "m", F.explode(_sizes(F.col("m"), max_window)).alias("len")).withColumn("spare", F.col("m") - F.col("len"))
    offs = F.array_union(F.sequence(F.lit(0), F.col("spare"), F.greatest(F.lit(1), F.floor(F.col("spare") / 8).cast("int"))), F.array("spare"))
    io = io.select("item", "iw", "m", "len", F.explode(offs).alias("off"))
    ifp = _fingerprints(io.select("item", "m", "off", "len", F.slice("iw", F.col("off") + 1, F.col("len")).alias("ws")), ["item", "m", "off"], "len")

    # every pair of fingerprints within the radius
    db = dfp.select("id", "th", "s", "len", "fp", F.explode(_block_values(F.col("fp"), blocks, False)).alias("b")).select("id", "th", "s", "len", "fp", "b.blk", "b.val")
    ib = (ifp.select("item", "m", "off", "len", F.col("fp").alias("ifp"), F.explode(_block_values(F.col("fp"), blocks, True)).alias("b"))
          .select("item", "m", "off", "len", "ifp", "b.blk", "b.val"))
    cand = (db.join(ib, ["len", "blk", "val"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
            .select("id", "th", "item", "m", "s", "off", "len").distinct())

    # exact similarity of the window and of the whole item's span aligned with it
    half = F.floor(F.col("len") / 256).cast("int")  # half a step of the window starts
    starts = F.array_distinct(F.transform(F.array(F.lit(0), -half, half), lambda x: F.greatest(F.lit(0), F.col("s") - F.col("off") + x)))
    spans = F.array_union(F.array(F.struct(F.col("s").alias("a"), F.col("len").alias("k"))),
                          F.transform(starts, lambda a: F.struct(a.alias("a"), F.col("m").alias("k"))))
    spans = cand.select("id", "th", "item", F.explode(spans).alias("x")).select("id", "th", "item", "x.a", "x.k").distinct()
    v = spans.join(per, ["id", "th", "item"]).withColumn("k", F.least("k", F.col("nw") - F.col("a"))).where(F.col("k") >= F.col("g"))
    v = v.withColumn("hs", F.transform(F.filter("p", lambda x: (x["pos"] >= F.col("a")) & (x["pos"] <= F.col("a") + F.col("k") - F.col("g"))),
                                       lambda x: F.struct(x["h"].alias("h"), x["ci"].alias("ci"))))
    v = v.withColumn("ds", F.array_distinct("hs"))
    same = F.when(F.size("ds") == F.size("hs"), F.size("hs")).otherwise(
        F.aggregate("ds", F.lit(0), lambda acc, x: acc + F.least(x["ci"], F.size(F.filter("hs", lambda y: y["h"] == x["h"])))))
    v = v.withColumn("both", same).withColumn("all", F.col("k") - F.col("g") + 1 + F.col("m") - F.col("g") + 1 - F.col("both"))
    hits = (v.where(100 * F.col("both") >= t100 * F.col("all")).groupBy("id", "th")
            .agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("both") / F.col("all")).alias("sim")))
    hits = cut(hits)
    hits = F.broadcast(hits) if few else hits  # no more rows than keys
    out = base.join(hits, ["id", "th"], "left")
    return unpacked(out.withColumns({"contaminated": F.col("items").isNotNull(),
                                     "item_ids": F.coalesce("items", F.array().cast("array<bigint>")),
                                     "similarity": F.coalesce("sim", F.lit(0.0))}), *OUT)
