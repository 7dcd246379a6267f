"""Near-duplicate documents: MinHash bands, odd-sketch filter, exact confirmation.

Method.  Every text becomes the set of its distinct ``n``-word shingles
(A-Z lower-cased, words are runs of non-white-space; fewer than ``n`` words:
the whole sequence is one shingle; no words: the empty set, linked with
nothing).  Shingles are 64-bit hashes.

1. One Arrow pass over the texts writes a narrow table: set size, a 128-bit
   hash of the set, the keys of ``num_perm / rows_per_band`` MinHash bands, and the odd
   sketch: the MinHash samples folded into a ``64 * sketch_words``-bit parity
   bitmap.  Sets themselves are not stored.
2. Exact copies (same set) collapse to one representative, the smallest id,
   with a grouped aggregate, so groups of thousands of copies cost one row.
3. First candidates: every document with the smallest id of all its buckets; then,
   where the two are in different components still, with a pseudorandom member of
   each of its buckets, ``rounds`` times (one partner per bucket and round: linear).  The popcount of the XOR of two odd sketches estimates the similarity of
   the samples; candidates below ``sketch_floor`` (or of sizes too different) go.
   A second bitmap holds the parities of the whole set: every shingle that only one of two
   sets has flips one bit of their XOR, so its popcount is at most the size of the symmetric difference.
4. The rest are confirmed on the full shingle sets, ``100 * |A n B| >= 100 *
   threshold * |A u B|``: the sets of the documents that have candidates are
   made again from their texts, dealt to (smallest id, salt) and compared while
   streaming; a smallest id with very many partners is salted over many tasks.
5. Components of the confirmed links: smallest reachable id.
6. Second candidates: buckets that still hold several components.  Their
   members are joined with each other across components (the size, sketch and
   parity conditions inside the join: the last refutes most pairs below the threshold and never a link),
   confirmed, and joined to components as above.  So every pair of
   a bucket is either in one component, refuted or confirmed; no cap.

Defined results for odd input: null or empty text -> empty set, own
component, kept; null id -> not linked (component_id null, kept false);
repeated rows -> each row reported; rows that repeat an id with other texts
share their component; input columns called ``n_shingles``, ``component_id`` or
``kept`` are replaced, others are kept whatever their names; empty table ->
empty.  Candidates come from buckets: a link whose ends share none is missed,
(1 - 0.75^4)^32 = 5e-6 at similarity 0.75, as is one whose sketch estimate falls below the floor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, release_memory, stored, unpacked

OUT = ("n_shingles", "component_id", "kept")
_A, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, w):
        import xxhash
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_WORDS = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    k = len(words)
    if not k:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=k)
    m = min(n, k)
    h = np.full(k - m + 1, m, dtype=np.uint64)
    for j in range(m):
        h = h * _A + w[j:k - m + 1 + j]
    return np.unique(_mix(h))


class Sketcher:
    """MinHash bands and odd sketches of shingle sets."""

    def __init__(self, num_perm: int, rows_per_band: int, sketch_words: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 63, num_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, num_perm, dtype=np.uint64)
        self.rows, self.bits = rows_per_band, 64 * sketch_words

    def samples(self, hs: np.ndarray) -> np.ndarray:
        out = np.full(len(self.mul), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(hs), 1024):
            part = (hs[i:i + 1024, None] * self.mul + self.add) >> np.uint64(32)
            np.minimum(out, part.min(axis=0), out=out)
        return out

    def bands(self, sig: np.ndarray) -> np.ndarray:
        rows = sig.reshape(-1, self.rows)
        h = np.arange(len(rows), dtype=np.uint64)
        for j in range(self.rows):
            h = h * _A + rows[:, j]
        return _mix(h).view(np.int64)

    def sketch(self, sig: np.ndarray) -> np.ndarray:
        place = _mix(sig * _A + np.arange(len(sig), dtype=np.uint64)) % np.uint64(self.bits)
        odd = np.bincount(place.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity(hs: np.ndarray, parity_words: int) -> np.ndarray:
    """Parities of a whole set folded into ``64 * parity_words`` bits."""
    odd = np.bincount((hs % np.uint64(64 * parity_words)).astype(np.int64), minlength=64 * parity_words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def xor_popcount(a: Column, b: Column, n_words: int) -> Column:
    """Bits in which two bitmaps of ``n_words`` longs differ."""
    return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(n_words)), F.lit(0))


def odd_sketch_similarity(xor_bits: Column, num_perm: int, sketch_words: int) -> Column:
    """Similarity of two MinHash samples from the popcount of their XORed odd sketches."""
    z = 64.0 * sketch_words
    frac = F.least(2.0 * xor_bits / z, F.lit(0.999999))
    diff = -(z / 2.0) * F.log(1.0 - frac)  # estimated size of the symmetric difference
    return 1.0 - diff / (2.0 * num_perm)


def sketched(texts: DataFrame, n: int, num_perm: int, rows_per_band: int, sketch_words: int, parity_words: int) -> DataFrame:
    """(id, th, t) -> (id, th, n, k1, k2, bands, sk, ps)."""

    def run(batches):
        import xxhash
        s = Sketcher(num_perm, rows_per_band, sketch_words)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                b = batch.slice(at, 1024)
                size, k1, k2, bands, sk, ps = [], [], [], [], [], []
                for t in b.column(2).to_pylist():
                    hs = shingle_set(t, n)
                    size.append(len(hs))
                    a, c = np.frombuffer(xxhash.xxh3_128_digest(hs.tobytes()), dtype=np.int64).tolist()
                    k1.append(a)
                    k2.append(c)
                    sig = s.samples(hs)
                    bands.append(s.bands(sig))
                    sk.append(s.sketch(sig))
                    ps.append(parity(hs, parity_words))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sk, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int64()))],
                    names=["id", "th", "n", "k1", "k2", "bands", "sk", "ps"])
        release_memory()

    return texts.mapInArrow(run, "id long, th long, n long, k1 long, k2 long, bands array<long>, sk array<long>, ps array<long>")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b) links -> (node, label) with label the smallest node reachable.

    Each round: the smallest label among the neighbours, then the label of that label; rounds are stored tables.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        near = (both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = label.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("label").alias("top"))
        new = stored(step.join(up, "low", "left").select("node", "label", F.least("low", "top").alias("new")))
        if not new.where("new <> label").limit(1).count():
            return label
        label = new.select("node", F.col("new").alias("label"))
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def _labelled(pairs: DataFrame, lab: DataFrame) -> DataFrame:
    """(a, b) pairs with the labels la, lb of their ends (their own ids where they have none)."""
    of = lambda c, out: lab.select(F.col("node").alias(c), F.col("label").alias(out))
    return (pairs.join(of("a", "la"), "a", "left").join(of("b", "lb"), "b", "left")
            .select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))


def _merged(lab: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after some more links: components over the labels only."""
    joined = _labelled(links, lab).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    new = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    alone = new.select(F.col("label").alias("node"), "label").join(lab.select("node"), "node", "left_anti")
    return stored(lab.select("node", "label").unionByName(alone.select("node", "label")).join(new, "label", "left")
                  .select("node", F.coalesce("top", "label").alias("label")))


def confirmed(cand: DataFrame, texts: DataFrame, n: int, t100: int, fan: int = 4096, broadcast_rows: int = 200_000) -> DataFrame:
    """The candidate pairs (a, b) whose full shingle sets are similar enough."""
    ends = stored(cand.select(F.col("a").alias("id")).unionByName(cand.select(F.col("b").alias("id"))).distinct())
    few = ends.count() <= broadcast_rows

    def sets(batches):
        for b in batches:
            hs = [shingle_set(t, n).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.binary())], names=["id", "hs"])
        release_memory()

    full = (texts.select("id", "t").join(F.broadcast(ends) if few else ends, "id", "left_semi").mapInArrow(sets, "id long, hs binary"))
    full = stored(full.distinct())
    # each partner's set travels to the smaller id; its own set to every salt of it
    fans = cand.groupBy("a").agg((F.count(F.lit(1)) / fan).cast("int").alias("salts"))
    dealt = (cand.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts") + 1).alias("salt"), "b")
             .join(full.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "hs"))
    heads = (fans.join(full.withColumnRenamed("id", "a"), "a")
             .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long"))).alias("salt"), F.lit(0).alias("kind"),
                     F.lit(None).cast("long").alias("b"), "hs"))
    rows = heads.unionByName(dealt).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def check(batches):
        at, own = None, []
        for batch in batches:
            out = []
            for a, salt, kind, b, raw in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                hs = np.frombuffer(raw, dtype=np.uint64)
                if (a, salt) != at:
                    at, own = (a, salt), []
                if not kind:
                    own.append(hs)
                    continue
                for x in own:  # one set, or more where rows repeat an id
                    if len(x) and len(hs) and 100 * min(len(x), len(hs)) >= t100 * max(len(x), len(hs)):
                        both = int((x[np.minimum(np.searchsorted(x, hs), len(x) - 1)] == hs).sum())
                        if 100 * both >= t100 * (len(x) + len(hs) - both):
                            out.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    threshold: float = 0.75, num_perm: int = 128, rows_per_band: int = 4,
                    sketch_words: int = 8, sketch_floor: float = 0.5, rounds: int = 2, parity_words: int = 16) -> DataFrame:
    """Input rows plus n_shingles, component_id (smallest id reachable) and kept."""
    if num_perm % rows_per_band:
        raise ValueError("num_perm is a multiple of rows_per_band")
    t100 = int(round(threshold * 100))
    text = F.col(f"`{text_col}`")
    base = packed(docs, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), drop=OUT)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    narrow = stored(sketched(texts, n, num_perm, rows_per_band, sketch_words, parity_words), "sketches")
    live = narrow.where((F.col("n") > 0) & F.col("id").isNotNull())
    groups = live.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sk").alias("sk"), F.first("ps").alias("ps"))
    reps = stored(groups, "representatives")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    centres = [F.min_by("rep", F.xxhash64("rep", "band", F.lit(i))).alias(f"c{i}") for i in range(rounds)]
    buckets = stored(banded.groupBy("band", "key").agg(F.min("rep").alias("lo"), F.count(F.lit(1)).alias("cnt"), *centres).where("cnt > 1"))
    memb = stored(banded.join(buckets, ["band", "key"]).select("band", "key", "rep", "lo", "cnt", *[f"c{i}" for i in range(rounds)]))

    def plausible(na, nb, ska, skb):
        return ((100 * F.least(na, nb) >= t100 * F.greatest(na, nb))
                & (odd_sketch_similarity(xor_popcount(ska, skb, sketch_words), num_perm, sketch_words) >= sketch_floor))

    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("sk").alias(f"sk{s}"))
    near = plausible(F.col("na"), F.col("nb"), F.col("ska"), F.col("skb"))
    screen = lambda pairs: stored(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b").distinct())
    # rows that repeat an id with other texts: their groups belong together
    again = (live.join(reps.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"]).select("id", "rep").distinct()
             .groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("bs")).where(F.size("bs") > 1)
             .select("a", F.explode("bs").alias("b")).where("a <> b"))
    # each member with the smallest id of all its buckets
    first = memb.groupBy(F.col("rep").alias("b")).agg(F.min("lo").alias("a")).where("a < b").select("a", "b")
    lab = components(confirmed(screen(first), texts, n, t100).unionByName(again))
    # then, where labels still differ, with one pseudorandom member of each of its buckets, in rounds
    for i in range(rounds):
        pairs = memb.where(F.col("rep") != F.col(f"c{i}")).select(F.least("rep", f"c{i}").alias("a"), F.greatest("rep", f"c{i}").alias("b")).distinct()
        pairs = _labelled(pairs, lab).where("la <> lb").select("a", "b")
        lab = _merged(lab, stored(confirmed(screen(pairs), texts, n, t100)))

    # buckets that still hold several components: their members across components
    rest = (memb.where("cnt > 2").join(lab.select(F.col("node").alias("rep"), "label"), "rep", "left")
            .select("band", "key", "rep", "lo", F.coalesce("label", "rep").alias("l")))
    mixed = rest.groupBy("band", "key").agg(F.min("l").alias("l0"), F.max("l").alias("l1")).where("l0 <> l1").select("band", "key")
    rest = stored(rest.join(mixed, ["band", "key"], "left_semi").join(reps.select("rep", "n", "sk", "ps"), "rep"))
    x = rest.select("band", "key", F.col("rep").alias("a"), F.col("l").alias("la"), F.col("n").alias("na"), F.col("sk").alias("ska"), F.col("ps").alias("psa"))
    y = rest.select("band", "key", F.col("rep").alias("b"), F.col("l").alias("lb"), F.col("n").alias("nb"), F.col("sk").alias("skb"), F.col("ps").alias("psb"))
    # 100 |A n B| >= t |A u B| in terms of the symmetric difference, whose size the popcount never exceeds
    within = (100 + t100) * xor_popcount(F.col("psa"), F.col("psb"), parity_words) <= (100 - t100) * (F.col("na") + F.col("nb"))
    on = ((x["band"] == y["band"]) & (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near & within)
    cross = stored(x.join(y, on).select("a", "b").distinct())
    lab = _merged(lab, stored(confirmed(cross, texts, n, t100)))

    of = (narrow.select("id", "th", "n", "k1", "k2").distinct().join(reps.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], "left")
          .join(lab.select(F.col("node").alias("rep"), "label"), "rep", "left")
          .select(F.col("id").alias("oid"), F.col("th").alias("oth"), F.col("n").alias("n_shingles"),
                  F.coalesce("label", "rep", "id").alias("component_id")))
    out = base.join(of, F.col("id").eqNullSafe(F.col("oid")) & (F.col("th") == F.col("oth")), "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull() & (F.col("n_shingles") >= 0), F.col("component_id")))
    return unpacked(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))), *OUT)
