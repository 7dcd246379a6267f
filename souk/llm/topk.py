"""Exact top-k inner-product search by distributed histogram selection.

Method.  Components become ``floor(scale * x)`` integers; vectors that are
null or hold a null or non-finite component take no part.  Every task packs its
rows into blocks (up to ``qblock`` / ``cblock`` vectors as one binary row, a block
holds vectors of one length), stored by a reliable checkpoint: no group of rows
with one id or one content has to meet in a task.  Query blocks are
replicated over ``groups`` of candidate blocks and joined by group number (a
stated query set against all rows, in blocks); each pair of blocks is scored
exactly with one integer-valued matrix product.

Rounds: the scores lie in ``[-R, R]`` with R the largest squared norm.  The first
round counts every query's scores in at most ``2**bits`` bins over that range; a
grouped sum over all pairs gives the global histogram, and the bin that holds
the k-th best value is located per query.  Each further round scores again and
splits the located bin into ``2**bits`` finer ones, until bins are one score wide: the
k-th value ``t`` and the number of scores above it.  (A pair leaves out bins
below its own k-th value: they cannot hold the global one.)  The last pass keeps the rows above
``t`` and, of those equal to ``t``, the smallest ids; a row number over (score
desc, id asc) per query keeps k.  Ties therefore go to smaller ids.

Output: query_id, rank (from 1), vec_id, score.  Defined results: fewer
than k candidates -> all; no valid vector -> empty; vectors are compared with
those of their own length only; an empty vector scores 0; repeated ids are
separate rows, none a candidate of its own id; null ids take no part; squared
norms stay below 2**62.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_BLOCK = "dim long, block long, n long, norm long, ids binary, vecs binary"


def _pack(vecs: DataFrame, size: int, scale: int) -> DataFrame:
    """(vid, v) rows packed into blocks of up to ``size`` integer vectors of one length."""

    def run(batches):
        open_: dict[int, list] = {}

        def block(dim, parts):
            ids = np.concatenate([i for i, _ in parts])
            q = np.concatenate([v for _, v in parts])
            norm = int((q.astype(object) ** 2).sum(axis=1).max()) if np.abs(q).max(initial=0) > 1 << 24 else int((q * q).sum(axis=1).max(initial=0))
            if norm >= 1 << 62:
                raise ValueError("squared norms of 2**62 and more are not supported")
            name = int(np.bitwise_xor.reduce(ids * np.int64(0x9E3779B1) + np.arange(len(ids)))) ^ (len(ids) << 40)
            return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([name]), pa.array([len(ids)]), pa.array([norm]),
                                               pa.array([ids.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())],
                                              names=["dim", "block", "n", "norm", "ids", "vecs"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = b.column(1)
            flat, off = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            lens = np.diff(off)
            for dim in np.unique(lens):
                rows = np.flatnonzero(lens == dim)
                x = flat[(off[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                q = np.floor(scale * x)
                ok = (np.abs(q) < 2.0 ** 62).all(axis=1)
                if not ok.all():
                    raise ValueError("components beyond 2**62 are not supported")
                parts = open_.setdefault(int(dim), [])
                parts.append((ids[rows], q.astype(np.int64)))
                while sum(len(i) for i, _ in parts) >= size:
                    i, v = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
                    yield block(int(dim), [(i[:size], v[:size])])
                    parts[:] = [(i[size:], v[size:])]
        for dim, parts in open_.items():
            if sum(len(i) for i, _ in parts):
                yield block(dim, parts)

    return vecs.mapInArrow(run, _BLOCK)


def _scores(q: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """Inner products, exact: in the narrowest type that holds every partial sum."""
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int32 if top < 1 << 30 else np.int64)


def _pairs(b: pa.RecordBatch):
    """Per block pair: (qblock, query ids, candidate ids, scores, state rows)."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    for r in range(len(b)):
        dim = col["dim"][r].as_py()
        qi, ci = (np.frombuffer(col[k][r].as_py(), dtype=np.int64) for k in ("qids", "ids"))
        q, c = (np.frombuffer(col[k][r].as_py(), dtype=np.int64).reshape(len(i), dim) for k, i in (("qvecs", qi), ("vecs", ci)))
        s = col["state"][r].as_py()
        pos, lo, above = (np.array([x[k] for x in s], dtype=np.int64) for k in ("pos", "lo", "above"))
        top = int(np.sqrt(float(col["qnorm"][r].as_py())) * np.sqrt(float(col["norm"][r].as_py()))) + 1
        yield col["qblock"][r].as_py(), qi[pos], ci, _scores(q[pos], c, top), pos, lo, above


def exact_topk(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, query_every: int = 20,
               scale: int = 64, qblock: int = 512, cblock: int = 4096, group_blocks: int = 4, bits: int = 10) -> DataFrame:
    spark = vecs.sparkSession
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.col("vid").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vecs.select(F.col(f"`{id_col}`").cast("long").alias("vid"), v.alias("v")).where(ok)
    cand = cut(_pack(rows, cblock, scale))
    queries = cut(_pack(rows.where(F.col("vid") % query_every == 0), qblock, scale))
    n_blocks, norm = cand.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = -(-n_blocks // group_blocks)
    cand = cand.withColumn("g", F.pmod(F.xxhash64("block", "n"), F.lit(groups)))
    # two blocks of the same rows get the same name only if they are equal: then each is numbered apart
    queries = queries.select(F.col("dim").alias("qdim"), F.xxhash64("ids", "vecs", "block").alias("qblock"), F.col("n").alias("qn"),
                             F.col("norm").alias("qnorm"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
    twin = Window.partitionBy("qblock").orderBy("qn")
    queries = cut(queries.withColumn("qblock", F.xxhash64("qblock", F.row_number().over(twin))))

    def paired(state: DataFrame) -> DataFrame:
        st = state.groupBy("qblock").agg(F.collect_list(F.struct("pos", "lo", "above")).alias("state"))  # at most qblock rows each
        q = queries.join(st, "qblock").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        c = cand.select("g", "dim", "norm", "ids", "vecs")
        return (q.join(c, (q["g"] == c["g"]) & (q["qdim"] == c["dim"]))
                .select("qblock", "qids", "qvecs", "qnorm", "state", "dim", "norm", "ids", "vecs"))

    state = queries.select("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)).alias("pos"),
                           F.lit(-int(norm)).cast("long").alias("lo"), F.lit(0).cast("long").alias("above"))
    shift = max(0, (2 * int(norm)).bit_length() - bits)
    n_bins = ((2 * int(norm)) >> shift) + 1
    while True:
        state = _refine(paired(state), k, shift, n_bins)
        if shift == 0:
            break
        finer = max(0, shift - bits)
        shift, n_bins = finer, 1 << (shift - finer)

    def pick(batches):
        for b in batches:
            for name, qi, ci, s, pos, t, above in _pairs(b):
                r, c = np.nonzero((s >= t[:, None]) & (qi[:, None] != ci[None, :]))
                score = s[r, c].astype(np.int64)
                at = score == t[r]
                # of the scores equal to t the smallest ids, as many as the query still needs
                order = np.lexsort((ci[c], ~at, r))
                r, c, score, at = r[order], c[order], score[order], at[order]
                first = np.searchsorted(r, np.arange(len(qi)))
                keep = ~at | (np.arange(len(r)) - first[r] < (k - above)[r])
                r, c, score = r[keep], c[keep], score[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), name), pa.int64()), pa.array(pos[r]), pa.array(qi[r]),
                                                  pa.array(ci[c]), pa.array(score)], names=["qblock", "pos", "query_id", "vec_id", "score"])

    found = paired(state).mapInArrow(pick, "qblock long, pos long, query_id long, vec_id long, score long")
    w = Window.partitionBy("qblock", "pos").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _refine(pairs: DataFrame, k: int, shift: int, n_bins: int) -> DataFrame:
    """One histogram round: the bin of the k-th value per query becomes its new range (lo, scores above it)."""

    def count(batches):
        for b in batches:
            for name, qi, ci, s, pos, lo, above in _pairs(b):
                bins = (s.astype(np.int64) - lo[:, None]) >> shift
                inside = (bins >= 0) & (bins < n_bins) & (qi[:, None] != ci[None, :])
                place = bins + (np.arange(len(qi)) * n_bins)[:, None]
                c = np.bincount(place[inside], minlength=len(qi) * n_bins).reshape(len(qi), n_bins)
                before = np.cumsum(c[:, ::-1], axis=1)[:, ::-1] - c  # in this pair, above each bin
                r, j = np.nonzero((c > 0) & (before < (k - above)[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), name), pa.int64()), pa.array(pos[r]), pa.array(lo[r]), pa.array(above[r]),
                     pa.array(j.astype(np.int64)), pa.array(c[r, j].astype(np.int64))], names=["qblock", "pos", "lo", "above", "bin", "c"])

    h = pairs.mapInArrow(count, "qblock long, pos long, lo long, above long, bin long, c long")
    h = h.groupBy("qblock", "pos", "lo", "above", "bin").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("qblock", "pos").orderBy(F.col("bin").desc())
    h = h.withColumn("before", F.sum("c").over(w) - F.col("c")).where(F.col("before") < k - F.col("above"))
    # the last such bin holds the k-th value (or, with fewer candidates than k, the lowest score)
    return (h.groupBy("qblock", "pos").agg(F.min("bin").alias("bin"), F.max("before").alias("before"), F.first("lo").alias("l"), F.first("above").alias("a"))
            .select("qblock", "pos", (F.col("l") + F.col("bin") * (1 << shift)).alias("lo"), (F.col("a") + F.col("before")).alias("above")))
