"""Token-id shards with Re-Pair grammar compression, written, read back and read at random.

Method.  Texts are encoded with the ``tokenizers`` library (a column at a time; its distinct
pre-tokens are looked up once and their ids remembered, see ``pretokens``), an end id is appended to every document,
and the documents are range-partitioned by (id, text hash) into shards of about
``shard_bytes`` of text, sorted so inside each shard.  Every shard is
compressed by Re-Pair: in rounds, up to ``batch`` of the most frequent adjacent
pairs (``min_count`` times or more; pairs whose occurrences cannot overlap) are
replaced by new symbols, until a round saves less than ``min_gain`` of the
sequence.  Pairs are counted by sorting them with their positions; positions of rare pairs are
left out of later rounds unless a symbol there changes.  In the shard the end of a document is a
symbol of its own outside the vocabulary (the end id may be an ordinary token:
0 is '!'), written as the end id when read.  A symbol whose expansion ends with
it never starts a pair, so no rule crosses a document boundary and every
document starts at a symbol boundary.

File format (one Parquet row per shard): ``shard`` (its number in id order),
``n_docs``, ``n_tokens`` (with the end ids), ``doc_ids`` (array), and ``blob``, an
``.npz`` of ``n_tokens`` int64[d] per document, ``coff`` int64[d+1] (document
starts in ``seq``), ``seq`` uint32 (terminals below ``base``, of which ``end[0]``
stands for the end id ``end[1]``; rule ``base + r`` above), ``rules`` uint32[r, 2],
``explen`` int64[r] (expansion lengths).  ``read_token_shards`` decodes each shard
in its own task; ``read_token_ranges`` decodes only the asked positions of the asked documents:
the sums of expansion lengths over a document's symbols say which symbols to
expand.

Starts (tokens of all documents before) come from the per-shard totals in
the file, summed in two levels (blocks of shards, then shards), so no task
sees all of them.

Defined results: null/empty text -> just the end id; null ids ->
last; repeated rows -> stored one after the other; empty table -> no shards,
empty result; input columns other than the two named are not read.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, scratch_path
from .pretokens import pretokens

#: Fixed value: bits of the table of places in ``_disjoint``.
_BITS = 19


def _grouped_pairs(seq: np.ndarray, pos: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that start at the rising positions ``pos`` of ``seq`` (symbols below ``top``) as one number each, in order, and their positions."""
    wide, place = np.uint64(top.bit_length()), np.uint64(len(seq).bit_length())
    key = seq[pos].astype(np.uint64)
    key <<= wide
    key |= seq[pos + 1]
    if 2 * wide + place > 64:  # no room for the position beside the pair
        order = np.argsort(key, kind="stable")
        return key[order], pos[order]
    key <<= place
    key |= pos.astype(np.uint64)
    key.sort()
    pos = (key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    key >>= place
    return key, pos


def _disjoint(xs: list, ys: list, places: list, symbols: int, batch: int) -> list[int]:
    """Which of the pairs to replace at once, the first ones first: up to ``batch`` whose occurrences cannot overlap.

    No symbol is the right of one chosen pair and the left of another (a pair x x only with
    itself), and no two share a place of the table.
    """
    used, role, chosen = bytearray(1 << _BITS), bytearray(symbols), []  # role of a symbol: 1 left, 2 right, 4 both of x x
    for i, (x, y, h) in enumerate(zip(xs, ys, places)):
        if used[h]:
            continue
        if x == y:
            if role[x]:
                continue
            role[x] = 7
        else:
            if role[x] & 6 or role[y] & 5:
                continue
            role[x] |= 1
            role[y] |= 2
        used[h] = 1
        chosen.append(i)
        if len(chosen) >= batch:
            break
    return chosen


def repair(seq: np.ndarray, base: int, end_id: int, min_count: int = 8, batch: int = 16384, min_gain: float = 0.03):
    """Re-Pair on ``seq`` (symbols below 2**31); returns (seq, rules[r,2], explen[r])."""
    seq = seq.astype(np.uint32)
    rules, top = [np.zeros((0, 2), dtype=np.uint32)], base
    explen = np.ones(base, dtype=np.int64)
    stops = np.flatnonzero(seq == end_id)  # where documents end
    live = np.ones(len(seq), dtype=bool)  # positions whose pair may be frequent: a rare pair of old symbols stays rare
    while len(seq) > 1:
        live[stops] = False  # what ends a document starts no pair
        live[-1] = False
        key, pos = _grouped_pairs(seq, np.flatnonzero(live), top)
        start = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
        counts = np.diff(start, append=len(key))
        often = counts >= min_count
        pos = pos[np.repeat(often, counts)]
        keys, counts = key[start[often]], counts[often]
        del key
        order = np.argsort(-counts, kind="stable")[:min(2 * batch, 1 << _BITS)]
        wide = np.uint64(top.bit_length())
        pairs = np.stack((keys >> wide, keys & ((np.uint64(1) << wide) - np.uint64(1))), axis=1).astype(np.uint32)
        xs, ys = pairs[order].T
        chosen = _disjoint(xs.tolist(), ys.tolist(), range(len(order)), top, batch)
        if not chosen:
            break
        number = np.full(len(keys), -1, dtype=np.int32)
        number[order[chosen]] = np.arange(len(chosen))
        xs, ys = xs[chosen], ys[chosen]
        live[:] = False
        live[pos] = True
        new = np.repeat(number, counts)
        hit = np.flatnonzero(new >= 0)
        pos, new = pos[hit], new[hit]
        if (xs == ys).any():  # runs of x x x: every second position from the start of the run
            idx = np.arange(len(pos))
            first = (np.diff(pos, prepend=-2) != 1) | (np.diff(new, prepend=-1) != 0)
            even = (idx - np.maximum.accumulate(np.where(first, idx, 0))) % 2 == 0
            pos, new = pos[even], new[even]
        rules.append(pairs[order[chosen]])
        explen = np.concatenate((explen, explen[xs] + explen[ys]))
        seq[pos] = new + top
        live[pos] = live[pos - 1] = True
        keep = np.ones(len(seq), dtype=bool)
        keep[pos + 1] = False
        stops -= np.searchsorted(np.flatnonzero(~keep), stops, side="right")
        top += len(chosen)
        before, seq, live = len(seq), seq[keep], live[keep]
        if len(pos) < min_gain * before:
            break
    return seq.astype(np.int32), np.concatenate(rules), explen[base:]


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Terminals of a symbol sequence."""
    seq = seq.astype(np.int64)
    while len(seq) and seq.max() >= base:
        nt = seq >= base
        lens = np.where(nt, 2, 1)
        out = np.repeat(seq, lens)
        first = np.cumsum(lens) - lens
        ntpos = first[nt]
        rr = rules[seq[nt] - base].astype(np.int64)
        out[ntpos] = rr[:, 0]
        out[ntpos + 1] = rr[:, 1]
        seq = out
    return seq


def expand_all(seq: np.ndarray, rules: np.ndarray, explen: np.ndarray, base: int) -> np.ndarray:
    """Terminals of a symbol sequence, every rule expanded once."""
    size = np.concatenate((np.ones(base, dtype=np.int64), explen))
    flat = np.concatenate((np.arange(base), expand(np.arange(base, base + len(rules)), rules, base))).astype(np.uint32)
    lens, start = size[seq], (np.cumsum(size) - size)[seq]
    place = np.repeat(start - (np.cumsum(lens) - lens), lens)
    place += np.arange(len(place))
    return flat[place]


def write_token_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                       vocab: str = "byte_bpe_50k.json", end_id: int = 0, shard_bytes: int = 2 << 20,
                       min_count: int = 8) -> None:
    """Encode, shard by id range, compress and write one row per shard to ``path``."""
    sel = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = sel.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    sel = sel.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)

    def shard(batches):
        pre = pretokens(vocab)
        end = pre.tok.get_vocab_size()  # the end of a document: the first symbol after the vocabulary
        base = end + 1
        ids, parts, ntok = [], [], []
        for batch in batches:
            ids.append(batch.column(0))
            tokens, n = pre.encode_column(batch.column(1))
            parts.append(np.insert(tokens, np.cumsum(n), end))
            ntok.append(n + 1)
        if not sum(map(len, ids)):
            return
        ids, ntok, whole = pa.concat_arrays(ids), np.concatenate(ntok), np.concatenate(parts)
        parts.clear()
        total = len(whole)
        seq, rules, explen = repair(whole, base, end, min_count)
        del whole
        # document starts in the compressed sequence: after each symbol that ends a document
        ends = np.zeros(base + len(rules), dtype=bool)
        ends[end] = True
        for r, y in enumerate(rules[:, 1].tolist()):
            ends[base + r] = ends[y]
        coff = np.concatenate(([0], np.nonzero(ends[seq])[0] + 1)).astype(np.int64)
        buf = io.BytesIO()
        np.savez(buf, n_tokens=ntok, coff=coff, seq=seq.astype(np.uint32), rules=rules,
                 explen=explen, base=np.array([base]), end=np.array([end, end_id]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (
            ([TaskContext.get().partitionId()], pa.int64()), ([len(ids)], pa.int64()), ([total], pa.int64()),
            ([ids.to_pylist()], pa.list_(pa.int64())), ([buf.getvalue()], pa.binary()))], names=["shard", "n_docs", "n_tokens", "doc_ids", "blob"])
        del seq, rules, explen, ends, coff, buf
        release_memory(cycles=False)

    sel.mapInArrow(shard, "shard long, n_docs long, n_tokens long, doc_ids array<long>, blob binary").write.mode("overwrite").parquet(path)


def _shard_starts(files: DataFrame, block: int = 4096) -> DataFrame:
    """(shard, shard_start): tokens before each shard, summed over blocks of shards and inside them."""
    t = files.select("shard", "n_tokens", F.floor(F.col("shard") / block).alias("bl"))
    b = t.groupBy("bl").agg(F.sum("n_tokens").alias("bt"))
    b = b.select("bl", (F.sum("bt").over(Window.orderBy("bl")) - F.col("bt")).alias("before"))  # one row per block of shards
    inside = F.sum("n_tokens").over(Window.partitionBy("bl").orderBy("shard")) - F.col("n_tokens")
    return t.select("shard", "bl", inside.alias("inside")).join(b, "bl").select("shard", (F.col("before") + F.col("inside")).alias("shard_start"))


def read_token_shards(spark, path: str) -> DataFrame:
    """Decode every shard; per document: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)

    def dec(batches):
        for batch in batches:
            for i, (no, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                z = np.load(io.BytesIO(blob.as_buffer()))
                end, end_id = z["end"].tolist()
                whole = expand_all(z["seq"], z["rules"], z["explen"], int(z["base"][0]))
                whole[whole == end] = end_id
                raw, ntok = memoryview(whole.astype("<u4", copy=False)).cast("B"), z["n_tokens"]
                cuts = np.concatenate(([0], np.cumsum(ntok)))
                at = cuts.tolist()
                crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, *(pa.array(x, pa.int64()) for x in (np.full(len(ntok), no), cuts[:-1], ntok, crc))],
                                                 names=["doc_id", "shard", "local", "n_tokens", "ids_crc32"])

    rows = (files.select("shard", "doc_ids", "blob")
            .mapInArrow(dec, "doc_id long, shard long, local long, n_tokens long, ids_crc32 long"))
    return (rows.join(_shard_starts(files), "shard")
            .select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"))


def read_token_ranges(spark, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: ``wanted`` (doc_id, lo, hi) -> doc_id, lo, hi, ids (tokens lo to hi - 1 of the document).

    Shards that hold no asked document are not decoded, and of a document only the symbols that
    cover the range are expanded.  A document stored several times gives a row per copy; an unknown
    id gives none; a range is cut to the document's length.
    """
    files = spark.read.parquet(path)
    index = files.select("shard", F.posexplode("doc_ids").alias("place", "doc_id"))
    ask = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    asks = index.join(ask, "doc_id").select("shard", "place", "doc_id", "lo", "hi")
    # the blobs travel to the asks, each with as many asks as one row may hold
    grouped = (asks.withColumn("part", F.pmod(F.xxhash64("doc_id", "lo", "hi"), F.lit(64))).groupBy("shard", "part")
               .agg(F.collect_list(F.struct("place", "doc_id", "lo", "hi")).alias("asks")))

    def dec(batches):
        for pdf in batches:
            for blob, asked in zip(pdf["blob"], pdf["asks"]):
                z = np.load(io.BytesIO(blob))
                seq, rules, base, coff, ntok = z["seq"], z["rules"], int(z["base"][0]), z["coff"], z["n_tokens"]
                (end, end_id), size = z["end"].tolist(), np.concatenate((np.ones(base, dtype=np.int64), z["explen"]))
                out = []
                for a in asked:
                    p = a["place"]
                    lo, hi = max(0, a["lo"]), min(a["hi"], int(ntok[p]))
                    ids = []
                    if lo < hi:
                        doc = seq[coff[p]:coff[p + 1]]
                        upto = np.cumsum(size[doc])  # tokens up to each symbol
                        i, j = np.searchsorted(upto, lo, side="right"), np.searchsorted(upto, hi, side="left")
                        skip = int(upto[i - 1]) if i else 0
                        ids = expand(doc[i:j + 1], rules, base)[lo - skip:hi - skip]
                        ids[ids == end] = end_id
                        ids = ids.tolist()
                    out.append((a["doc_id"], a["lo"], a["hi"], ids))
                yield pd.DataFrame(out, columns=["doc_id", "lo", "hi", "ids"])

    return files.select("shard", "blob").join(grouped, "shard").mapInPandas(dec, "doc_id long, lo long, hi long, ids array<long>")


def token_shards(docs: DataFrame, **kw) -> DataFrame:
    """Write the shards under the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_shards(docs, path, **kw)
    return read_token_shards(docs.sparkSession, path)
