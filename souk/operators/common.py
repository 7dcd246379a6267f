"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_or_null(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Project ``schema`` (name -> type); columns absent from ``df`` are typed NULLs.

    Entity tables are optional-column friendly: the shop probes for
    columns at run time, here the frame's own column list is the probe.
    """
    cols = []
    for name, typ in schema.items():
        if name in df.columns:
            cols.append(F.col(name).cast(typ).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return df.select(*cols)


def has_cols(df: DataFrame | None, *names: str) -> bool:
    return df is not None and all(n in df.columns for n in names)


# ---------------------------------------------------------------------------
# Total orders: positions without a single-task window, a checkpoint or a job
# ---------------------------------------------------------------------------
class Key:
    """One sort key: a column name, its direction and where NULLs go."""

    def __init__(self, name: str, ascending: bool = True, nulls_first: bool | None = None):
        self.name, self.ascending = name, ascending
        # PostgreSQL's defaults: NULLs last ascending, first descending
        self.nulls_first = (not ascending) if nulls_first is None else nulls_first

    def expr(self) -> Column:
        c = F.col(self.name)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


def asc(name: str, nulls_first: bool | None = None) -> Key:
    return Key(name, True, nulls_first)


def desc(name: str, nulls_first: bool | None = None) -> Key:
    return Key(name, False, nulls_first)


def _reversed(c: Column, typ) -> Column:
    """A value that sorts ascending where ``c`` sorts descending."""
    name = typ.typeName()
    if name in ("byte", "short", "integer", "long"):
        return F.bitwise_not(c.cast("long"))
    if name == "boolean":
        return ~c
    if name == "date":
        return F.bitwise_not(F.unix_date(c))
    if name in ("timestamp", "timestamp_ntz"):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp_ltz")))
    if name == "decimal" or name in ("double", "float"):
        return -c
    raise ValueError(f"no descending range key for {name}")


def ascending_key(df: DataFrame, order: list[Key]) -> Column:
    """One struct that sorts ascending as ``order`` does."""
    parts = []
    for k in order:
        c = F.col(k.name)
        parts += [c.isNotNull() if k.nulls_first else c.isNull(),
                  c if k.ascending else _reversed(c, df.schema[k.name].dataType)]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def range_bucket(df: DataFrame, order: list[Key], ranges: int = 1024, name: str = "_bucket",
                 keys: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the number of the key range a row falls into; ranges follow ``order``.

    The bounds are a sample of the keys themselves: those whose hash is 0
    modulo (rows / ranges), about ``ranges`` keys, sorted in one row.  Which keys
    are sampled depends on the keys alone, so every evaluation of the plan (and every
    retry) gets the same ranges and no materialised copy is needed.  Each row
    finds its range by binary search.  ``order`` must end in a unique key; then a range holds about
    rows / ranges rows however the first key is distributed.

    ``keys``: a frame with the key columns to take the bounds from, where ``df`` is costly and
    a table it comes from is spread alike; any bounds are right, they only balance.
    """
    src = df if keys is None else keys
    keys = src.select(ascending_key(src, order).alias("_k"))
    n = keys.agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"_n div {ranges}"))
    bounds = (keys.crossJoin(F.broadcast(n)).where(F.pmod(F.xxhash64("_k"), step) == 0)
              .agg(F.sort_array(F.collect_list("_k")).alias("_b")))  # about ``ranges`` keys
    jumps = F.array(*[F.lit(1 << i) for i in range((4 * ranges).bit_length(), -1, -1)])
    found = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(
        (at + jump <= F.size("_b")) & (F.get(F.col("_b"), at + jump - 1) < F.col("_k")), at + jump).otherwise(at))
    return (df.withColumn("_k", ascending_key(df, order)).crossJoin(F.broadcast(bounds))
            .withColumn(name, found).drop("_k", "_b"))


def _range_starts(df: DataFrame, order: list[Key], ranges: int, keys: DataFrame | None = None) -> DataFrame:
    """(_bucket, _n, _start): rows of each range and rows before it; one row per range."""
    from pyspark.sql import Window as W
    narrow = df.select(*dict.fromkeys(k.name for k in order))
    counts = range_bucket(narrow, order, ranges, keys=keys).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_start", F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n"))


def global_position(df: DataFrame, order: list[Key], name: str = "_pos", ranges: int = 1024,
                    keys: DataFrame | None = None) -> DataFrame:
    """Add ``name``: 0-based position of each row in the total order ``order``.

    Rows per key range (``range_bucket``), a running sum over the ranges (at most
    a few thousand rows, broadcast) and a row number inside each range: no
    task sees more than a range, nothing runs while the frame is built, and
    nothing is written.  ``order`` must end in a unique key.  ``df`` is evaluated
    twice (counts, rows); the bounds come from ``keys`` where given.
    """
    from pyspark.sql import Window as W
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*[k.expr() for k in order])) - 1
    return (range_bucket(df, order, ranges, keys=keys).withColumn("_in", inside)
            .join(F.broadcast(_range_starts(df, order, ranges, keys).drop("_n")), "_bucket")
            .withColumn(name, (F.col("_start") + F.col("_in")).cast("long"))
            .drop("_bucket", "_in", "_start"))


def page(df: DataFrame, order: list[Key], page_no: int, limit: int, name: str = "position",
         ranges: int = 1024) -> DataFrame:
    """Rows ``[(page_no-1)*limit, page_no*limit)`` of ``df`` in ``order``, with their 0-based ``name``.

    One path for pages of every size: rows are counted per key range, only
    the ranges that overlap the page are shuffled and sorted, and positions
    are cut.  ``order`` must end in a unique key.
    """
    from pyspark.sql import Window as W
    lo = (page_no - 1) * limit
    hi = lo + limit
    hit = _range_starts(df, order, ranges).where((F.col("_start") < hi) & (F.col("_start") + F.col("_n") > lo))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*[k.expr() for k in order])) - 1
    return (range_bucket(df, order, ranges).join(F.broadcast(hit.drop("_n")), "_bucket").withColumn("_in", inside)
            .withColumn(name, (F.col("_start") + F.col("_in")).cast("long"))
            .where((F.col(name) >= lo) & (F.col(name) < hi)).drop("_bucket", "_in", "_start"))
