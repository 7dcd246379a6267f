"""Writing results: JSON documents and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_ready(c: Column, typ: T.DataType) -> Column:
    """A column as a web shop's JSON has it: money as text with its decimals, times as
    ISO text with milliseconds and ``Z``, dates as ``yyyy-MM-dd``, inside arrays and structs too."""
    if isinstance(typ, T.DecimalType):
        return c.cast("string")
    if isinstance(typ, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(typ, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(typ, T.ArrayType):
        return F.transform(c, lambda x: json_ready(x, typ.elementType))
    if isinstance(typ, T.StructType):
        inner = F.struct(*[json_ready(c[f.name], f.dataType).alias(f.name) for f in typ.fields])
        return F.when(c.isNotNull(), inner)
    return c


def documents(df: DataFrame, key: str | None = None, name: str = "document") -> DataFrame:
    """Every row as one JSON text (columns in order, NULL fields kept), next to its ``key``."""
    body = F.struct(*[json_ready(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(*([key] if key else []), F.to_json(body, {"ignoreNullFields": "false"}).alias(name))


def report_document(sections: dict[str, DataFrame], lists: dict[str, list[str]], name: str = "document") -> DataFrame:
    """One JSON text of several small results: a section with an entry in ``lists`` is an array
    sorted by those columns, any other one an object (its only row).

    For reports: every list section is bounded by its report (days of a period, a top k, categories).
    """
    out = None
    for section, df in sections.items():
        body = F.struct(*[json_ready(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
        if section in lists:
            row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(lists[section])], body.alias("_body"))
            part = df.agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_body"]).alias("_v"))
        else:
            part = df.agg(F.first(body).alias("_v"))  # no row: null
        part = part.select(F.to_json("_v", {"ignoreNullFields": "false"}).alias(section))
        out = part if out is None else out.crossJoin(part)
    fields = [F.concat(F.lit(f'"{s}":'), F.coalesce(F.col(s), F.lit("null"))) for s in sections]
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias(name))


def append_batch(df: DataFrame, path: str, batch_id: str, batch_col: str = "batch_id") -> None:
    """Append a batch to a table once: the batch's partition is replaced, the others stay.

    Writing the same batch again (a retry, a replay after a failure) changes
    nothing; an empty batch writes nothing.
    """
    (df.withColumn(batch_col, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch_col).parquet(path))
