"""Fill-in-middle transformation by counted-quantifier regular expressions.

Method.  A text is a sequence of units, ``[A-Za-z]+|[^A-Za-z]``, matched left
to right over code points.  ``regexp_count`` gives their number ``n``; two
hashes of the id choose cut points ``a <= b`` in ``0..n``.  One pattern per row,
built by ``format_string``, takes the units in a single match: ``unit{a}`` and
``unit{b-a}`` as possessive groups (a possessive counted group is matched in a
loop without backtracking, so a text of a million units needs no deep stack)
and the rest.  ``regexp_replace`` with the three groups in the order of the
form writes the output in that same match:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* ``plain``: the text as it is (empty, holding one of the marks, or not chosen).

Everything is one projection of JVM expressions: no shuffle, no Python.

Cut points and forms come from ``h1..h4``, the first four 8-digit groups of
the hex sha256 of ``1:`` followed by the decimal id.

Defined results: null text -> empty -> plain; null id -> the hash of ``1:``
alone; repeated rows -> equal results; empty table -> empty; input columns with
the output names are replaced, other names cannot clash (the input row is kept
in one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

UNIT = "[A-Za-z]+|[^A-Za-z]"
MARK = "<[PSM]>"
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")
_GROUP = "((?:[A-Za-z]++|[^A-Za-z]){%d}+)"
_ORDER = {"psm": "<P>$1<S>$3<M>$2", "spm": "<S>$3<P>$1<M>$2"}


def pieces(output: Column, form: Column) -> Column:
    """(prefix, middle, suffix) of an output that is not plain."""
    cut = F.split(output, MARK, -1)
    spm = form == "spm"
    return F.struct(F.when(spm, cut[2]).otherwise(cut[1]).alias("prefix"), cut[3].alias("middle"),
                    F.when(spm, cut[1]).otherwise(cut[2]).alias("suffix"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    p = pieces(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(p["prefix"], p["middle"], p["suffix"]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_pct: int = 90,
                   spm_pct: int = 20) -> DataFrame:
    """Input rows plus n, form, prefix_chars, middle_chars and output (the transformed text)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    d = packed(docs, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), digest.alias("digest"), drop=OUT)
    d = d.select("row", "t", F.regexp_count("t", F.lit(UNIT)).alias("n"),
                 *[F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    p, q = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    d = d.select("row", "t", "n", F.least(p, q).alias("a"), F.greatest(p, q).alias("b"),
                 F.when((F.col("t") == "") | F.col("t").rlike(MARK) | (F.col("h3") % 100 >= fim_pct), "plain")
                 .when(F.col("h4") % 100 < spm_pct, "spm").otherwise("psm").alias("form"))
    pattern = F.format_string(rf"(?s)\A{_GROUP}{_GROUP}(.*)\z", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", _ORDER["spm"]).otherwise(_ORDER["psm"])
    d = d.select("row", F.col("n").cast("long").alias("n"), "form",
                 F.when(F.col("form") == "plain", F.col("t")).otherwise(F.regexp_replace("t", pattern, order)).alias("output"))
    made = F.col("form") != "plain"
    cut = pieces(F.col("output"), F.col("form"))
    d = d.withColumns({"prefix_chars": F.when(made, F.length(cut["prefix"])).cast("long"),
                       "middle_chars": F.when(made, F.length(cut["middle"])).cast("long")})
    return unpacked(d, *OUT)
