"""Quality rules: a learned decision list over text statistics.

Method.  Every whole text becomes one row of counts (``text_counts``, one Arrow
pass) and the ratios of ``features`` (column expressions).  The list is learned
by sequential covering from the statistics of labelled rows:

1. grow: on two thirds of the rows that no rule covers yet, threshold conditions
   are added one at a time, each the one with the largest FOIL gain, until no
   row of the other class is covered or no condition gains;
2. prune: on the last third, trailing conditions are dropped while
   ``(p - n) / (p + n)`` does not fall;
3. the rule is kept when it is right for at least ``min_precision`` of what it
   covers in both parts (with ``min_cover`` rows or more); rows it covers
   leave, and the next rule is grown.  The list ends with the other class.

``RuleList.verdict`` emits the list as one ordered Spark conditional (when ...
when ... otherwise), ``RuleList.lines`` as readable text.

Base statistics: ``n_words``, ``word_chars`` (code points in words),
``n_symbols`` (characters of ``[#*$%&|<>]``), ``n_dup_lines`` (lines holding a
word that equal an earlier line), ``n_repeat_words`` (words inside a 5-word
window that occurs twice or more in the text, the first one included).
``base_failed``: fewer than ``min_words`` words or more than ``max_repeat_pct``
per cent repeated words.  ``kept``: not failed and not caught by the list.

Fit sample: at most ``max_train`` labelled rows (the smallest hashes of their
ids), of which those with ``crc32(id) % 5 == 0`` are held out.  A bounded,
documented sample; everything else covers every row.

Defined results: null/empty text -> all counts 0, base_failed; null id -> scored
like any row; repeated rows -> equal results; several labels for one id -> the
smallest; no labelled rows -> an empty list (only the base rule decides);
empty table -> empty; input columns with the output names are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
#: Word separators, the symbol class.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
          "n_upper", "n_digits", "n_stops", "n_marks", "n_short", "n_same_next")


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Positions of ``ids`` inside a window of ``width`` that occurs at least twice (exact)."""
    n = len(ids)
    if n <= width:
        return 0
    names = ids.astype(np.int64)
    for j in range(1, width):  # names of the windows of 2, 3, ... words
        pair = names[: n - j] * (int(ids.max()) + 1) + ids[j:]
        _, names, times = np.unique(pair, return_inverse=True, return_counts=True)
        if times.max() < 2:
            return 0  # no shorter window repeats, so no longer one does
    starts = np.flatnonzero(times[names] >= 2)
    ends = np.minimum(np.append(starts[1:], n), starts + width)
    return int((ends - starts).sum())


def count_text(text: str | None) -> tuple:
    """The counts of one text, in the order of ``COUNTS``."""
    t = text or ""
    words = _WORD.findall(t)
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    seen, lines, dup = set(), 0, 0
    for line in t.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_counts = np.bincount(cp[cp < 128], minlength=128)
    at = lambda chars: int(sum(ascii_counts[ord(c)] for c in chars))
    chars = [len(w) for w in words]
    return (n, sum(chars), at(SYMBOLS), dup, repeated_words(ids) if len(known) < n else 0, lines, len(known),
            int(ascii_counts[65:91].sum()), int(ascii_counts[48:58].sum()), at(".!?"), at("!?"), sum(c <= 3 for c in chars),
            int((ids[1:] == ids[:-1]).sum()))


def text_counts(text: Column) -> Column:
    """Struct of ``COUNTS`` of a text column."""

    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return F.pandas_udf(counts, ", ".join(f"{c} long" for c in COUNTS))(text)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))




def features() -> dict[str, Column]:
    """Name -> expression over the counts; the conditions of the rules are on these."""
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"), "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"), "distinct_share": _share("n_distinct", "n_words"),
        "upper_share": _share("n_upper", "word_chars"), "digit_share": _share("n_digits", "word_chars"),
        "stops_per_word": _share("n_stops", "n_words"), "marks_per_word": _share("n_marks", "n_words"),
        "short_share": _share("n_short", "n_words"), "same_next_share": _share("n_same_next", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class RuleList:
    """Rules for the target class in order; whatever none covers is of the other class."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, of: dict[str, Column]) -> Column:
        """True where a rule of the list covers the row: one ordered conditional expression."""
        out = None
        for rule in self.rules:
            hit = reduce(lambda a, b: a & b, [c.column(of) for c in rule])
            out = F.when(hit, True) if out is None else out.when(hit, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x, names) for c in rule])
        return out

    def lines(self) -> list[str]:
        return ["if " + " and ".join(map(str, r)) for r in self.rules]


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain for y over the rows given."""
    big_p, big_n = float(y.sum()), float((~y).sum())
    base = np.log2(big_p / (big_p + big_n)) if big_p else 0.0
    best, pick = 1e-9, None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, p = x[order, j], np.cumsum(y[order])
        edge = np.flatnonzero(v[1:] > v[:-1])  # thresholds lie between different values
        if not len(edge):
            continue
        low_p, low_n = p[edge].astype(float), (edge + 1 - p[edge]).astype(float)
        for above, (cp, cn) in ((False, (low_p, low_n)), (True, (big_p - low_p, big_n - low_n))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - base), -1.0)
            i = int(gain.argmax())
            if gain[i] > best:
                best, pick = float(gain[i]), Condition(name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2))
    return best, pick


def learn(x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = 24, max_conditions: int = 4,
          min_precision: float = 0.85, min_cover: int = 3, seed: int = 11) -> RuleList:
    """Sequential covering of the rows with ``y`` (bool) by threshold conjunctions."""
    rng = np.random.default_rng(seed)
    left, out = np.arange(len(y)), RuleList()
    covered = lambda rule, rows: np.logical_and.reduce([c.holds(x[rows], names) for c in rule])
    misses = 0
    while len(out.rules) < max_rules and y[left].sum() >= min_cover and misses < 3:
        deal = rng.permutation(left)
        grow, prune = deal[: (2 * len(deal) + 2) // 3], deal[(2 * len(deal) + 2) // 3:]
        rule, rows = [], grow
        while len(rule) < max_conditions and 0 < y[rows].sum() < len(rows):
            gain, c = _best_condition(x[rows], y[rows], names)
            if c is None:
                break
            rule.append(c)
            rows = rows[c.holds(x[rows], names)]
        worth = {}
        for k in range(1, len(rule) + 1):
            hit = covered(rule[:k], prune)
            p = int(y[prune][hit].sum())
            worth[k] = (2 * p - hit.sum()) / hit.sum() if hit.any() else -1.0
        if worth:
            rule = rule[: max(worth, key=lambda k: (worth[k], -k))]
        hit = covered(rule, left) if rule else np.zeros(len(left), dtype=bool)
        good = int(y[left][hit].sum())
        if good >= min_cover and good >= min_precision * hit.sum():
            out.rules.append(rule)
            left, misses = left[~hit], 0
        else:
            misses += 1  # another deal of grow and prune rows
    return out


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, counts..., s: the features) of every row."""
    d = packed(docs, F.col(f"`{text_col}`").alias("t"), drop=OUT)
    d = d.select("row", text_counts(F.col("t")).alias("c")).select("row", "c.*")
    return d.select("row", *COUNTS, F.struct(*[e.alias(k) for k, e in features().items()]).alias("s"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_train: int = 20000, **params) -> RuleList:
    """The list for rows labelled 0, from at most ``max_train`` labelled rows."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("id").cast("string")) % 5 != 0))
           .groupBy("id").agg(F.min("y").alias("y"))
           .orderBy(F.xxhash64("id"), "id").limit(max_train))
    text = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
            .join(F.broadcast(lab), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    rows = with_statistics(text, "text").select("row.id", "row.y", "s").collect()  # at most max_train rows
    names = list(features())
    rows.sort(key=lambda r: (r["id"] is None, r["id"]))
    x = np.array([[r["s"][k] for k in names] for r in rows], dtype=float).reshape(-1, len(names))
    return learn(x, np.array([r["y"] == 0 for r in rows], dtype=bool), names, **params)


def quality_rules(docs: DataFrame, rules: RuleList, text_col: str = "text", min_words: int = 10,
                  max_repeat_pct: int = 20) -> DataFrame:
    """Input rows plus the base statistics, base_failed and kept."""
    d = with_statistics(docs, text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    d = d.withColumn("kept", ~F.col("base_failed") & ~rules.verdict({k: F.col(f"s.{k}") for k in features()}))
    return unpacked(d, *OUT)
