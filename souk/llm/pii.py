"""Format-preserving pseudonyms for personal values by keyed Feistel permutations.

Method.  Candidates are found by shape and validated (``KINDS``): payment cards
by the Luhn digit, IBANs by mod 97, social security numbers by their blocked
ranges, IPv4 octets, calendar dates, phone numbers by digit count, mail
addresses, and values assigned to a secret's name.  A valid value's symbols (digits, letters,
hex digits, octets, a day number) are permuted inside the set of all values of
its format by an alternating Feistel network over the two halves of its symbol
list, with a keyed BLAKE2b round function; check digits are made anew, and a
result outside the valid set is permuted again (cycle walking).  A permutation
maps different values to different values, so one value has one pseudonym
in every document, and with the key ``reveal`` takes it back.  What is not valid
(an order number that fails the Luhn test, the 31st of February) stays as it is.

Separators, case, country codes and top-level domains stay.  Equality is that of the
value, not of its spelling: ``+1 (017) 555-7713`` and ``017-555-7713`` get the same
digits, an address in capitals the same letters in capitals, one day written
in two date formats the same day.

One projection with an Arrow batch function over the text; no join, no shuffle:
the key alone links documents.

Defined results: null text -> null text, no values; empty text -> empty; values are
found in the whole text; overlapping candidates: the leftmost, then the first
kind in ``KINDS``; repeated rows -> equal results; empty table -> empty; input columns
with the output names other than ``text`` are replaced.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

ROUNDS = 10
MONTHS = [m.lower() for m in calendar.month_name[1:]]
_MONTH = "(?i:" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS) + ")"


def _either(shape: str, seps: str) -> str:
    """``shape`` once per separator: the same one all through a value."""
    return "|".join(shape.replace("_", re.escape(c)) for c in seps)


#: Kind -> shape of a candidate, in order of precedence (no groups but the secret's value).
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?)(?P<value>[A-Za-z0-9_+/-]{8,})",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ip": r"(?<!\w)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<!\w)(?<!\d[./-])(?:" + _either(r"\d{4}_\d{1,2}_\d{1,2}", "-/.") + "|" + _either(r"\d{1,2}_\d{1,2}_\d{4}", "-/.")
            + rf"|{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|\d{{1,2}}\.? {_MONTH}\.? \d{{4}})(?!\w|[/-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    "phone": r"(?<![\w+(])(?<!\d[.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|" + _either(r"\d{3}_\d{3}_\d{4}", " .-")
             + r")(?!\w|-\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w|-\d)",
    "card": r"(?<!\w)(?<!\d[.,-])(?:\d{13,19}|" + _either(r"\d{4}_\d{4}_\d{4}_\d{1,7}", " -") + "|" + _either(r"\d{4}_\d{6}_\d{5}", " -")
            + r")(?!\w|[.,-]\d)",
}
COUNTS = tuple(f"n_{k}" for k in KINDS)
OUT = (*COUNTS, "n_values")
_CANDIDATE = re.compile("|".join(f"(?P<{kind}>{shape})" for kind, shape in KINDS.items()))
_HINT = re.compile(r"\d|@|(?i:secret|token|key|passw|pwd)")
_FIRST, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def luhn(digits: str) -> str:
    """Check digit of ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i + 1) % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_rest(country: str, account: str) -> str:
    """Check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def permute(values: list[int], radix: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """Keyed permutation of the mixed-radix number ``values`` by alternating Feistel rounds on its two halves."""
    half = (len(values) + 1) // 2
    size = [1, 1]
    num = [0, 0]
    for i, (v, r) in enumerate(zip(values, radix)):
        side = i >= half
        num[side], size[side] = num[side] * r + v, size[side] * r
    for r in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
        a = r % 2
        h = blake2b(f"{tweak}|{r}|{num[1 - a]}|{size[0]}|{size[1]}".encode(), key=key, digest_size=64).digest()
        f = int.from_bytes(h, "big")
        num[a] = (num[a] + (-f if back else f)) % size[a]
    out = []
    for side, part in ((1, radix[half:]), (0, radix[:half])):
        digits = []
        for r in reversed(part):
            digits.append(num[side] % r)
            num[side] //= r
        out = digits[::-1] + out
    return out


def _digits(s: str, key: bytes, kind: str, back: bool, valid=lambda d: True) -> str:
    """Permutes a digit string inside the ``valid`` ones (cycle walking)."""
    d = [int(c) for c in s]
    while True:
        d = permute(d, [10] * len(d), key, kind, back)
        if valid("".join(map(str, d))):
            return "".join(map(str, d))


def _letters(s: str, key: bytes, kind: str, back: bool) -> str:
    """Permutes the letters and digits of a lower-case string class by class; a secret of 16 hex digits or more inside those."""
    if kind == "secret" and len(s) >= 16 and all(c in "0123456789abcdef" for c in s):
        return "".join("0123456789abcdef"[v] for v in permute([int(c, 16) for c in s], [16] * len(s), key, kind, back))
    at = [i for i, c in enumerate(s) if c.isascii() and c.isalnum()]
    v = [ord(s[i]) - (48 if s[i].isdigit() else 97) for i in at]
    out = list(s)
    for i, x in zip(at, permute(v, [10 if s[i].isdigit() else 26 for i in at], key, kind, back)):
        out[i] = chr(x + (48 if s[i].isdigit() else 97))
    return "".join(out)


def _like(new: str, old: str) -> str:
    """``new`` (lower case) with the capitals of ``old``: place by place, or all where old has no small letter."""
    if old.upper() == old:
        return new.upper()
    return "".join(c.upper() if o.isupper() else c for c, o in zip(new, old))


def _refill(old: str, digits: str, skip: int = 0) -> str:
    """``old`` with its digits after the first ``skip`` ones replaced in order."""
    it, seen, out = iter(digits), 0, []
    for c in old:
        if c.isdigit():
            seen += 1
            out.append(c if seen <= skip else next(it))
        else:
            out.append(c)
    return "".join(out)


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _day(date: dt.date, key: bytes, back: bool) -> dt.date:
    """Another day of 1900 to 2099, after the 12th of its month where ``date`` is (so d/m/y keeps its reading)."""
    n = (date - _FIRST).days
    while True:
        a, b = permute([n // 271, n % 271], [270, 271], key, "date", back)
        n = a * 271 + b
        if n < _DAYS and ((new := _FIRST + dt.timedelta(days=n)).day > 12) == (date.day > 12):
            return new


def _date(s: str, key: bytes, back: bool) -> str | None:
    """A valid date's pseudonym in the same notation (numbers only: year, month, day; else day first, or month first where
    the second number is above 12)."""
    nums = re.findall(r"\d+", s)
    name = re.search("[A-Za-z]{3,}", s)
    try:
        if name:
            month = [m[:3] for m in MONTHS].index(name.group().lower()[:3]) + 1
            date = dt.date(int(nums[1]), month, int(nums[0]))
        elif len(nums[0]) == 4:
            date = dt.date(*map(int, nums))
        else:
            swap = int(nums[1]) > 12
            date = dt.date(int(nums[2]), int(nums[not swap]), int(nums[swap]))
        if not 0 <= (date - _FIRST).days < _DAYS:
            return None
    except ValueError:
        return None
    new = _day(date, key, back)
    day, month, year = f"{new.day:0{len(nums[-1]) if len(nums[0]) == 4 else len(nums[0])}d}", f"{new.month:02d}", f"{new.year:04d}"
    if name:
        word = MONTHS[new.month - 1] if len(name.group()) > 3 else MONTHS[new.month - 1][:3]
        word = word.upper() if name.group().isupper() else word.capitalize() if name.group()[0].isupper() else word
        it = iter((day, year))
        return "".join(word if p == name.group() else next(it) if p.isdigit() else p for p in re.split(rf"({name.group()}|\d+)", s))
    if len(nums[0]) == 4:
        order = (year, f"{new.month:0{len(nums[1])}d}", day)
    else:
        month = f"{new.month:0{len(nums[not swap])}d}"
        day = f"{new.day:0{len(nums[swap])}d}"
        order = (month, day, year) if swap else (day, month, year)
    it = iter(order)
    return re.sub(r"\d+", lambda m: next(it), s)


def pseudonym(kind: str, s: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value of ``kind``, or None where it is not a valid one."""
    if kind == "card":
        d = re.sub(r"\D", "", s)
        if luhn(d[:-1]) != d[-1]:
            return None
        new = _digits(d[:-1], key, "card", back)
        return _refill(s, new + luhn(new))
    if kind == "iban":
        d = s.replace(" ", "")
        if _iban_rest(d[:2], d[4:]) != d[2:4]:
            return None
        new = _letters(d[4:].lower(), key, "iban", back).upper()
        it = iter(d[:2] + _iban_rest(d[:2], new) + new)
        return "".join(c if c == " " else next(it) for c in s)
    if kind == "ssn":
        d = s.replace("-", "")
        return _refill(s, _digits(d, key, "ssn", back, _ssn_ok)) if _ssn_ok(d) else None
    if kind == "ip":
        o = [int(x) for x in s.split(".")]
        return ".".join(map(str, permute(o, [256] * 4, key, "ip", back))) if max(o) < 256 else None
    if kind == "phone":
        d = re.sub(r"\D", "", s)
        cc = re.match(r"\+(\d{1,3})[ .(-]", s)
        skip = len(cc.group(1)) if cc else (len(d) - 10 if len(d) > 10 else 0)
        if not 7 <= len(d) - skip <= 14 or len(d) > 15:
            return None
        return _refill(s, _digits(d[skip:], key, "phone", back), skip)
    if kind == "date":
        return _date(s, key, back)
    if kind == "email":
        name, _, host = s.lower().partition("@")
        labels, tld = host.rsplit(".", 1)
        new = _letters(name, key, "email", back) + "@" + _letters(labels, key, "host", back) + "." + tld
        return _like(new, s)
    return _like(_letters(s.lower(), key, "secret", back), s)


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, dict[str, int]]:
    """``text`` with every valid value replaced, and how many of each kind; ``back`` reverses it."""
    if not text or not _HINT.search(text):
        return text, {}
    out, at, counts, pos = [], 0, {}, 0
    while m := _CANDIDATE.search(text, pos):
        kind = m.lastgroup if m.lastgroup != "value" else "secret"
        span = m.span("value") if kind == "secret" else m.span()
        new = pseudonym(kind, text[slice(*span)], key, back)
        pos = max(m.end(), m.start() + 1)
        if new is None:
            if kind in ("iban", "phone", "date"):  # another kind may begin inside what was no value
                pos = m.start() + max(1, len(re.match(r"\W*\w+|\W+", m.group()).group()))
            continue
        out += [text[at:span[0]], new]
        at = span[1]
        counts[kind] = counts.get(kind, 0) + 1
    return "".join(out) + text[at:], counts


def reveal(text: str, key: bytes) -> str:
    """Takes the pseudonyms back."""
    return pseudonymise(text, key, back=True)[0]


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Input rows with ``text_col`` pseudonymised, plus n_<kind> per kind and n_values."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key has 16 to 64 bytes")

    @F.pandas_udf("text string, " + ", ".join(f"{c} long" for c in COUNTS))
    def swap(col: pd.Series) -> pd.DataFrame:
        done = [pseudonymise(t, key) for t in col]
        return pd.DataFrame([(t, *[c.get(k, 0) for k in KINDS]) for t, c in done], columns=["text", *COUNTS])

    d = packed(docs, F.col(f"`{text_col}`").alias("t"), drop=OUT).select("row", swap(F.col("t")).alias("x"))
    d = d.select(F.col("row").withField(f"`{text_col}`", F.col("x.text")).alias("row"), *[F.col(f"x.{c}") for c in COUNTS])
    return unpacked(d.withColumn("n_values", sum((F.col(c) for c in COUNTS), F.lit(0).cast("long"))), *OUT)
