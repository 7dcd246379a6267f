"""Pseudonyms: permutations, validity, linkage, reversal, what stays."""

import datetime as dt
import itertools
import random
import re

import pytest

from souk.llm.pii import _iban_rest, _ssn_ok, luhn, permute, pseudonym, pseudonymise, pseudonyms, reveal

KEY, OTHER = b"0123456789abcdef", b"fedcba9876543210"


@pytest.mark.parametrize("radix", [[10, 10], [10] * 3, [26], [7, 5, 3], [270, 3]])
def test_permutation(radix):
    every = list(itertools.product(*map(range, radix)))
    image = [tuple(permute(list(v), radix, KEY, "t")) for v in every]
    assert sorted(image) == every
    assert [tuple(permute(list(v), radix, KEY, "t", back=True)) for v in image] == every
    if len(every) > 50:
        assert image != every and image != [tuple(permute(list(v), radix, OTHER, "t")) for v in every]


def card(rnd, n=16):
    d = "".join(rnd.choice("0123456789") for _ in range(n - 1))
    return d + luhn(d)


def iban(rnd):
    acc = "".join(rnd.choice("0123456789") for _ in range(18))
    return "DE" + _iban_rest("DE", acc) + acc


VALID = {
    "card": lambda s: luhn(re.sub(r"\D", "", s)[:-1]) == s[-1],
    "iban": lambda s: _iban_rest(s[:2], s.replace(" ", "")[4:]) == s[2:4],
    "ssn": lambda s: _ssn_ok(s.replace("-", "")),
    "ip": lambda s: max(map(int, s.split("."))) < 256,
}


def test_values_keep_their_format_and_come_back():
    rnd = random.Random(2)
    made = {
        "card": [card(rnd, n) for n in (13, 15, 16, 19)] + [re.sub(r"(\d{4})(?=\d)", r"\1-", card(rnd))],
        "iban": [iban(rnd), re.sub(r"(.{4})(?=.)", r"\1 ", iban(rnd))], "ssn": ["123-45-6789", "899-01-0001"],
        "ip": ["8.8.8.8", "233.254.104.120"], "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+49 30 123456", "+44 20 7946 0958"],
        "email": ["nt.26@mail6.example.com", "Jane_Doe+x@Example.ORG", "A@B.DE"], "secret": ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "Abc-12345_x"],
        "date": ["1999-12-31", "2024/02/29", "31.12.1999", "05/23/1987", "March 14, 1985", "14 Mar 1985", "MAY 21 2001"],
    }
    for kind, values in made.items():
        for v in values:
            p = pseudonym(kind, v, KEY)
            assert p is not None and p != v and pseudonym(kind, v, KEY) == p and pseudonym(kind, v, OTHER) != p
            assert VALID.get(kind, lambda s: True)(p), (kind, v, p)
            shape = lambda s: re.sub(r"[A-Za-z]", "a", re.sub(r"\d+" if kind == "ip" else r"\d", "9", s))
            if kind not in ("date", "secret"):
                assert shape(p) == shape(v), (kind, v, p)
            assert pseudonym(kind, p, KEY, back=True) == v, (kind, v, p)
            prefix = "token = " if kind == "secret" else ""
            text = f"Before {prefix}{v}, after."
            new, counts = pseudonymise(text, KEY)
            assert counts == {kind: 1} and new == f"Before {prefix}{p}, after." and reveal(new, KEY) == text, (kind, v, new)


def test_equal_values_stay_linked():
    same = lambda kind, a, b, norm: norm(pseudonym(kind, a, KEY)) == norm(pseudonym(kind, b, KEY))
    digits = lambda s: re.sub(r"\D", "", s)[-10:]
    assert same("phone", "+1 (017) 555-7713", "017-555-7713", digits)
    assert same("card", "4111 1111 1111 1111", "4111111111111111", lambda s: s.replace(" ", ""))
    assert same("email", "JANE@EXAMPLE.COM", "jane@example.com", str.lower)
    iso = dt.date.fromisoformat(pseudonym("date", "1987-05-23", KEY))
    assert pseudonym("date", "23.05.1987", KEY) == iso.strftime("%d.%m.%Y")
    assert pseudonym("date", "05/23/1987", KEY) == iso.strftime("%m/%d/%Y")
    assert pseudonym("date", "May 23, 1987", KEY) == f"{iso.strftime('%B')[:3] if iso.month != 0 else ''}" + f" {iso.day:02d}, {iso.year}"


def test_what_is_not_valid_stays():
    text = ("Order 4111111111111112, room 999.999.1.2, on 31.02.2020 and 2020-13-01, SSN 000-12-3456, v4.0, Version 2.0, "
            "1234567, 3.14159, a@b, DE00123456789012345678, 12345678901234567890123 and tokens of wood.")
    assert pseudonymise(text, KEY) == (text, {})
    assert pseudonymise(None, KEY) == (None, {}) and pseudonymise("", KEY) == ("", {})
    a, b = card(random.Random(1)), card(random.Random(5))
    new, n = pseudonymise(f"{a} {b} {a}\n{a}.", KEY)
    assert n == {"card": 4} and a not in new and b not in new and len(set(re.findall(r"\d{16}", new))) == 2
    assert pseudonymise("x " * 100000 + a, KEY)[1] == {"card": 1}
    for text in (f"no.{a}", f"a,{a},b", f"-{a}-", f"({a})", f"'{a}'", f"{a}!!", f"{a}$$$", f"card:{a};"):
        assert pseudonymise(text, KEY)[1] == {"card": 1}, text
    for text in ("tel.+1 (017) 555-7713.", "x:(017) 555-7713%%%", "ip=1.2.3.4,", "on.2001-02-03.", '"token": "abcdef0123456789"'):
        assert sum(pseudonymise(text, KEY)[1].values()) == 1, text


def test_table(lspark):
    a = card(random.Random(9))
    rows = [(1, f"pay {a} now", "k", 1), (2, f"again {a}!!", "k", 1), (2, f"again {a}!!", "k", 1), (3, None, "k", 1), (None, "", "k", 1)]
    df = lspark.createDataFrame(rows, "doc_id long, text string, x string, n_card int")
    out = pseudonyms(df, KEY).collect()
    found = {re.search(r"\d{16}", r["text"]).group() for r in out if r["text"]}
    assert len(found) == 1 and a not in found and [r["n_values"] for r in out] == [1, 1, 1, 0, 0] and out[3]["text"] is None
    assert out[0]["x"] == "k" and pseudonyms(df.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        pseudonyms(df, b"short")


def test_given_documents(lspark):
    docs = lspark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pseudonyms(docs, KEY).collect()
    assert sum(r["n_values"] for r in rows) > 50
    mails = re.compile(r"[\w.]+@mail\d\.example\.com", re.I)
    for r in rows:
        assert reveal(r["text"], KEY) == old[r["doc_id"]]
        assert not mails.search(r["text"])
        if not r["n_values"]:
            assert r["text"] == old[r["doc_id"]]
