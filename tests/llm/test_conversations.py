"""Conversation repair against a plain full-string programme and an exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from souk.llm import conversations as C
from souk.llm.conversations import Audits, Repair, audits, damage, repaired_turns

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        f = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(f)
    return out


def exhaustive(rows):
    """(cost, audit, lines) over all edit strings with at most two inserts in a gap."""
    fs, best = faults(rows), None

    def gaps():
        return itertools.product(range(3), repeat=len(rows) + 1)

    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(fs, edits)):
            continue
        for ins in gaps():
            audit = "I" * ins[0] + "".join(e + "I" * n for e, n in zip(edits, ins[1:]))
            cost = 3 * sum(ins) + sum({"D": 4, "K": 0, "R": 3}[e] + (3 if f == "truncated" and e != "D" else 0) for e, f in zip(edits, fs))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            slots, n_new = [], 0
            it = iter(range(len(rows)))
            for e in audit:
                if e == "I":
                    slots.append((None, ""))
                    n_new += 1
                else:
                    i = next(it)
                    if e == "K":
                        slots.append(rows[i])
                    elif e == "R":
                        slots.append((None, rows[i][1]))
                        n_new += 1
            for roles in itertools.product(("user", "assistant"), repeat=n_new):
                r = iter(roles)
                lines = [(role if role is not None else next(r), text) for role, text in slots]
                if GRAMMAR.match("".join(x[0][:1] or "?" for x in lines)):
                    best = (cost, audit, lines)
                    break
    return best


def plain(rows):
    """The same programme with whole strings per state."""
    fs = faults(rows)
    cur = {0: (0, "", [])}

    def put(d, s, v):
        if s not in d or v[:2] < d[s][:2]:
            d[s] = v

    def inserts(d):
        d = dict(d)
        for _ in range(3):
            for s, (c, a, l) in list(d.items()):
                w = C.WANTED[s]
                put(d, C.MOVES[s][w], (c + 3, a + "I", l + [(C.NAME[w], "")]))
        return d

    for (role, text), f in zip(rows, fs):
        nxt = {}
        for s, (c, a, l) in inserts(cur).items():
            put(nxt, s, (c + 4, a + "D", l))
            if f in ("blank", "duplicate"):
                continue
            x = 3 if f == "truncated" else 0
            if role[:1] in C.MOVES[s]:
                put(nxt, C.MOVES[s][role[:1]], (c + x, a + "K", l + [(role, text)]))
            w = C.WANTED[s]
            put(nxt, C.MOVES[s][w], (c + 3 + x, a + "R", l + [(C.NAME[w], text)]))
        cur = nxt
    return min((v for s, v in inserts(cur).items() if s in (0, 3)), key=lambda v: v[:2])


def some_rows(rnd, n):
    return [(rnd.choice(["user", "assistant", "system", "tool", "user", "assistant"]),
             rnd.choice(["A.", "B?", "c", "", " \n", "D!", "e.", f"x{rnd.random()}."])) for _ in range(n)]


def line_hash(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def one(rows, mod=C._MOD):
    w = Repair(mod)
    for i, (r, t) in enumerate(rows):
        w.row(i, r, t)
    return w.result()


def test_against_exhaustive_search():
    rnd = random.Random(5)
    for _ in range(60):
        rows = some_rows(rnd, rnd.randint(0, 3))
        got, want = one(rows), exhaustive(rows)
        assert (got[5], got[6], got[7]) == (want[0], want[1], line_hash(want[2])), rows


@pytest.mark.parametrize("mod", [C._MOD, 7, 1])  # small moduli: nearly every hash collides, results stay exact
def test_against_whole_strings(mod):
    rnd = random.Random(11)
    for _ in range(300):
        rows = some_rows(rnd, rnd.randint(0, 40))
        got, want = one(rows, mod), plain(rows)
        assert (got[5], got[6], got[7]) == (want[0], want[1], line_hash(want[2])), rows


def test_node_order_is_string_order():
    rnd, a = random.Random(3), Audits()
    nodes = [0]
    for _ in range(400):
        nodes.append(a.add(rnd.choice(nodes[-20:]), rnd.choice("DIKR")))
    for x, y in (rnd.sample(nodes, 2) for _ in range(3000)):
        assert a.less(x, y) == (a.text(x) < a.text(y))
    for x in nodes:
        assert a.text(a.lift(x, a.depth[x] // 2)) == a.text(x)[:a.depth[x] // 2]


def test_long_conversation():
    rows = [("user" if i % 3 else "assistant", f"t{i % 997}" + ("." if i % 5 else "")) for i in range(3000)]
    got, want = one(rows), plain(rows)
    assert (got[5], got[6], got[7]) == (want[0], want[1], line_hash(want[2]))


def brute(table):
    """The contract's columns for rows (conv_id, turn, role, text)."""
    conv = {}
    for c, t, r, x in table:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x = (" " if v is None else v for v in (r, x))
        f = zlib.crc32(key.encode()) % 20
        if f == 1:
            x = ""
        elif f == 2:
            x = re.sub("[.!?]", "", x)
        elif f == 4:
            r = "user"
        conv.setdefault(c, []).extend([(t, r, x)] * (0 if f == 0 else 2 if f == 3 else 1))
    out = {}
    for c, rows in conv.items():
        rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [(r, x) for _, r, x in rows]
        fs = faults(pairs)
        cost, audit, lines = plain(pairs)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, fs.count("blank"), fs.count("duplicate"),
                  fs.count("truncated"), sum(a[0][:1] + b[0][:1] not in C.LEGAL for a, b in zip(pairs, pairs[1:])),
                  cost, audit, line_hash(lines))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, lost int, conv string"


def test_query_against_brute_force(lspark):
    rnd = random.Random(8)
    rows = [(c, rnd.randint(0, 12), r, t, 1, "x") for c in range(150) for r, t in some_rows(rnd, rnd.randint(1, 12))]
    rows += [(None, 1, "user", "A.", None, None), (None, None, None, None, None, None), (7, None, "user", "B.", 1, ""),
             (9, 3, None, None, 1, ""), (9, 3, "user", None, 1, ""), rows[0], rows[0]]
    rows += [(1000, i, "user" if i % 2 else "assistant", "w " * 20000 + ".", 1, "") for i in range(6)]  # long texts
    got = audits(damage(lspark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute([r[:4] for r in rows])
    assert got.columns[1:] == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_lost_conversations_and_empty_table(lspark):
    lost = [(c, t) for c in range(60) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [(c, t, "user", "A.", 1, "") for c, t in lost]
    got = audits(damage(lspark.createDataFrame(rows, SCHEMA))).collect()
    assert {r["conv"] for r in got} == {c for c, _ in lost}
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert audits(damage(lspark.createDataFrame([], SCHEMA))).count() == 0


def test_repaired_turns_give_the_reported_hash(lspark):
    rnd = random.Random(21)
    rows = [(c, t, r, x, 1, "") for c in range(80) for t, (r, x) in enumerate(some_rows(rnd, rnd.randint(1, 9)))]
    bad = damage(lspark.createDataFrame(rows, SCHEMA)).checkpoint()
    report = audits(bad).checkpoint()
    lines = {}
    for r in sorted(repaired_turns(bad, report).collect(), key=lambda r: (r["conv"], r["seq"])):
        lines.setdefault(r["conv"], []).append((r["role"], r["text"]))
    for r in report.collect():
        assert line_hash(lines.get(r["conv"], [])) == r["repaired_sha256"]
        assert GRAMMAR.match("".join(x[0][:1] for x in lines.get(r["conv"], [])))
