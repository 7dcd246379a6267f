"""Conversation structure repair: cheapest edit audits by a persistent dynamic programme.

A conversation is legal when its role initials read ``(s?(ua)+)?``.  Its turns,
in order, are edited one by one: Keep (K, 0), Rerole to the role the grammar
wants next (R, 3) or Delete (D, 4); an empty turn of that role may be inserted
anywhere (I, 3); blank and duplicate turns must be deleted, a truncated turn
that stays adds 3.  The audit is the string of edits of the cheapest repair,
ties broken by the least string.

Method.  Turns are hash-partitioned by conversation and sorted inside the
partition by (turn, nulls first; then role, text), and each task streams over
them, so a conversation's texts are never held together.  The programme has
four states (nothing yet, after s, after u, after a).  A state's best audit is
a linked node (parent, edit): prefixes are shared by all that grow from them.
Nodes carry their depth, a rolling hash of the whole audit and binary-lifting
ancestors, so two audits of equal cost are ordered by a longest-common-prefix
search in O(log n) hash comparisons; the common prefix that the hashes claim is
verified by walking both chains until they meet, and a collision falls back to
comparing the strings.  Two audits of one state and row count are never a
prefix of each other (the longer one would cost more), so the order of prefixes
decides the order of the whole audits.  The sha256 of the repaired conversation
runs along each state (copied where states part): one streamed pass.

What stays in memory per conversation is its edit nodes and one 32-byte
digest per distinct turn (for duplicates).  A conversation is one task by
nature: its audit is one value and its hash is sequential.

Defined results: null role or text -> one space; null turn -> sorted first,
outside ``gaps``; null conversation id -> a conversation of its own; turns
repeated with equal turn numbers -> ordered by role, then text; no turns (all
``lost``) -> zeros, empty audit, hash of the empty string; empty table -> empty.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of the edits, legal neighbours, the grammar's moves per
#: state (0 nothing yet, 1 after s, 2 after u, 3 after a).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = frozenset(("su", "ua", "au"))
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("u", "u", "a", "u")
NAME = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
_MOD, _BASE = (1 << 61) - 1, 911382323


class Audits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self, mod: int = _MOD):
        self.mod = mod
        self.up, self.edit, self.depth, self.hash = [(0,)], [""], [0], [0]

    def add(self, parent: int, edit: str) -> int:
        up, anc, k = self.up, [parent], 0
        while len(up[anc[k]]) > k and anc[k]:
            anc.append(up[anc[k]][k])
            k += 1
        up.append(tuple(anc))
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(edit)) % self.mod)
        return len(up) - 1

    def lift(self, x: int, depth: int) -> int:
        """The prefix of ``x`` with ``depth`` edits."""
        while (gap := self.depth[x] - depth) > 0:
            x = self.up[x][min(gap.bit_length(), len(self.up[x])) - 1]
        return x

    def text(self, x: int) -> str:
        out = []
        while x:
            out.append(self.edit[x])
            x = self.up[x][0]
        return "".join(reversed(out))

    def less(self, x: int, y: int) -> bool:
        """Whether the edit string of ``x`` is before that of ``y``."""
        if x == y:
            return False
        d = min(self.depth[x], self.depth[y])
        p, q = self.lift(x, d), self.lift(y, d)
        if p == q or self.hash[p] == self.hash[q]:
            return self.depth[x] < self.depth[y] if self._same(p, q) else self.text(x) < self.text(y)
        k = min(len(self.up[p]), len(self.up[q])) - 1
        while k >= 0:  # climb while the prefixes differ: ends one edit below the common prefix
            if k < len(self.up[p]) and k < len(self.up[q]):
                a, b = self.up[p][k], self.up[q][k]
                if a != b and self.hash[a] != self.hash[b]:
                    p, q = a, b
            k -= 1
        if not self._same(self.up[p][0], self.up[q][0]) or self.edit[p] == self.edit[q]:
            return self.text(x) < self.text(y)
        return self.edit[p] < self.edit[q]

    def _same(self, p: int, q: int) -> bool:
        """Verifies that equal hashes are equal strings."""
        while p != q:
            if self.edit[p] != self.edit[q]:
                return False
            p, q = self.up[p][0], self.up[q][0]
        return True


class Repair:
    """One conversation, turn by turn."""

    def __init__(self, mod: int = _MOD):
        self.nodes = Audits(mod)
        self.best = [(0, 0, hashlib.sha256()), None, None, None]  # per state: cost, audit node, running hash
        self.seen, self.turns, self.last = set(), set(), None
        self.lo = self.hi = None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def _put(self, best: list, state: int, cost: int, parent: int, edit: str, sha, add: bytes) -> None:
        old = best[state]
        if old is not None and cost > old[0]:
            return
        node = self.nodes.add(parent, edit)
        if old is None or cost < old[0] or self.nodes.less(node, old[1]):
            best[state] = (cost, node, sha, add)

    @staticmethod
    def _settle(best: list) -> list:
        """Brings the running hashes up to date (shared until they differ)."""
        out = []
        for b in best:
            if b is not None and len(b) == 4:
                sha = b[2]
                if b[3]:
                    sha = sha.copy()
                    sha.update(b[3])
                b = (b[0], b[1], sha)
            out.append(b)
        return out

    def _insert(self) -> None:
        """Empty turns before the next row: to "after u", then to "after a"; longer chains cost more than they reach."""
        for target in (2, 3):
            best = list(self.best)
            for state in ((0, 1, 3) if target == 2 else (2,)):
                if self.best[state] is not None:
                    cost, node, sha = self.best[state]
                    role = NAME[WANTED[state]]
                    self._put(best, target, cost + INSERT, node, "I", sha, (("\n" if state else "") + role + ":").encode())
            self.best = self._settle(best)

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.turns.add(turn)
            self.lo = turn if self.lo is None else min(self.lo, turn)
            self.hi = turn if self.hi is None else max(self.hi, turn)
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        body = text.encode("utf-8", "surrogatepass")
        digest = hashlib.sha256(role.encode("utf-8", "surrogatepass") + b"\0" + body).digest()
        end = text.rstrip(SPACE)[-1:]
        must, cut = False, 0
        if not end:
            self.blank += 1
            must = True
        elif digest in self.seen:
            self.duplicate += 1
            must = True
        elif end not in ".!?":
            self.truncated += 1
            cut = TRUNCATED
        self.seen.add(digest)

        self._insert()
        best: list = [None] * 4
        for state, b in enumerate(self.best):
            if b is None:
                continue
            cost, node, sha = b
            self._put(best, state, cost + DELETE, node, "D", sha, b"")
            if must:
                continue
            lead = b"\n" if state else b""
            to = MOVES[state].get(role[:1])
            if to is not None:
                self._put(best, to, cost + cut, node, "K", sha, lead + role.encode("utf-8", "surrogatepass") + b":" + body)
            want = WANTED[state]
            self._put(best, MOVES[state][want], cost + REROLE + cut, node, "R", sha, lead + NAME[want].encode() + b":" + body)
        self.best = self._settle(best)

    def result(self) -> tuple:
        self._insert()
        done = [b for b in (self.best[0], self.best[3]) if b is not None]
        b = done[0]
        if len(done) == 2 and (done[1][0] < b[0] or (done[1][0] == b[0] and self.nodes.less(done[1][1], b[1]))):
            b = done[1]
        gaps = self.hi - self.lo + 1 - len(self.turns) if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, b[0], self.nodes.text(b[1]), b[2].hexdigest()


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Turns (conv, turn, role, text, lost) with one fault of five put into some, by a hash of (conv, turn).

    ``lost`` marks the rows that are dropped; they stay so that a
    conversation without any other row is still reported.
    """
    sp = F.lit(" ")
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    key = F.concat(F.coalesce(conv.cast("string"), sp), F.lit(":"), F.coalesce(turn.cast("string"), sp))
    d = turns.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), sp).alias("role"),
                     F.coalesce(F.col(f"`{text_col}`"), sp).alias("text"), (F.crc32(key) % 20).alias("fault"))
    f = F.col("fault")
    return d.select("conv", "turn", F.when(f == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (f == 0).alias("lost"),
                    F.explode(F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _streamed(turns: DataFrame, *first) -> DataFrame:
    """One conversation after the other, its turns in order."""
    return turns.repartition("conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "text")


def audits(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text[, lost]) -> per conversation: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256 (of the repaired ``role:text`` lines)."""
    sp = F.lit(" ")
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in turns.columns else F.lit(False)
    t = turns.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", sp).alias("role"),
                     F.when(lost, "").otherwise(F.coalesce("text", sp)).alias("text"), lost.alias("lost"))
    schema = T.StructType([T.StructField("conv", t.schema["conv"].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        conv, work, out, names, kind = None, None, [], [f.name for f in schema.fields], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, turn, role, text, gone in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if work is None or c != conv:
                    if work is not None:
                        out.append((conv, *work.result()))
                    conv, work = c, Repair()
                if not gone:
                    work.row(turn, role, text)
            if len(out) >= 1000:
                yield _batch(out, names, kind)
                out = []
        if work is not None:
            out.append((conv, *work.result()))
        if out:
            yield _batch(out, names, kind)

    return _streamed(t).mapInArrow(run, schema)


def _batch(rows: list, names: list, kind) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv, seq, role, text): ``report``'s audits applied to ``turns``.

    The audit travels once, as a row in front of its conversation's turns.
    """
    sp = F.lit(" ")
    keep = turns.where(~F.coalesce(F.col("lost"), F.lit(False))) if "lost" in turns.columns else turns
    t = keep.select("conv", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce("role", sp).alias("role"), F.coalesce("text", sp).alias("text"))
    a = report.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                      F.col("audit").alias("text"))
    schema = T.StructType([T.StructField("conv", t.schema["conv"].dataType), T.StructField("seq", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        audit, at, state, seq = "", 0, 0, 0

        def inserts(conv, out):
            nonlocal at, state, seq
            while audit[at:at + 1] == "I":
                want = WANTED[state]
                out.append((conv, seq, NAME[want], ""))
                at, state, seq = at + 1, MOVES[state][want], seq + 1

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for c, k, _, role, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if k == 0:
                    audit, at, state, seq = text, 0, 0, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        to = role[:1] if edit == "K" else WANTED[state]
                        out.append((c, seq, role if edit == "K" else NAME[to], text))
                        state, seq = MOVES[state][to], seq + 1
                inserts(c, out)
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (kind, pa.int64(), pa.string(), pa.string()))],
                                             names=[f.name for f in schema.fields])

    return _streamed(a.unionByName(t), "kind").mapInArrow(run, schema)
