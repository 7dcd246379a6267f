"""Columns of texts encoded at once, and the rounds of Re-Pair, against plain versions."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

VOCAB = "byte_bpe_50k.json"


def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(VOCAB))


def check(pre, tok, texts):
    ids, n = pre.encode_column(pa.array(texts, pa.string()))
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want]
    for t, x, got in zip(texts, want, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == x, repr(t)


def test_columns_are_encoded_as_the_library_does():
    from souk.llm.pretokens import PreTokens
    pre, tok = PreTokens(VOCAB), library()
    known = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    check(pre, tok, [f"a{c}b {c}\n{c}1{c} !{c}'s  {c}" for c in known])
    check(pre, tok, ["", None, "it's", "'s", "'", "re", "'re've'll'x", " 's \n's", "x'", "s", "  ", " a", "a ", "\n", "\x00a\x00", "͸ 's <|endoftext|>", "😀 's  x"])
    check(pre, tok, ["a<|endof", "text|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endof", "text|><|endoftext|>", " <|endoftext|> 's"])
    rnd = random.Random(5)
    wide = known[:0x250] + list("😀日本語ａ①½ 　​﻿’“—…éß") + list("  \n\t''''srtvemdl  ") * 20 + ["<|endoftext|>", "<|", "'re", "'ll", "the", " ", "　"]
    texts = ["".join(rnd.choice(wide) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    check(pre, tok, texts)
    for small in (PreTokens(VOCAB, keep=100), PreTokens(VOCAB, keep=3000)):
        for i in range(0, 4000, 400):
            check(small, tok, texts[i:i + 400])
            assert len(small.known) <= small.known.keep
    for part in (pa.array(texts, pa.string()).slice(100, 50), pa.array([], pa.string()), pa.array([None, ""], pa.string()), pa.array(texts[:9], pa.large_string())):
        ids, n = pre.encode_column(part)
        assert ids.tolist() == [i for t in part.to_pylist() for i in tok.encode(t or "", add_special_tokens=False).ids] and len(n) == len(part)


def test_a_column_asks_the_model_few_times():
    """20,000 unseen pre-tokens took one call each; now a call takes many, and a second pass none."""
    from souk.llm.pretokens import PreTokens
    pre, calls = PreTokens(VOCAB), [0]

    class Model:
        def tokenize(self, piece):
            calls[0] += 1
            return pre.model.tokenize(piece)

    pre.known.model = Model()
    texts = [" ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676 % 26)}é" for j in range(i, i + 400)) for i in range(0, 17_576, 400)]
    check(pre, library(), texts * 2)
    assert 0 < calls[0] <= 17_576 / 50
    before = calls[0]
    check(pre, library(), texts)
    assert calls[0] == before


def plain_repair(seq, base, end, min_count, batch, min_gain):
    """Re-Pair as described, every pair counted anew in every round."""
    seq, rules, ends, top = list(seq), [], {end}, base
    while len(seq) > 1:
        count = Counter(p for p in zip(seq, seq[1:]) if p[0] not in ends)
        often = sorted((p for p, c in count.items() if c >= min_count), key=lambda p: (-count[p], p))[:2 * batch]
        lefts, rights, chosen = set(), set(), {}
        for x, y in often:
            if (x in lefts | rights) if x == y else (x in rights or y in lefts or (x, x) in chosen or (y, y) in chosen):
                continue
            lefts.add(x)
            rights.add(y)
            chosen[x, y] = top + len(chosen)
            if len(chosen) >= batch:
                break
        if not chosen:
            break
        out, i = [], 0
        while i < len(seq):
            new = chosen.get((seq[i], seq[i + 1])) if i + 1 < len(seq) and seq[i] not in ends else None
            out.append(seq[i] if new is None else new)
            i += 1 if new is None else 2
        ends |= {r for (_, y), r in chosen.items() if y in ends}
        rules += chosen
        top += len(chosen)
        before, seq = len(seq), out
        if before - len(seq) < min_gain * before:
            break
    return seq, rules


def test_rounds_choose_what_counting_all_pairs_chooses():
    """Pairs left out of later rounds, as they are rare, change nothing; later rounds look at fewer positions."""
    from souk.llm import tokens as T
    rng = np.random.default_rng(11)
    for n, k, batch, min_count in ((2000, 4, 1, 2), (2000, 30, 20, 3), (4000, 12, 5, 8), (3, 2, 5, 1), (0, 2, 5, 2), (4000, 200, 1000, 2)):
        x = np.minimum(rng.geometric(min(0.9, 4 / k), n), k) - 1
        x[rng.integers(0, max(n, 1), n // 40)] = k
        x = np.append(x, k).astype(np.uint32)
        for seq in (x, np.repeat(x, rng.integers(1, 4, len(x)))):
            got, rules, _ = T.repair(seq, k + 1, k, min_count, batch, 0.001)
            want = plain_repair(seq.tolist(), k + 1, k, min_count, batch, 0.001)
            assert (got.tolist(), [tuple(r) for r in rules.tolist()]) == want
    looked, grouped = [], T._grouped_pairs

    def spy(seq, pos, top):
        looked.append((len(seq), len(pos)))
        return grouped(seq, pos, top)

    T._grouped_pairs = spy
    try:
        T.repair(np.append(rng.zipf(1.3, 40_000) % 5000, 5000).astype(np.uint32), 5001, 5000)
    finally:
        T._grouped_pairs = grouped
    assert len(looked) > 1 and all(p < 0.8 * n for n, p in looked[1:])


def test_pairs_of_wide_symbols_are_grouped_alike():
    from souk.llm.tokens import _grouped_pairs
    seq = np.random.default_rng(2).integers(0, 40, 3000).astype(np.uint32)
    pos = np.flatnonzero(seq[:-1] != 7)
    key, at = _grouped_pairs(seq, pos, 40)
    wide, places = _grouped_pairs(seq, pos, 1 << 31)
    assert at.tolist() == places.tolist() and (key >> np.uint64(6)).tolist() == (wide >> np.uint64(32)).tolist()
