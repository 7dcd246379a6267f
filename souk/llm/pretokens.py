"""Pre-tokens of a byte-level BPE vocabulary, as the ``tokenizers`` library cuts them.

``PreTokens.split`` cuts a text at the vocabulary's special strings (each one
token) and every part into pre-tokens.  Texts whose characters all lie below
U+0250 are cut by the vocabulary's published pattern with the classes written
out for that range, where it agrees with the library (``tests/llm`` compare every
character); any other text is cut by the library itself.  The token ids of a
pre-token come from the library's model and are remembered for up to ``keep`` pre-tokens.

``PreTokens.encode_column`` does the same for an Arrow column of texts at once: the
rules of the pattern are comparisons of the classes of neighbouring bytes, the
pre-tokens are a view of the column's own bytes that Arrow reduces to the distinct ones, and
only those are looked up.  It holds for characters below U+10000 that Python's Unicode
tables know; a text with any other is cut by the library.
"""

from __future__ import annotations

import codecs
import re
import struct
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa


def _pattern() -> re.Pattern:
    """The byte-level pre-token pattern, the common alternatives first (no text begins two of them), for characters below U+0250."""
    chars = [chr(c) for c in range(0x250)]
    letters, numbers = ("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN")
    white = r"\t-\r \x85\xa0"
    # runs that nothing can follow up are possessive, and letters with and without a space stand apart: both spare the engine its way back
    return re.compile(f" [{letters}]++|[{letters}]++| ?[{numbers}]++|'(?:[stmd]|re|ve|ll)| ?[^{white}{letters}{numbers}]++|[{white}]+(?![^{white}])|[{white}]+")


#: Fixed values.
PATTERN = _pattern()
_PLAIN = re.compile("[\x00-ɏ]*\\Z")
_TOK: dict = {}
_WHITE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)


def _classes() -> np.ndarray:
    """The class of every character below U+10000 in the pattern; unknown: not in Python's Unicode tables."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([_UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], _OTHER) for i in range(0x10000)], dtype=np.uint8)
    table[[i for i in range(0x10000) if chr(i).isspace() and not 0x1C <= i <= 0x1F]] = _WHITE
    return table


_CLASS = _classes()
_ASCII = _CLASS[:0x80].tobytes() + bytes([_UNKNOWN]) * 0x80


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character each byte of a UTF-8 text belongs to."""
    out = np.frombuffer(bytearray(data.tobytes().translate(_ASCII)), dtype=np.uint8)
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        lead = data[wide]
        for low, high, n in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3)):
            at = wide[(lead >= low) & (lead < high)]
            code = (data[at] & (0xFF >> (n + 1))).astype(np.int32)
            for i in range(1, n):
                code = code << 6 | (data[at + i] & 0x3F)
            for i in range(n):
                out[at + i] = _CLASS[code]
    return out


def _starts(data: np.ndarray, classes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which bytes of a UTF-8 text start a pre-token; ``edges`` (places inside the text) cut it into parts that do not see each other."""
    start = np.ones(len(data), dtype=bool)
    np.not_equal(classes[1:], classes[:-1], out=start[1:])
    start[edges] = True
    # the last of white space goes with what follows if it is a space, and stands alone otherwise
    last = np.flatnonzero((classes[:-1] == _WHITE) & (classes[1:] != _WHITE))
    edge = np.zeros(len(data) + 4, dtype=bool)
    edge[edges] = True
    edge[len(data):] = True
    last = last[~edge[last + 1]]
    space = data[last] == 0x20
    start[last[space] + 1] = False
    while len(last):
        first = data[last] & 0xC0 != 0x80
        start[last[first]] = True
        last = last[~first] - 1
    # 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero((data == 0x27) & start)
    mark = mark[~edge[mark + 1]]
    one = np.isin(data[mark + 1], np.frombuffer(b"stmd", dtype=np.uint8))
    more = mark[~one & ~edge[mark + 2]]
    pair = data[more + 1].astype(np.int32) << 8 | data[more + 2]
    more = more[np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])]
    for mark, n in ((mark[one], 2), (more, 3)):
        start[mark + 1] = False
        after = mark + n
        start[after[after < len(data)]] = True
    return start


def tokenizer(name: str):
    if name not in _TOK:
        import public_tokenizers
        from tokenizers import Tokenizer
        _TOK[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _TOK[name]


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: The letters in the order of the bytes, and writers of few ids.
_LETTERS = "".join(c for _, c in sorted(_byte_letters().items()))
_FEW = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return _FEW[len(ids)](*ids) if len(ids) < len(_FEW) else struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Token ids of pre-tokens (little-endian unsigned 32-bit), asked from the model when first looked up."""

    def __init__(self, model, keep: int, part: tuple[str, int] | None = None):
        super().__init__()
        self.model, self.keep, self.part = model, keep, part

    def __missing__(self, piece: str) -> bytes:
        ids = model_ids(self.model, piece)
        if len(self) >= self.keep:  # the first ones seen are the common ones
            for old in list(islice(reversed(self), len(self) - self.keep // 2)):
                del self[old]
        out = self[piece] = _packed(ids)
        return out

    def all(self, pieces: list[str]) -> list[bytes]:
        """Token ids of each of the distinct pieces."""
        out = list(map(self.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        unseen = [pieces[i] for i in new]
        ids = list(self.ask(unseen))
        for i, x in zip(new, ids):
            out[i] = x
        room = self.keep - len(self)
        if len(unseen) > room and len(self) > self.keep // 2:
            for old in list(islice(reversed(self), len(self) - self.keep // 2)):
                del self[old]
            room = self.keep - len(self)
        self.update(zip(unseen[:room], ids[:room]))
        return out

    def ask(self, pieces: list[str], together: int = 128):
        """Token ids of unseen pieces, many in one call of the model where a letter no merge holds can part them."""
        if self.part is None:
            yield from (_packed(model_ids(self.model, p)) for p in pieces)
            return
        letter, part = self.part
        for i in range(0, len(pieces), together):
            some = pieces[i:i + together]
            text = letter.join(some)
            if text.count(letter) >= len(some):  # a piece holds the letter itself
                yield from (_packed(model_ids(self.model, p)) for p in some)
                continue
            ids = np.array(model_ids(self.model, text), dtype="<u4")
            raw, at = ids.tobytes(), 0
            for b in [*(np.flatnonzero(ids == part) * 4).tolist(), len(raw)]:
                yield raw[at:b]
                at = b + 4


def model_ids(model, piece: str) -> list[int]:
    """Token ids of one pre-token."""
    return [t.id for t in model.tokenize(codecs.charmap_decode(piece.encode(), "strict", _LETTERS)[0])]


def _parting_letter(tok) -> tuple[str, int] | None:
    """An ASCII character whose letter no merge of the vocabulary holds, and its id: what stands on both its sides is merged as if alone."""
    model, vocab = tok.model, tok.get_vocab()
    if model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges:
        return None
    merged = set().union(*(t for t in vocab if len(t) > 1))
    free = (chr(i) for i, c in enumerate(_LETTERS[:0x80]) if c in vocab and c not in merged)
    letter = next(free, None)
    return letter and (letter, vocab[_LETTERS[ord(letter)]])


class PreTokens:
    """One per worker and vocabulary (``pretokens``): what it remembers serves all tasks."""

    def __init__(self, vocab: str, keep: int = 750_000):
        self.tok = tokenizer(vocab)
        self.pre, self.model = self.tok.pre_tokenizer, self.tok.model
        self.model._resize_cache(0)  # the model's own memory of pre-tokens, which costs more than it saves beside this one
        self.known = _Known(self.model, keep, _parting_letter(self.tok))
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.known.update((t, _packed([i])) for t, i in added.items())  # no pre-token is equal to one
        self.special = added
        self.breaks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.byte_breaks = re.compile(self.breaks.pattern.encode()) if added else None

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which are the odd entries."""
        return self.breaks.split(text) if self.breaks and "<" in text else [text]

    def cut(self, part: str) -> list[str]:
        """Pre-tokens of a part without special strings."""
        if self.tok.normalizer is None and (part.isascii() or _PLAIN.match(part)):
            return PATTERN.findall(part)
        if self.tok.normalizer is not None:
            part = self.tok.normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in self.pre.pre_tokenize_str(part)]

    def encode_bytes(self, text: str) -> bytes:
        """Token ids of a text (little-endian unsigned 32-bit)."""
        out, known = [], self.known.__getitem__
        for i, part in enumerate(self.parts(text)):
            if i % 2:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                out.extend(map(known, self.cut(part)))
        return b"".join(out)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (uint32) of a column of texts one after the other, and the number of ids of each text (null: none)."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        if self.tok.normalizer is not None:
            ids = [self.encode_bytes(t.decode()) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        raw, size = memoryview(data), len(data)
        specials = [m.span() for m in self.byte_breaks.finditer(raw)] if self.byte_breaks else []
        # a special string never crosses two texts: each text is searched alone where one seems to
        starts_of = np.searchsorted(ends, [a for a, _ in specials], side="right") if specials else []
        if any(b > ends[i] for (_, b), i in zip(specials, starts_of)):
            specials = [(ends[i] + m.start(), ends[i] + m.end()) for i in range(len(texts)) for m in self.byte_breaks.finditer(raw[ends[i]:ends[i + 1]])]
        edges = np.concatenate((ends, np.array(specials, dtype=np.int64).ravel()))
        classes = _byte_classes(data)
        start = _starts(data, classes, edges[edges < size])
        for a, b in specials:
            start[a + 1:b] = False
        unknown = np.flatnonzero(classes == _UNKNOWN)
        for i in np.unique(np.searchsorted(ends, unknown, side="right") - 1).tolist():
            self._cut_by_library(raw[ends[i]:ends[i + 1]], start[ends[i]:ends[i + 1]])
        cuts = np.append(np.flatnonzero(start), size)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        which = pieces.indices.to_numpy()
        known = self.known.all(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        many = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        count = many[which]
        upto = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat((np.cumsum(many) - many)[which] - upto[:-1], count)
        place += np.arange(len(place))
        return flat[place], np.diff(upto[np.searchsorted(cuts, ends)])

    def _cut_by_library(self, raw: memoryview, start: np.ndarray) -> None:
        """Set the starts of the pre-tokens of one text as the library cuts it."""
        start[:] = False
        at = 0
        for i, part in enumerate(self.parts(bytes(raw).decode())):
            for piece in [part] if i % 2 else self.cut(part):
                start[at:at + 1] = True
                at += len(piece.encode())

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return memoryview(self.encode_bytes(text)).cast("I").tolist()


_WORKER: dict = {}


def pretokens(vocab: str) -> PreTokens:
    """The worker's ``PreTokens`` of a vocabulary."""
    if vocab not in _WORKER:
        _WORKER[vocab] = PreTokens(vocab)
    return _WORKER[vocab]
