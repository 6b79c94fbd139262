"""Encoding with the ``tokenizers`` library, each distinct piece once, and each distinct word where white space is dropped.

Both tokenizers split a text into pieces and encode every piece by itself, so a piece's ids never
depend on its neighbours. Texts whose characters are all in U+0020..U+007E, U+00A1..U+00FF or are a tab, line
feed or carriage return are cut with an equivalent pattern and each new piece goes through the
library's own model; any other text is encoded by the library as a whole, and so is one that may hold the string of
a special token, which the library's plain call encodes as that token's id. With ``ordinary`` such strings are text like any other.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .ngram_lm import hashed_words

# Letters, numbers and the rest among the characters below U+0100.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
PLAIN = re.compile("[\t\n\r -~¡-ÿ]*")
PIECES = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+"),
}


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words:
    """Ids of words by hash: sorted hashes, and each word's place and number in one array of ids."""

    def __init__(self):
        self.hashes, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ascending hashes, -1 if absent."""
        at = np.searchsorted(self.hashes, hashes)
        there = at < len(self.hashes)
        there[there] = self.hashes[at[there]] == hashes[there]
        return np.where(there, at, -1)

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Put in ascending hashes that are not there."""
        at, size = np.searchsorted(self.hashes, hashes), np.array([len(x) // 4 for x in ids], dtype=np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        self.hashes, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])


class Encoder:
    """Texts -> ids. Pieces and words seen before come from tables, emptied at ``most`` and ``most_words`` entries: that bounds a worker's memory and changes no result."""

    def __init__(self, path: str, kind: str, ordinary: bool = False, most: int = 500_000, most_words: int = 2_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = ordinary
        special = [] if ordinary else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # What all special strings begin with, up to their first letter; without such a beginning no text is known to be free of them.
        self.special = re.match(r"[^\w\s]*", os.path.commonprefix(special))[0] if special else None
        self.lower, self.cut, self.most, self.most_words = kind == "word", PIECES[kind].findall, most, most_words
        self.known: dict[str, bytes] = {}  # ids of pieces
        self.words = Words()  # and, where white space is dropped, of whole words
        self.single = Tokenizer(self.whole.model)  # the same model over pieces that are cut already
        self.chars = byte_characters()
        self.between = self.chars[0]  # plain texts have no NUL, so its character, and its id, can stand between pieces
        self.single.pre_tokenizer = pre_tokenizers.Split(self.between, "isolated")
        (self.mark,) = self.single.encode(self.between, add_special_tokens=False).ids

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > self.most:
            self.known.clear()
        joined = "\0".join(pieces).encode().decode("latin-1").translate(self.chars)
        ids = np.array(self.single.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        if len(ends) != len(pieces):
            raise ValueError("a piece without ids")
        raw, at = ids.tobytes(), 0
        for piece, end in zip(pieces, ends):
            self.known[piece] = raw[4 * at : 4 * end]
            at = end + 1

    def pieces_of(self, found: list[list[str]]) -> list[bytes]:
        """Ids of all pieces, in order, as bytes."""
        flat = list(chain.from_iterable(found))
        ids = list(map(self.known.get, flat))
        if missing := [i for i, x in enumerate(ids) if x is None]:
            new = {flat[i] for i in missing}
            if len(self.known) + len(new) > self.most:  # the table is emptied
                new, missing = set(flat), range(len(flat))
            self.learn(list(new))
            for i in missing:
                ids[i] = self.known[flat[i]]
        return ids

    def words_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts where white space is dropped: each distinct word is cut and encoded once, then found by its 64-bit hash.

        Two of the n words of a table are confused with probability n^2 / 2^65, under 10^-8 for a full one.
        """
        raws = [t.lower().encode() for t in texts]
        raw = b"\n".join(raws) + b"\n"
        starts, ends, h = hashed_words(raw)
        some, first, back = np.unique(h, return_index=True, return_inverse=True)
        table = self.words
        if len(table.hashes) + len(some) > self.most_words:
            table.__init__()
        at = table.find(some)
        if len(new := np.flatnonzero(at < 0)):
            found = [self.cut(raw[a:b].decode()) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            pieces, k, ids = self.pieces_of(found), 0, []
            for own in found:
                ids.append(b"".join(pieces[k : k + len(own)]))
                k += len(own)
            table.add(some[new], ids)
            at = table.find(some)
        begin, size = table.begin[at][back], table.size[at][back]  # of each word of the texts
        until = np.cumsum(size)
        got = table.flat[np.repeat(begin - until + size, size) + np.arange(until[-1] if len(until) else 0)]
        last = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]), "left")
        cuts = np.concatenate([[0], until])[last]
        return np.split(got, cuts[:-1])

    def __call__(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text and the end id, as unsigned 32-bit integers."""
        last = np.array([end], dtype="<u4")
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if (self.special is None or self.special not in t) and PLAIN.fullmatch(t) is not None]
        if plain and self.lower:
            for i, ids in zip(plain, self.words_of([texts[i] for i in plain])):
                out[i] = np.concatenate([ids, last])
        elif plain:
            found = [self.cut(texts[i]) for i in plain]
            ids, at = self.pieces_of(found), 0
            for i, f in zip(plain, found):
                out[i] = np.frombuffer(b"".join(ids[at : at + len(f)]) + last.tobytes(), dtype="<u4")
                at += len(f)
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids + [end], dtype="<u4") if x is None else x for t, x in zip(texts, out)]


_made: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, kind: str, ordinary: bool = False) -> Encoder:
    """One encoder for each Python worker; it lives as long as the worker does."""
    if (path, kind, ordinary) not in _made:
        _made[path, kind, ordinary] = Encoder(path, kind, ordinary)
    return _made[path, kind, ordinary]
