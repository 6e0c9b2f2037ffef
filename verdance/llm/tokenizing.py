"""Encoding of whole texts with a public tokenizer, one word at a time.

Both vocabularies merge within pre-tokens only.  A space before a character that
is not white always begins a pre-token, whatever stands before it, so a text's ids
are those of the pieces between such spaces in a row.  A vocabulary that drops
white space can be cut at every space.  A worker remembers the pieces it has met.  New
pieces are encoded together as one text.  Where its ids are to be cut again
follows from the bytes that each id stands for, if the vocabulary keeps every
byte; else from a sign between the pieces, which white space sets apart.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Pieces that a worker remembers at least, and twice that at most: the older half goes when the newer is full.
REMEMBERED = 500_000
#: Pieces of one call.
TOGETHER = 500
#: Stands between pieces of a vocabulary that drops white space.
SIGN = "\x01"

#: A piece that ends in up to four marks after a letter or a digit whose lower case and normal form are one too.
_MARKED = re.compile(r"(.*[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f])([.,;:!?#$%&*)\]}|]{1,4})", re.S).fullmatch

#: White space beside a space, and where such a text can be cut all the same.
_BLANKS = re.compile(r" [\s\u180e]| $").search
_CUT = re.compile(r" (?=[^\s\u180e])").split

#: Two words with a line end between them.
_BROKEN = re.compile(r"([^\s]+)\n([^\s]+)").fullmatch

_encoders: dict[tuple[str, bool], "PieceEncoder"] = {}


def _plainer(text: str) -> str:
    """For a vocabulary of lower case without white space: fewer different pieces, the same ids."""
    text = text.replace("\n", " ")
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()  # below U+0100 as the vocabulary's own


class _Pieces:
    """ids, as bytes, of pieces that follow ``lead``."""

    def __init__(self, owner: "PieceEncoder", lead: str):
        self.owner, self.lead = owner, lead
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Add pieces that the newer half lacks."""
        young, old, todo, marked, broken = self.young, self.old, [], [], []
        if self.lead:  # a line end between two other characters is a pre-token: what stands around it is looked up by itself
            broken = [(x, *m.groups()) for x in new if "\n" in x and (m := _BROKEN(x)) is not None]
            new = new.difference(x for x, _, _ in broken) | {a for _, a, _ in broken}.difference(young)
        for x in new:
            if (ids := old.get(x)) is not None:
                young[x] = ids
            elif x[-1:].isalnum() or (m := _MARKED(x)) is None:
                todo.append(x)
            else:
                marked.append((x, *m.groups()))
        # a letter or digit and a mark are never in one pre-token: both sides are looked up by themselves
        cores = {core for _, core, _ in marked}.difference(young, todo)
        found = [x for x in cores if x in old]
        young.update((x, old[x]) for x in found)
        todo += cores.difference(found)
        for i in range(0, len(todo), TOGETHER):
            some = todo[i:i + TOGETHER]
            young.update(zip(some, self.owner.apart([self.lead + x for x in some]), strict=True))
        marks = self.owner.marks
        for x, core, mark in marked:
            if mark not in marks:
                marks[mark] = self.owner.whole([mark])[0]
            young[x] = young[core] + marks[mark]
        if broken:
            heads = self.owner.heads
            if len(heads) > REMEMBERED // 4:
                heads.clear()
            todo = list({b for _, _, b in broken}.difference(heads))
            heads.update(zip(todo, self.owner.whole(todo)))
            end = self.owner.whole(["\n"])[0]
            for x, a, b in broken:
                young[x] = young[a] + end + heads[b]

    def table(self, texts: list[list[str]]) -> dict[str, bytes]:
        """A table that has all pieces of these texts."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.learn(set(chain.from_iterable(texts)).difference(self.young))
        return self.young


class PieceEncoder:
    """ids of texts as little-endian 32-bit integers."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        if keeps_space:
            size = {i: len(t) for t, i in self.plain.get_vocab().items()}  # a character of a token stands for a byte
            self.bytes_of = np.array([size.get(i, 0) for i in range(max(size) + 1)])
        else:
            from tokenizers import normalizers

            # below U+0100 this vocabulary's normal form is lower case alone, which Python makes faster
            self.bare = Tokenizer.from_file(path)
            self.bare.encode_special_tokens = True
            self.bare.normalizer = normalizers.Sequence([])
            sign = self.bare.encode(SIGN, add_special_tokens=False).ids
            self.cut = sign[0] if len(sign) == 1 else None
        self.keeps_space = keeps_space
        self.marks: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.rest = _Pieces(self, " " if keeps_space else "")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; with keeps_space each is empty, the first of all, or begins with its only space."""
        if self.keeps_space:
            text = "".join(pieces)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            sizes = map(len, pieces) if text.isascii() else (len(x.encode()) for x in pieces)
            at = np.searchsorted(ends, np.cumsum([0, *sizes]))
            begin, end = 4 * at[:-1], 4 * at[1:]
        else:
            text = f" {SIGN} ".join(pieces)
            if self.cut is None or text.count(SIGN) != max(0, len(pieces) - 1):
                return self.whole(pieces)
            simple = text.isascii() or max(text) < "\u0100"
            if not simple and len(pieces) > 1:
                plain = {x: i for i, x in enumerate(pieces) if x.isascii() or max(x) < "\u0100"}
                rest = [x for x in pieces if x not in plain]
                if plain:
                    known = dict(zip(plain, self.apart(list(plain)), strict=True)) | dict(zip(rest, self.whole(rest), strict=True))
                    return [known[x] for x in pieces]
            ids = np.array((self.bare if simple else self.plain).encode_batch_fast([text.lower() if simple else text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.cut)
            begin, end = 4 * np.append(-1, at) + 4, 4 * np.append(at, len(ids))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; '' has none."""
        if not self.keeps_space:
            texts = [_plainer(t) for t in texts]
        cut = [_CUT(t) if self.keeps_space and _BLANKS(t) else t.split(" ") for t in texts]
        heads = [p.pop(0) for p in cut]
        ids = self.rest.table(cut).__getitem__
        return [x + b"".join(map(ids, p)) for p, x in zip(cut, self.whole(heads), strict=True)]


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; keeps_space: byte-level, white space is encoded too."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, keeps_space)
    return _encoders[key]
