"""Token ids of whole texts by the ``tokenizers`` library, fast on repeated words.

Both vocabularies used here split a text before any merge: no piece crosses
the boundary before a lone space. So a text is cut at its spaces, and the ids
of a chunk, as little-endian 32-bit integers, are kept for the next time it
occurs; only new chunks are split into pieces, and only new pieces reach the
library's model. The kept entries are bounded by number and dropped when full.
Texts with special tokens in them go to the library whole. ``shared_encoder``
keeps an encoder for all partitions that a worker process handles.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from tokenizers import Tokenizer

#: Below this, letters and numbers are the same in every Unicode version; other chunks are left to the library.
_PLAIN = "\u0250"
#: The split patterns of the two vocabulary files, with Unicode's White_Space for \s.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: b if b in shown else next(spare) for b in range(256)}


class _RunOfSpaces(Exception):
    """White space that is not alone: a space may belong to a run, so the text is not cut."""


class TextEncoder:
    """``encode(text)`` gives the ids of a text as bytes of ``<u4``.

    ``lead``: a chunk keeps the space before it (byte-level vocabularies);
    otherwise white space carries no token.
    """

    def __init__(self, path: str, lead: bool, most: int = 1_000_000):
        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._split = regex.compile(_BYTE_LEVEL if lead else _WORD_LEVEL).findall
        self._letters = _byte_letters()
        self._lead = lead
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._chunks = _Kept(self._chunk, most)
        self._pieces = _Kept(self._piece, most // 4)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        if not self._lead:
            return b"".join(map(self._chunks.__getitem__, parts))
        if not parts[0] or parts[0][-1].isspace():
            return self._direct(text)
        try:
            return self._direct(parts[0]) + b"".join(map(self._chunks.__getitem__, islice(parts, 1, None)))
        except _RunOfSpaces:
            return self._direct(text)

    def _chunk(self, part: str) -> bytes:
        """Ids of what stands between two spaces; a word, or one with a full stop or comma, needs no pattern."""
        if self._lead and (not part or part[0].isspace() or part[-1].isspace()):
            raise _RunOfSpaces
        if part.isascii() or max(part) < _PLAIN:
            if not self._lead:
                part = part.lower()
            if part.isalpha():
                return self._piece(" " + part) if self._lead else self._pieces[part]
            if part[-1:] in (".", ",") and part[:-1].isalpha():
                return (self._chunks if self._lead else self._pieces)[part[:-1]] + self._pieces[part[-1]]
            if not self._lead:
                return self._cut(part)
        return self._direct(" " + part if self._lead else part)

    def _direct(self, text: str) -> bytes:
        if text and max(text) >= _PLAIN:
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._cut(text if self._lead else text.lower())

    def _cut(self, text: str) -> bytes:
        """Ids of a text below ``_PLAIN``, which is composed already; in lower case where the vocabulary is."""
        return b"".join(map(self._pieces.__getitem__, self._split(text)))

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isalpha()
        letters = piece if plain else piece.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()


@lru_cache(maxsize=1)
def shared_encoder(path: str, lead: bool) -> TextEncoder:
    """The encoder of this process: what one partition has learnt serves the next."""
    return TextEncoder(path, lead)


class _Kept(dict):
    """Values made on demand; of the keys, those used in the last ``most / 2`` insertions stay."""

    def __init__(self, make, most: int):
        self._make, self._half, self._old = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
            if len(key) > 64:
                return value
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value
