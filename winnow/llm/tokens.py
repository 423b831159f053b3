"""Whole texts to token ids of a public tokenizer, word by word through a cache that a worker keeps between tasks."""

from __future__ import annotations

import array
import os
import sys

CACHE_WORDS = 1_000_000
END_ID = 1
TRAILING = b".,!?:;#*$%&|<>"
_encoders: dict[str, "WordEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    others = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder:
    """Ids of a white-space free piece of a text as little-endian 32-bit bytes; new pieces are encoded and kept.

    The tokenizer never joins characters across white space, so a text's ids are those of its pieces in order. Pieces
    of plain Latin letters go to the vocabulary model directly: normalisation and splitting leave them as they are.
    Others go through the whole tokenizer. A piece of letters with ASCII marks behind is two pieces to the tokenizer's
    splitting rule as well, and is encoded as such. The cache holds a bounded number of pieces and then starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(byte_letters())

    def _ids(self, piece: bytes) -> bytes:
        found = self.known.get(piece)
        if found is None:
            core = piece.rstrip(TRAILING)
            if core != piece and core and b"<|" not in piece and self._plain(core):
                found = self._ids(core) + self._ids(piece[len(core) :])
            else:
                found = self._encode(piece)
            self.known[piece] = found
        return found

    @staticmethod
    def _plain(piece: bytes) -> bool:
        """Lower-case composed letters of the Latin blocks only."""
        if piece.isascii():
            return piece.isalpha() and piece.islower()
        word = piece.decode("utf-8", "replace")
        return word.isalpha() and word.islower() and max(word) < "ƀ" and "İ" not in word and "ŉ" not in word

    def _encode(self, piece: bytes) -> bytes:
        if self._plain(piece):
            ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        packed = array.array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers, without the end id."""
        data = (text or "").encode("utf-8")
        # special tokens are matched before lower-casing, so texts that may hold one keep their case
        if b"<|" not in data:
            data = data.lower()
        pieces = data.split()
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            return b"".join(map(self._ids, pieces))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
