"""Token ids of whole texts with a public vocabulary file, as little-endian unsigned 32-bit bytes.

``Encoder`` gives exactly what the tokenizers library gives for the whole text: it cuts a text only where no rule of the
vocabulary file can look across (a blank), and keeps the ids of pieces it has met. Pieces of plain Latin letters go
straight to the vocabulary's model; every other piece goes through the whole tokenizer.
"""
from __future__ import annotations

import os
import re
import struct

#: Words and pieces kept per worker, at most; later ones are worked out each time (the ids stay the same).
KEPT_WORDS, KEPT_PIECES = 900_000, 600_000
END_ID = 2

#: A word of Latin letters and a run of marks (no apostrophe), perhaps twice with a line break between.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*))?")
_SAFE_BLANK = re.compile(r"(?<=\S) ")


def byte_letters() -> dict[int, str]:
    """The byte-to-letter table of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class Encoder:
    """Ids of texts; ``path`` is a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.tokenizer.normalizer is not None  # lower case and no blanks; else blanks belong to the next word
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.whole: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _model(self, piece: str) -> bytes:
        have = self.plain.get(piece)
        if have is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin1").translate(self.letters))]
            have = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.plain) < KEPT_WORDS:
                self.plain[piece] = have
        return have

    def _piece(self, piece: str, blank: str = "") -> bytes:
        """The ids of a piece that has ``blank`` before it; kept if it may be met again."""
        if piece.isascii() and piece.isalpha():
            out = self._model((blank + piece).lower() if self.words else blank + piece)
        elif plain := _PLAIN.fullmatch(piece):
            word, *more = plain.groups()
            parts = [blank + word, *(p for p in more if p)]
            out = b"".join([self._model(p.lower() if self.words else p) for p in parts])
        else:
            ids = self.tokenizer.encode(blank + piece, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.whole) < KEPT_PIECES and (blank or self.words):
            self.whole[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, without special tokens added; null counts as empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):  # such strings may span blanks in other files: no cutting
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known, piece = self.whole.get, self._piece
        if self.words:
            return b"".join([known(p) or piece(p) if p else b"" for p in text.replace("\n", " ").split(" ")])
        single = len(text.split()) == text.count(" ") + text.count("\n") + 1  # no white space next to other white space
        head, *tail = text.split(" ") if single else _SAFE_BLANK.split(text)
        return (piece(head) if head else b"") + b"".join([known(p) or piece(p, " ") for p in tail])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
