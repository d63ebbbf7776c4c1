"""Token ids of whole texts by the tokenizers library, with a memo of pieces.

The library's pre-tokenizers never put text before and after a run of white space in one token, so a text can be cut
there and equal pieces need encoding only once per worker. Texts with white space or control characters on which
regular-expression libraries differ go to the library whole, and so do texts with the string of a special token, which
the library turns into that token's id.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable

#: Pieces that a worker remembers as the latest, besides as many older ones that have not come up since.
MEMO = 600_000

_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A word of Latin letters and the ASCII punctuation after it: the pre-tokenizers keep both whole, and apart from each
#: other where no apostrophe is among them.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Marks a piece that is encoded as it is; other pieces of byte-level tokenizers follow a space. No text has this character.
_BARE = "\ud800"


class Memo(dict):
    """The ids of pieces, made where they are not known; the least used half goes once there are too many."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. ``path`` is a tokenizer file of the library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        if any(token.normalized for token in added):
            raise ValueError("added tokens that are found after normalisation are not supported")
        self.special = [token.content for token in added]
        self.tokenize = self.library.model.tokenize
        # Without a normalizer white space becomes tokens; with one that folds it, words stand alone.
        self.spaces = self.library.normalizer is None
        # Byte-level models see each byte as a letter: visible ones of Latin-1 as themselves, others from 256 on.
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + n for n, b in enumerate(hidden)}
        self.before = chr(self.letters[32]) if self.spaces else ""
        self.memo, self.marks = Memo(self._make), Memo(self._whole)
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str, before: str) -> bytes:
        """A word straight through the library's model, which is all that its pipeline would do with it."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.tokenize(before + word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, None if it has to go to the library whole."""
        for token in self.special:
            if token in text:
                return None
        words = text.split()
        plain = text.count(" ") + text.count("\n")
        # All white space is single spaces and line ends between words: nothing odd, nothing in a row.
        if len(words) == plain + 1 and sum(map(len, words)) == len(text) - plain:
            if not self.spaces:
                return words
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = _BARE + pieces[0]
            return pieces
        if _ODD.search(text):
            return None
        if not self.spaces:
            return words
        return [p[1:] if p[0] == " " and p[1:].strip() else _BARE + p for p in _PIECES.findall(text)]

    def _text(self, piece: str) -> str:
        if not self.spaces or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == _BARE else " " + piece

    def _make(self, piece: str) -> bytes:
        """The ids of a new piece: of its word and of the punctuation after it, if it is of that kind."""
        head, word, before = b"", piece, self.before
        if self.spaces and piece[0] in ("\n", _BARE):
            head, word, before = self.line if piece[0] == "\n" else b"", piece[1:], ""
        found = _WORD.fullmatch(word)
        if not found:
            return self._whole(self._text(piece))
        word, marks = found.groups()
        if marks:
            return self.memo[piece[: -len(marks)]] + self.marks[marks]
        if not self.spaces and not word.islower():
            return self.memo[word.lower()]
        return head + self._word(word, before)

    def encode(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        """The ids of each text, in order; null is the empty text."""
        known = self.memo.__getitem__
        for text in texts:
            pieces = self._pieces(text) if text else []
            yield self._whole(text) if pieces is None else b"".join(map(known, pieces))


#: The encoders of this worker by tokenizer file; they outlive a task with their memos.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
