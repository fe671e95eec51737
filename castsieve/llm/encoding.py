"""Token ids of whole texts by the ``tokenizers`` library, word by word.

Both tokenizers used here cut a text into pieces by a pattern and encode every
piece on its own, so the ids of a text are those of its words one after another.
Words repeat; each worker keeps the ids of words and pieces it has met, up to a
fixed number, and asks the library's model only for new pieces.  Texts with
characters outside the range for which the cut is known to agree go to the
library whole.
"""

from __future__ import annotations

import string
from array import array


import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

# Words remembered per worker in each of two generations: when the younger is
# full it becomes the older, and what the older held is forgotten.
REMEMBERED = 200_000

# Outside these characters classes or cases could differ between libraries.
_UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7E¡-ɏ]")
_USUAL_ASCII = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F)])


def _unusual(text: str) -> bool:
    if text.isascii():
        return bool(text.encode().translate(None, _USUAL_ASCII))
    return _UNUSUAL.search(text) is not None


_PUNCTUATION = string.punctuation


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


_LETTER = _byte_letters()
_BLANK = _LETTER[0x20]


class WordEncoder:
    """Encode texts to little-endian unsigned 32-bit ids."""

    # The patterns by which the two vocabularies cut a text.
    PATTERNS = {
        "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    }

    def __init__(self, name: str, path: str | None = None, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(name))
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.pattern = regex.compile(self.PATTERNS[name])
        self.keeps_blanks = name == "byte_bpe_50k.json"
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null and empty texts."""
        out = []
        for text in texts:
            if len(self.young) > self.remembered:
                self.young, self.old = {}, self.young
            out.append(self._text(text) if text else b"")
        return out

    def _text(self, text: str) -> bytes:
        if "\0" in text:
            return self._whole(text)
        words = self._split(text)
        young, old = self.young, self.old
        new = set(words).difference(young)
        if new and _unusual(text):
            return self._whole(text)
        for word in new:
            if self.keeps_blanks and not word.rstrip():
                if word != "\n":
                    # A run of white space: its pieces span what was split.
                    return b"".join([self._piece(p) for p in self.pattern.findall(text)])
            young[word] = old.get(word) or self._word(word)
        return b"".join(map(young.__getitem__, words))

    def _split(self, text: str) -> list[str]:
        """Parts of the text whose ids do not depend on each other."""
        if not self.keeps_blanks:
            return text.replace("\n", " ").lower().split(" ")
        # Single line ends stand alone; a blank goes with the word after it.
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _word(self, word: str) -> bytes:
        bare = word.rstrip(_PUNCTUATION)
        if bare and bare != word and bare[-1].isalnum():
            ids = self.young.get(bare) or self.old.get(bare)
            if ids is None:
                ids = self.young[bare] = self._pieces(bare)
            return ids + self._piece(word[len(bare) :])
        return self._pieces(word)

    def _pieces(self, word: str) -> bytes:
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            return self._ids(word)
        return b"".join([self._piece(p) for p in self.pattern.findall(word)])

    def _piece(self, piece: str) -> bytes:
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            ids = self.young[piece] = self._ids(piece)
        return ids

    def _ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            # Of these only the blank has another letter.
            letters = piece.replace(" ", _BLANK)
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTER)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple[str, str | None], WordEncoder] = {}


def encoder(name: str, path: str | None = None) -> WordEncoder:
    """The worker's encoder; kept from task to task with what it remembers."""
    if (name, path) not in _ENCODERS:
        _ENCODERS[name, path] = WordEncoder(name, path)
    return _ENCODERS[name, path]
