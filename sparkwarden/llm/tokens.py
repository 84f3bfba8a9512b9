"""Token ids of whole texts with a public tokenizer file.

``Encoder`` gives what the tokenizers library gives for the whole text.  As that library needs some ten
microseconds a word, it is asked once for each different word: the tokenizer's normaliser and splitter never
look across white space, nor from a letter or digit to the punctuation after it, so a text's ids are those
of its parts in turn.  A part of lower-case Latin letters goes straight to the library's BPE model.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

from sparkwarden.llm.common import process_cache

TAIL = ".,!?;:"
#: Different words that a worker keeps.
KEPT = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next free one after U+00FF."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)}


class Encoder(dict):
    """word (UTF-8, without ASCII white space) -> its ids as little-endian numbers of ``dtype``."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        self[word] = ids = self._encode(word)
        return ids

    def _encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        core = text.rstrip(TAIL)
        if core and core != text and core[-1].isalnum():
            return self[core.encode()] + self[text[len(core) :].encode()]
        latin = text.isalpha() and max(text) < "ɐ"
        if latin and text != text.lower() and text.isascii():
            return self[text.lower().encode()]
        if latin and text.islower() and unicodedata.is_normalized("NFC", text):
            found = [t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(self.letters.__getitem__, word)))]
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, self.dtype).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (null: none)."""
        parts = (text or "").encode("utf-8", "surrogatepass").split()
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), self.dtype)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per Python worker."""
    return process_cache(f"encoder {path}", lambda: Encoder(path))
