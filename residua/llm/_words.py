"""Words of byte-level tokenizers, and a bounded memory of how they are encoded."""

from __future__ import annotations

import re
from collections.abc import Callable

# Fixed value: the pattern by which byte-level tokenizers cut a text into words.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of Latin-1 characters, whose letters and numbers are listed;
# the plainer engine cuts them in half the time.
_LETTERS, _NUMBERS = "A-Za-zÀ-ÖØ-öø-ÿªµº", "0-9²³¹¼½¾"
_LATIN = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+").findall
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text into the matches of ``pattern``."""
    import regex

    general = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return general

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        # The two engines differ on what separates: leave such texts to the first.
        return general(text) if _SEPARATORS(text) else _LATIN(text)

    return cut


class Memory:
    """Encodes texts word by word, each distinct word once.

    ``encode_words`` gives the encoding of each of a list of words, ``join``
    puts those of a text's words together.  Past ``most`` words the memory is
    emptied, and words that come again are encoded again.
    """

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list], join: Callable, most: int):
        self.cut, self.encode_words, self.join, self.most = cutter(pattern), encode_words, join, most
        self.words: dict[str, object] = {}

    def encode(self, texts: list[str | None]) -> list:
        """The encoding of each text; null is an empty text."""
        cut = [self.cut(t) if t else [] for t in texts]
        words, known = set().union(*cut), self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(words)
        if new:
            known.update(zip(new, self.encode_words(new), strict=True))
        return [self.join(map(known.__getitem__, w)) for w in cut]


class _Spots(dict):
    """A table in which a word that is looked up and missing gets an empty place."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> bytearray:
        self[word] = spot = bytearray()
        self.fresh.append(word)
        return spot


class Packed:
    """As ``Memory`` for encodings in bytes, with one look-up for each word: a new
    word's place is taken at once and filled when its batch has been read."""

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]], most: int):
        self.cut, self.encode_words, self.most = cutter(pattern), encode_words, most
        self.words = _Spots()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The encoding of each text; null is an empty text."""
        if len(self.words) > self.most:
            self.words = _Spots()
        known = self.words
        parts = [list(map(known.__getitem__, self.cut(t))) if t else [] for t in texts]
        if known.fresh:
            for word, found in zip(known.fresh, self.encode_words(known.fresh), strict=True):
                known[word].extend(found)
                known[word] = found
            known.fresh = []
        return list(map(b"".join, parts))
