"""Cutting texts into the words of the vocabulary file word_bpe_49k.json, exactly as its library does.

The library finds the two special strings in the raw text first; then it composes to NFC, makes white
space plain, lower-cases, and cuts by a pattern whose matches never hold white space. So the pieces
between white space can be worked on one by one, and equal ones only once. Texts with characters that
this module doesn't know for certain go through the library's own normaliser and cutter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from tokenizers import Tokenizer

# fixed values of the vocabulary file: pattern of words, for characters that SAFE admits
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Latin letters, ASCII marks and the usual spaces: lower-casing, NFC and classes are certain here
UNSURE = re.compile("[^\t-\r\x20-\x7e\xa1\xab\xbb\xbf-\xd6\xd8-\xf6\xf8-įĹ-ňŊ-ž–—‘-”…€]")
END = "</w>"
SHORT = 64


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    """The library's tokenizer, truncation and padding off."""
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=4)
def specials(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def spelled(word: str) -> str:
    """A word in byte letters."""
    if word.isascii():
        return word
    letters = byte_letters()
    return "".join([letters[b] for b in word.encode("utf-8")])


def words_of(piece: str, path: str) -> list[str]:
    """The words of a text without special strings, in byte letters."""
    if not UNSURE.search(piece):
        return [spelled(w) for w in WORD.findall(piece.lower())]
    own = library(path)
    return [w for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(piece))]


def portions(texts: list[str | None], most: int = 8_000_000) -> Iterator[list[str | None]]:
    """The texts in lists of about ``most`` characters, or of one longer text."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


class Pieces:
    """Cuts texts into pieces."""

    def __init__(self, path: str):
        self.special = specials(path)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def pieces(self, text: str | None) -> list[str]:
        """The text's pieces; special strings and texts of doubtful characters are pieces themselves."""
        if not text:
            return []
        if "<|" in text and self.cut.search(text):
            parts = [x for x in self.cut.split(text) if x]
            return [y for x in parts for y in ([x] if x in self.special or UNSURE.search(x) else x.split())]
        return [text] if UNSURE.search(text) else text.split()


class Recalled(Pieces, dict):
    """What each piece becomes, worked out by ``encode`` when it is first looked up, and kept for later texts.

    Pieces are kept in two generations of about ``most``: a full one becomes the old one, and of the old one those that are met
    again move on, so that frequent pieces stay. Those of over ``SHORT`` characters, such as whole texts of doubtful
    characters, are forgotten once they hold ``long`` characters. That bounds memory by bytes and changes no result.
    """

    def __init__(self, path: str, encode: Callable[[str], bytes], most: int = 400_000, long: int = 8_000_000):
        Pieces.__init__(self, path)
        self.encode, self.most, self.most_long = encode, most, long
        self.old: dict[str, bytes] = {}
        self.long, self.long_size = [], 0

    def __missing__(self, piece: str) -> bytes:
        value = self.old.pop(piece, None)
        if value is None:
            value = self.encode(piece)
        self[piece] = value
        if len(piece) > SHORT:
            self.long.append(piece)
            self.long_size += len(piece)
        return value

    def joined(self, text: str | None) -> bytes:
        """What the text's pieces become, in turn."""
        if self.long_size > self.most_long:
            for x in self.long:
                self.pop(x, None)
            self.long, self.long_size = [], 0
        if len(self) > self.most:
            for x in self.long:  # they don't grow old
                self.pop(x, None)
            self.long, self.long_size, self.old = [], 0, dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.pieces(text)))


class Encoded(Pieces):
    """What each piece between white space becomes, worked out once for a batch and kept for the next.

    ``encode`` takes the batch's unknown pieces and gives their values. When it holds over ``most``
    pieces only those of the present batch stay, and pieces of over ``SHORT`` characters, such as whole texts of doubtful
    characters, are forgotten when the next batch comes. That bounds memory by bytes and changes no result.
    """

    def __init__(self, path: str, encode: Callable[[list[str]], list], most: int = 450_000):
        super().__init__(path)
        self.encode, self.most, self.known, self.long = encode, most, {}, []

    def learn(self, texts: list[list[str]]) -> Callable[[str], object]:
        """Make every piece of the batch known; gives the look-up."""
        met = set().union(*texts)
        for x in self.long:  # those of the batch before
            del self.known[x]
        if len(self.known) > self.most:
            self.known = {x: self.known[x] for x in met if x in self.known}
        new = list(met.difference(self.known))
        if new:
            self.known.update(zip(new, self.encode(new), strict=True))
        self.long = [x for x in new if len(x) > SHORT]
        return self.known.__getitem__
