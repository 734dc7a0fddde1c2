"""BPE encoding and decoding by traversing a trie of distinct words.

Method: the distinct words of a batch go into a trie whose edges are the vocabulary's first symbols. In
byte-pair encoding every prefix of an encoding is the encoding of the prefix it covers, so an encoding
is fixed by its last token at each prefix. The traversal walks the trie depth-first and gives every node
the last token of its prefix: the one vocabulary entry that ends there and may follow the last token
of the node where it begins. Prefixes that words share are thus encoded once. Two tokens may
follow each other if no merge across their border comes before the merges that made them.

A document's ids are those of its words in turn. Batches bound the trie; words seen before are
remembered up to a fixed number. The job is one pass over the rows, without a shuffle.

Defined results: a null or empty text has no ids and the decoding "". Special strings in a text become
their ids, as in the library. Null ids and repeated rows are carried along.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows
from .words import END, SHORT, Encoded, portions, words_of

NEVER = 1 << 60
MOST_WORDS, MOST_PIECES = 500_000, 700_000


class Merges:
    """A BPE vocabulary seen from the side of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right) of the merge that makes it
        for r, (a, b) in enumerate(pairs):
            self.made.setdefault(self.ids[a + b], (r, self.ids[a], self.ids[b]))
        self.right = {t: self._spine(t, 2) for t in self.names}
        self.left = {t: self._spine(t, 1) for t in self.names}
        self.follows: dict[int, bool] = {}
        #: Symbols of each token: a letter, or a letter with the word's end.
        self.symbols = {t: self._symbols(name) for t, name in self.names.items()}
        #: Tokens by their symbols backwards: nested {symbol: node}, a token under the key None.
        self.back: dict = {}
        for t, made_of in self.symbols.items():
            if len(made_of) == 1 or t in self.made:
                node = self.back
                for s in reversed(made_of):
                    node = node.setdefault(s, {})
                node[None] = t

    def _symbols(self, name: str) -> tuple[str, ...]:
        if name.endswith(END) and name != END:
            return (*name[: -len(END) - 1], name[-len(END) - 1 :])
        return tuple(name)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outermost parts on one side, each with the rank of the merge that takes it up."""
        out, taken = [], NEVER
        while True:
            out.append((token, taken))
            if token not in self.made:
                return out
            taken, token = self.made[token][0], self.made[token][side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the symbols of ``a`` and ``b`` together are encoded as these two tokens."""
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            rank = self.rank.get
            known = True
            for x, taken_x in self.right[a]:
                for y, taken_y in self.left[b]:
                    r = rank((x, y))
                    # at equal ranks the merge farther left comes first: it takes x before y, but the border before y's own
                    if r is not None and r < taken_x and r <= taken_y:
                        known = False
            self.follows[key] = known
        return known

    def merged(self, symbols: tuple[str, ...]) -> list[int]:
        """Plain merging, lowest rank and then leftmost first; for words that the walk can't settle."""
        ids = [self.ids[s] for s in symbols]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: (self.rank.get((ids[i], ids[i + 1]), NEVER), i))
            if (ids[best], ids[best + 1]) not in self.rank:
                break
            made = self.ids[self.names[ids[best]] + self.names[ids[best + 1]]]
            ids[best : best + 2] = [made]
        return ids

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of every distinct word, by one depth-first traversal of their trie.

        Sorted words are their trie in depth-first order: what a word shares with the one before are
        the nodes above it on the path, whose states stay, and the rest are its new nodes.
        """
        out: dict[str, list[int]] = {}
        #: Last token and its length at each node of the path; the root has none.
        tokens, lengths = [-1], [0]
        above = ""
        back, follows = self.back, self.follows
        for word in sorted(set(words)):
            shared, most = 0, min(len(word), len(above)) - 1  # the last letter bears the word's end and is a leaf
            while shared < most and word[shared] == above[shared]:
                shared += 1
            del tokens[shared + 1 :], lengths[shared + 1 :]
            path = list(word)
            path[-1] += END
            for depth in range(shared, len(path)):
                node, at = back, depth
                token, length = -1, 0
                while at >= 0 and (node := node.get(path[at])) is not None:
                    found = node.get(None)
                    if found is not None:
                        before = tokens[at]
                        if before >= 0:
                            ok = follows.get(before << 32 | found)
                            if ok or ok is None and self.may_follow(before, found):
                                token, length = found, depth + 1 - at
                                break
                        elif not at:
                            token, length = found, depth + 1
                            break
                    at -= 1
                tokens.append(token)
                lengths.append(length)
            above = word
            ids, at = [], len(path)
            while at and (token := tokens[at]) >= 0:
                ids.append(token)
                at -= lengths[at]
            out[word] = self.merged(tuple(path)) if at else ids[::-1]
        return out

@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def coder(path: str) -> Encoded:
    """Gives each piece of text its ids (little-endian) and its decoding."""
    vocabulary = merges(path)
    known: dict[str, tuple[bytes, bytes]] = {}

    def encode(pieces: list[str]) -> list[tuple[bytes, bytes]]:
        cut = [None if p in held.special else words_of(p, path) for p in pieces]
        met = {w for ws in cut if ws for w in ws}
        if len(known) > MOST_WORDS:
            for w in known.keys() - met:
                del known[w]
        new = met.difference(known)
        names = vocabulary.names
        for w, ids in vocabulary.encode(new).items():
            known[w] = (array("I", ids).tobytes(), (" ".join([names[i] for i in ids]) + " ").encode())
        out = []
        for p, ws in zip(pieces, cut, strict=True):
            if ws is None:
                out.append((array("I", [held.special[p]]).tobytes(), f"{p} ".encode()))
            elif len(ws) == 1:
                out.append(known[ws[0]])
            else:
                out.append((b"".join([known[w][0] for w in ws]), b"".join([known[w][1] for w in ws])))
        for w in new:  # only short words are kept for the next batch, so that memory is bounded by bytes
            if len(w) > SHORT:
                del known[w]
        return out

    held = Encoded(path, encode, most=MOST_PIECES)
    return held


def encode_texts(texts: list[str | None], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8, of each text.

    The vocabulary has no decoder, so decoding joins the names of the ids with spaces.
    """
    held = coder(path)
    for some in portions(texts):
        cut = [held.pieces(t) for t in some]
        known = held.learn(cut)
        for pieces in cut:
            found = list(map(known, pieces))
            yield b"".join([x[0] for x in found]), b"".join([x[1] for x in found])[:-1]


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encoded(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the ids in bytes and the decoded text."""

    def run(texts: list) -> tuple[list[int], dict[str, list]]:
        ids, decoded = zip(*encode_texts(texts, path), strict=True) if texts else ((), ())
        return list(range(len(texts))), {
            "n_tokens": [len(x) // 4 for x in ids], "ids": list(ids), "decoded": [x.decode() for x in decoded],
        }

    return map_rows(docs, run, [text], keep, FIELDS)


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and SHA-256 of the ids and of the decoded text; one document's output is held at a time."""

    def run(texts: list) -> tuple[list[int], dict[str, list]]:
        made = [(len(i) // 4, sha256(i).hexdigest(), sha256(d).hexdigest()) for i, d in encode_texts(texts, path)]
        return list(range(len(texts))), {f.name: [x[k] for x in made] for k, f in enumerate(DIGESTS)}

    return map_rows(docs, run, [text], keep, DIGESTS)
