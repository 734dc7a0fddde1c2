"""Token counts by count-only Viterbi over a unigram vocabulary.

Method: an Aho-Corasick automaton enumerates every vocabulary piece that ends at each character of a word;
dynamic programming carries the best score of the prefix and the number of pieces of that best path, and no
path. Ties follow the tokenizers library's Unigram model: among equal scores the piece that begins
first stays. A character that no piece covers costs the least score less ten and counts as its bytes, as
with byte fallback. Words are cut as by Metaspace: a space becomes the mark that starts the next word, and
the text starts with a mark. Words are counted once a batch, and remembered up to a fixed number.

Defined results: a null or empty text has no tokens. Null ids and repeated rows are carried along.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import portions

MARK = "▁"
PENALTY = 10.0  # fixed value of the library
MOST_WORDS = 700_000
MOST_REMEMBERED = 200  # characters of a word that is remembered


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file."""
    held = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(held.id_to_piece(i), held.get_score(i)) for i in range(held.get_piece_size())]


class Counter:
    """Counts the pieces of words by a list of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best path of one word."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        filled = 0  # prefixes up to here have their final score
        high, steps, first = None, 0, n
        single = self.single
        for end, (length, score) in self.automaton.iter(word):
            end += 1
            if end != filled + 1:
                self._close(word, best, count, filled, high, steps, first)
                filled += 1
                while filled + 1 < end:
                    self._close(word, best, count, filled, None, 0, n)
                    filled += 1
                high = None
            start = end - length
            score += best[start]
            if high is None or score > high or score == high and start < first:
                high, steps, first = score, count[start] + 1, start
        if n:
            self._close(word, best, count, filled, high, steps, first)
            for at in range(filled + 1, n):
                self._close(word, best, count, at, None, 0, n)
        return count[n]

    def _close(self, word: str, best: list, count: list, at: int, high: float | None, steps: int, first: int) -> None:
        """Settle the prefix of ``at`` + 1 characters: the best piece that ends there, or its last character unknown."""
        if word[at] not in self.single:
            score = best[at] + self.unknown
            if high is None or score > high:
                high, steps = score, count[at] + len(word[at].encode("utf-8", "replace"))
        best[at + 1], count[at + 1] = high, steps

    def learn(self, words: set[str]) -> None:
        known = self.known
        if len(known) > MOST_WORDS:
            self.known = known = {w: known[w] for w in words if w in known}
        for w in words.difference(known):
            known[w] = self.count(w)


def cut(text: str | None) -> list[str]:
    """The words of a text, each with its mark."""
    if not text:
        return []
    whole = text.replace(" ", MARK)
    parts = (whole[1:] if whole[0] == MARK else whole).split(MARK)
    return [MARK + x for x in parts]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_texts(texts: list[str | None], path: str) -> list[int]:
    held, out = counter(path), []
    for some in portions(texts):
        words = [cut(t) for t in some]
        held.learn({w for w in set().union(*words) if len(w) <= MOST_REMEMBERED})
        known = held.known
        for ws in words:
            out.append(sum([known[w] if len(w) <= MOST_REMEMBERED else held.count(w) for w in ws]))
    return out


def token_counts(text: str | Column, path: str) -> Column:
    """Number of tokens of a text column by the vocabulary file at ``path``."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(count_texts(texts.tolist(), path), dtype="int64")

    return F.pandas_udf(run, "long")(F.col(text) if isinstance(text, str) else text)
