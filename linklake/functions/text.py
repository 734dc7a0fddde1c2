"""Tokenising for search and word extraction for link memory."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .urls import literal_array


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the unit in which the length limits are stated."""
    astral = F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(c) + astral


def shortened(c: Column, length: int | None) -> Column:
    """The first ``length`` characters, or the whole text where no length is given."""
    return c if length is None else F.left(c, F.lit(length))


def fold_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(rules.WHITESPACE))


def clean_label(c: Column) -> Column:
    return fold_space(F.regexp_replace(c, rules.EMOJI, ""))


def _may_fold(t: Column) -> Column:
    return t.endswith("s") | t.endswith("ing") | t.endswith("ed")


def stem(t: Column) -> Column:
    """Fold plain English suffixes; the first rule that applies wins.

    Most tokens end in none of them, which is seen without a regular expression.
    """
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n < 4) | ~_may_fold(t), t)
        .when(t.rlike("[^a-z0-9]"), t)
        .when(t.endswith("ies") & t.rlike("[^aeiou]ies$"), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("es") & t.rlike("(sses|shes|ches|xes)$"), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss"), cut(1))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 5) & t.endswith("ed"), cut(2))
        .otherwise(t)
    )


def _bigrams(run: Column) -> Column:
    return F.when(
        F.length(run) > 1,
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))


def run_tokens(run: Column) -> Column:
    """Tokens of one latin or CJK run. Short CJK runs are emitted twice, which raises their tf.

    No higher-order functions: Spark would interpret them, and with them all that is done to a run.
    """
    n = F.length(run)
    none = F.array().cast("array<string>")
    cjk = F.concat(
        F.when(n == 1, F.array(run)).otherwise(none),
        F.regexp_extract_all(run, F.lit("(?=(..))"), F.lit(1)),
        F.when(n <= 4, F.array(run)).otherwise(none),
    )
    joined = functools.reduce(lambda a, b: a | b, [run.contains(x) for x in ".+#_-"])
    parts = F.when(joined, F.regexp_extract_all(run, F.lit("[^.+#_-]{3,}"), F.lit(0))).otherwise(none)
    stemmed = stem(run)
    latin = F.concat(F.array(run), F.when(stemmed != run, F.array(stemmed)).otherwise(none), parts)
    # Most runs are one token.
    plain = (F.octet_length(run) == n) & ~joined & ~_may_fold(run)
    return F.when(plain, F.array(run)).when((F.octet_length(run) > n) & run.rlike(rules.CJK_LETTER), cjk).otherwise(latin)


def explode_tokens(df: DataFrame, text: str, token: str = "token") -> DataFrame:
    """One row per token of ``text``; runs are exploded first so each run is handled in codegen."""
    keep = [c for c in df.columns if c != text]
    runs = df.select(
        *keep, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(rules.TOKEN_RUN), F.lit(0))).alias("_run")
    )
    return runs.select(*keep, F.explode(run_tokens(F.col("_run"))).alias(token))


def own_words(text: Column, limit: int | None = None) -> Column:
    """What a message says itself: no code, foreign tags, quotes, log lines or links; cut to ``limit`` characters if given."""
    s = F.regexp_replace(text, r"(?s)```.*?```", " ")
    s = F.regexp_replace(s, r"(?is)<(?!pasted_content\b)([a-z_-]+)[^>]*>.*?</\1>", " ")
    lines = F.filter(
        F.split(s, "\n"), lambda l: ~(l.rlike(r"(?U)^\s*>") | l.rlike(rules.CODE_OR_LOG_LINE))
    )
    own = F.regexp_replace(F.array_join(lines, " "), rules.MESSAGE_LINK, " ")
    return own if limit is None else F.left(own, F.lit(limit))


def memory_words(text: Column) -> Column:
    """Distinct words that can identify a link: latin words, and CJK pairs without function characters."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rules.MEMORY_RUN), F.lit(0))
    words = F.flatten(
        F.transform(
            runs,
            lambda w: F.when(
                w.rlike("[一-鿿]"), F.filter(_bigrams(w), lambda p: ~p.rlike(rules.FUNCTION_CHARS))
            ).otherwise(
                F.when((F.length(w) > 2) | w.rlike(r"[a-z]\d|\d[a-z]"), F.array(w)).otherwise(
                    F.array().cast("array<string>")
                )
            ),
        )
    )
    kept = F.filter(words, lambda t: ~t.isin(rules.FILLER_WORDS) & ~t.rlike(r"^\d+$"))
    return F.array_distinct(kept)


def is_relayed(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.RELAYED), F.lit(False))


