"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks.

Method: the ratio of plain to compressed size says how repetitive a text is. A document is kept if
its whole ratio lies in the band for its length, and if few of its bytes lie in fixed chunks whose
own ratio is out of the band for chunks. Short texts compress badly and long ones well, so every
length has limits of its own. They are fitted to the table at hand (``fit_limits``): from the spread of ratios over
the documents labelled good, in classes of length, all of them counted. A class with too few labelled documents takes
the wide limits of ``LIMITS``, which ordinary prose in any script meets.

Defined results: a null or empty text has no words, fails the base rule and is rejected. Repeated
rows get equal verdicts. Null ids and extra columns are carried along and never read. Texts of any length are compressed whole.
Empty tables of documents or labels give the wide limits. Labels that contradict each other for an id don't count, nor do null ids.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """``bands``: (bytes, least ratio, most ratio), ascending; between two entries the limits go straight in the
    logarithm of the bytes. ``chunk``: bytes in a chunk; a chunk is out of band beyond
    ``chunk_low``/``chunk_high``; a document is rejected if more than ``chunk_share`` of its bytes are in such
    chunks. ``level``: zstandard level."""

    bands: tuple[tuple[int, float, float], ...] = (
        (1, 0.0, 2.0), (64, 0.4, 2.5), (256, 0.7, 3.0), (1024, 1.05, 3.5), (4096, 1.25, 4.0), (16384, 1.35, 4.5), (65536, 1.45, 5.0), (1048576, 1.45, 6.0),
    )
    chunk: int = 4096
    chunk_low: float = 1.25
    chunk_high: float = 4.0
    chunk_share: float = 0.25
    level: int = 3


#: Limits that need no sample.
LIMITS = Limits()
#: Classes of length are powers of two; one counts if it has this many labelled documents.
LEAST_LABELLED = 50
#: Share of labelled documents that may lie beyond a limit on its side, before the margins.
BEYOND = 0.0005
MARGIN_LOW, MARGIN_HIGH = 0.3, 0.03  # scripts of several bytes compress less, so there is more room below
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_bytes long, ratio double, worst_chunk_ratio double, bad_chunk_share double"
)
NAMES = [x.split()[0] for x in SCHEMA.split(",")]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in some window of ``window`` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, len(words))
    mixed = np.zeros(n, np.uint64)
    odd = 0x9E3779B97F4A7C15
    for j in range(window):
        mixed += ids[j : j + n].astype(np.uint64) * np.uint64(odd)
        odd = odd * 0xD1342543DE82EF95 % (1 << 64) | 1
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # unequal sums prove unequal windows
        return 0
    width = np.int64(len(words) + 1)
    code = ids
    for j in range(1, window):  # the exact rank of the window's first j+1 words
        code = np.unique(code[: len(words) - j] * width + ids[j:], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    starts = np.concatenate([[0], np.cumsum(again)])
    at = np.arange(len(words))
    return int((starts[np.minimum(at + 1, n)] > starts[np.maximum(at - window + 1, 0)]).sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()  # splits bytes at exactly the six ASCII spaces
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(data.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def chunk_ratios(data: bytes, limits: Limits, squeeze) -> tuple[float, float]:
    """The chunk ratio farthest out of its band (or the largest), and the share of bytes in chunks out of band."""
    if len(data) <= limits.chunk:
        return 0.0, 0.0
    worst, bad = 0.0, 0
    for at in range(0, len(data), limits.chunk):
        part = data[at : at + limits.chunk]
        if len(part) < limits.chunk:  # the last chunk reaches back, so that every chunk has the same size
            part = data[-limits.chunk :]
        ratio = len(part) / len(squeeze(part))
        worst = max(worst, ratio)
        if not limits.chunk_low <= ratio <= limits.chunk_high:
            bad += min(limits.chunk, len(data) - at)
    return worst, bad / len(data)


def band(n_bytes: int, limits: Limits) -> tuple[float, float]:
    """The least and the most ratio for a text of ``n_bytes``."""
    ends, lows, highs = zip(*limits.bands)
    at, ends = math.log2(max(n_bytes, 1)), [math.log2(max(e, 1)) for e in ends]
    return float(np.interp(at, ends, lows)), float(np.interp(at, ends, highs))


def assess(text: str | None, limits: Limits, squeeze) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "replace")
    counts = base_counts(text, data)
    failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    ratio = len(data) / len(squeeze(data)) if data else 0.0
    worst, share = chunk_ratios(data, limits, squeeze)
    low, high = band(len(data), limits)
    kept = not failed and low <= ratio <= high and share <= limits.chunk_share
    return (*counts, failed, kept, len(data), ratio, worst, share)


def measures(text: str | Column, limits: Limits = LIMITS) -> Column:
    """A struct of all measures and the verdict ``kept`` for a text column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        squeeze = zstandard.ZstdCompressor(level=limits.level).compress
        return pd.DataFrame([assess(x, limits, squeeze) for x in texts.tolist()], columns=NAMES)

    return F.pandas_udf(run, SCHEMA)(F.col(text) if isinstance(text, str) else text)


def chunk_spread(text: str | None, limits: Limits, squeeze) -> tuple[int, float, float | None]:
    """Bytes and ratio of a text, and the ratio of the chunk in its middle, if it is longer than a chunk."""
    data = (text or "").encode("utf-8", "replace")
    middle = (len(data) - limits.chunk) // 2
    part = data[middle : middle + limits.chunk]
    return len(data), len(data) / len(squeeze(data)) if data else 0.0, len(part) / len(squeeze(part)) if middle > 0 else None


def fit_limits(docs: DataFrame, labels: DataFrame, limits: Limits = LIMITS, text: str = "text", label: str = "quality") -> Limits:
    """``limits`` with the bands of the documents that ``labels`` (doc_id, 0/1) calls good.

    One pass over the documents, of which ids and ratios meet the labels; what reaches the driver is a row for each class of length. A class's limits stand at the mean
    length (by logarithm) of its documents, and go straight between classes. Beyond the last class they are carried on.
    """
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("least"), F.max(label).alias("most"))
    good = good.filter("least = 1 AND most = 1").select("doc_id")

    def run(texts: pd.Series) -> pd.DataFrame:
        squeeze = zstandard.ZstdCompressor(level=limits.level).compress
        return pd.DataFrame([chunk_spread(x, limits, squeeze) for x in texts.tolist()], columns=["bytes", "ratio", "chunk"])

    # ratios of all texts are worked out where the texts lie; only these few numbers are moved to meet the labels
    # empty texts go first: a condition on the ratios would run the function twice in a task, in two workers
    made = docs.filter(F.length(text) > 0).select("doc_id", F.pandas_udf(run, "bytes long, ratio double, chunk double")(F.col(text)).alias("m"))
    made = cut_lineage(made.select("doc_id", "m.*").join(good, "doc_id", "left_semi"))
    ends = lambda x: F.percentile_approx(x, F.array(F.lit(BEYOND), F.lit(1 - BEYOND)), 10_000)
    by_length = made.groupBy(F.floor(F.log2("bytes")).alias("class")).agg(F.count("*").alias("n"), F.avg(F.log2("bytes")).alias("at"), ends("ratio").alias("ends"))
    fitted = {r["class"]: r for r in by_length.collect() if r.n >= LEAST_LABELLED}
    if not fitted:
        return limits
    bands = [(int(2**r.at), max(0.0, r.ends[0] - MARGIN_LOW), r.ends[1] + MARGIN_HIGH) for _, r in sorted(fitted.items())]
    # shorter and longer texts than any labelled one: the wide limits, from the next power of two on
    first, last = min(fitted), max(fitted)
    short = [(n, *band(n, limits)) for n in (2 ** (first - 1), 1) if n < bands[0][0] and first > 0]
    long = [(n, *band(n, limits)) for n in (2 ** (last + 2), 1 << 24) if n > bands[-1][0]]
    chunks = made.filter("chunk IS NOT NULL").agg(F.count("*").alias("n"), ends("chunk").alias("ends")).first()
    low, high = limits.chunk_low, limits.chunk_high
    if chunks.n >= LEAST_LABELLED:
        low, high = max(0.0, chunks.ends[0] - MARGIN_LOW), chunks.ends[1] + MARGIN_HIGH
    return replace(limits, bands=(*sorted(short), *bands, *long), chunk_low=low, chunk_high=high)


def keep_ordinary(docs: DataFrame, text: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """The rows of ``docs`` whose text passes the base rule and the compression bands, all columns as they were."""
    return docs.filter(measures(text, limits)["kept"])
