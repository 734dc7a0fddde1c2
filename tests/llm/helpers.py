"""Awkward small tables that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", fingerprint string, component_id string, length int, _id int, kept string, score string"


def prose(n: int, seed: int = 1) -> str:
    rng = random.Random(seed)
    parts = [a + b for a in ("b", "ch", "d", "gr", "k", "l", "m", "n", "p", "s", "t", "w") for b in ("a", "e", "i", "o", "u", "ar", "en", "is")]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = prose(300, 3)
    texts = [
        (1, base), (1, base), (2, base + " once more"), (3, None), (4, ""), (5, " \n\t "), (6, "short"), (7, "one two three four"),
        (None, base), (None, None), (8, prose(30_000, 5)), (9, "ab " * 4000), (10, "Ünïcode — ΣΑΣ 中文 👍🏽 <|endoftext|> it's 12"),
        (11, base.upper()), (12, prose(200, 9)), (13, "x" * 50_000), (14, "line one here\n" * 50), (15, "a\x85b\xa0c\x1cd \x00"),
    ]
    return [(i, t, None if k % 3 else "en", None, None) for k, (i, t) in enumerate(texts)]


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(*r, "f", "c", 1, 2, "k", "s") for r in awkward_rows()]
    return spark.createDataFrame(rows, DOCS + CLASHING).repartition(3)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS + CLASHING)
