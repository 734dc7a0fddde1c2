"""A corpus pipeline: quality rules, toxicity, SimHash near-duplicates, best-fit packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and gives the next
stage's docs. All but the last keep the columns of documents, extra ones included. Null and empty texts fail
the quality rules. Rows with a null id stay unless a rule or a near-duplicate with an id removes them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linklake.llm import compression, gru_toxicity, packing, simhash
from linklake.llm.common import crc_mod, cut_lineage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands, which are fitted to the labelled documents of ``sf_dir``."""
    limits = compression.fit_limits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return compression.keep_ordinary(docs, limits=limits)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window isn't toxic, by a network trained on the labelled documents of ``sf_dir``."""
    held_out = crc_mod("doc_id", 5) == 0
    model = gru_toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return gru_toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose SimHash fingerprints link: shingles of four words, four bits."""
    return simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place there."""
    made = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules), ("toxicity", toxicity), ("SimHash near-duplicates", near_duplicates), ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
