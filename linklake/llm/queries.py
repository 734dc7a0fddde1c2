"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, compression, cosine_lsh, gru_toxicity, mil_quality, packing, prefix_trie, simhash, spelling, token_count, trie_bpe, url_markov, warc,
)
from .check_sql import SQL
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(SQL)
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, ["doc_id"])
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    limits = compression.fit_limits(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", compression.measures("text", limits).alias("m")).select("doc_id", "m.*")


@query
def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE, ["doc_id"])


@query
def op4_cosine_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def _scored(docs: DataFrame, held_out, score) -> DataFrame:
    rows = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query
def op5_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) == 1
    weights = mil_quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(docs, held_out, mil_quality.scores("text", weights))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count.token_counts("text", PIECES).alias("n_tokens"))


@query
def op7_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    model = gru_toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(docs, held_out, gru_toxicity.scores("text", model))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judged(table(spark, sf_dir, "pages"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digested(table(spark, sf_dir, "conversations"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ["doc_id"])


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counts(table(spark, sf_dir, "documents")))
