"""Messages and links as they arrive.

Two ways in. ``landed_lines`` takes logs that are rotated: a file that appears is complete, and Spark's file source
remembers which files it has read. ``sources.growing_log`` follows logs that are still being written, line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.memory import LinkBook, capture, pick_links
from ..operators.recall import rank_rare, recall_candidates
from ..sources.agent_logs import messages_1
from ..sources.library_io import exists
from .keyed import shown_once
from .word_table import WordTable, write_batch


def landed_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of ``file, block, value``: every line of every complete log file that lands."""
    lines = (
        spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", max_files).load(path)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    ).filter(~F.col("file").contains("/subagents/"))


def batch_messages(batch: DataFrame) -> DataFrame:
    """Messages of one micro-batch of landed lines; a batch holds whole files."""
    pos = F.struct("block", F.monotonically_increasing_id().alias("n"))
    return messages_1(batch.select("file", pos.alias("pos"), "value"))


def capture_queued(lines: DataFrame, out: str, checkpoint: str, ignore: DataFrame | None = None) -> DataStreamWriter:
    """Record links of messages typed mid-turn; the other messages are captured by the prompt path.

    Each batch appends its picks. ``read_book`` folds them, so a batch never rewrites the book.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(pick_links(batch_messages(batch).filter("queued"), ignore), out, batch_id)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def read_book(spark: SparkSession, picks_path: str) -> LinkBook:
    if not exists(spark, picks_path):
        return LinkBook.empty(spark)
    return capture(None, spark.read.parquet(picks_path).drop("batch"))


def distinct_messages(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a text within a session; state is kept only as long as the watermark needs."""
    return messages.withWatermark("at", delay).dropDuplicatesWithinWatermark(["session", "text"])


CANDIDATES = "msg_id bigint, session string, key string, rank int, at timestamp"


def prompt_candidates(
    prompts: DataFrame, book: LinkBook, words: WordTable, vocab: DataFrame, total: DataFrame, out: str, checkpoint: str
) -> DataStreamWriter:
    """Every link that a prompt's rare words name, by rank. The book's words come from the table kept for it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ranked = rank_rare(recall_candidates(batch, book, vocab, total, terms=words.rare_terms()), None)
        write_batch(ranked.select("msg_id", "session", "key", F.col("rank").cast("int").alias("rank"), "at"), out, batch_id)

    return prompts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def recalled(spark: SparkSession, candidates: str) -> DataFrame:
    """Stream of ``msg_id, session, key, rank, at``: the best three links of each prompt, every link once per session.

    ``candidates`` is the folder that ``prompt_candidates`` fills; the links shown are keyed state.
    """
    landed = spark.readStream.schema(CANDIDATES).option("recursiveFileLookup", "true").parquet(candidates)
    return shown_once(landed)
