"""The words of the link book as a table that grows with it.

Recall asks which few links hold a rare word, and from when. The table keeps that answer up to date: a landing works out
the words of its own texts, and of the links whose first remark it moves to an earlier time, and appends them as
delta rows. Reading merges the deltas; compaction folds them into one base that holds the first few links of each word.
That is enough for good: a link's time only ever moves forward to the front, and then it comes in a delta of its own.

Files: ``words`` and ``born`` hold all facts by landing, in buckets by link, so that a landing reads the buckets of its
links alone; ``firsts`` holds the deltas and bases. A landing that is run again replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.memory import LinkBook
from ..operators.recall import RARE_LINKS, link_words, rare_link_terms, since_born
from ..session import cut_lineage
from ..sources.library_io import exists

TIMES = ["own_at", "body_at", "title_at"]
WORDS = "key string, term string, own_at timestamp, body_at timestamp, title_at timestamp"
BUCKETS = 64


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent append: a batch that is run again replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _earliest(words: DataFrame) -> DataFrame:
    return words.groupBy("key", "term").agg(*[F.min(x).alias(x) for x in TIMES])


class WordTable:
    def __init__(self, spark: SparkSession, path: str, rare: int = RARE_LINKS):
        self.spark, self.path, self.rare = spark, path, rare

    def _batches(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema + ", batch int")
        rows = self.spark.read.schema(schema + ", batch int").option("basePath", path).parquet(path)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def land(self, new: LinkBook, batch_id: int) -> None:
        """Add the remarks, notes and details of a landing; landings may come in any order of their times."""
        c = F.col
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        words = cut_lineage(link_words(new.said, new.notes, new.links).withColumn("bucket", bucket))
        born = cut_lineage(new.said.groupBy("key").agg(F.min("at").alias("born")).withColumn("bucket", bucket))
        keys = cut_lineage(words.select("key", "bucket").union(born.select("key", "bucket")).distinct())
        buckets = [r.bucket for r in keys.select("bucket").distinct().collect()]  # BUCKETS at most
        mine = lambda rows: rows.filter(c("bucket").isin(buckets)).join(keys.select("key"), "key", "left_semi")
        born_before = mine(self._batches("born", "key string, born timestamp, bucket int", batch_id)).groupBy("key").agg(F.min("born").alias("before"))
        born_now = keys.select("key").join(born.select("key", "born"), "key", "left").join(born_before, "key", "left")
        # links whose time moves, and links that had no remark until now, bring all their words along
        born_now = cut_lineage(born_now.select("key", F.least("born", "before").alias("born"), (c("before").isNull() | (c("born") < c("before"))).alias("moved")))
        known = _earliest(mine(self._batches("words", WORDS + ", bucket int", batch_id)).select("key", "term", *TIMES).union(words.select("key", "term", *TIMES)))
        moved = born_now.filter("moved").select("key")
        delta = known.join(moved, "key", "left_semi").unionByName(
            known.join(words.select("key", "term"), ["key", "term"], "left_semi").join(moved, "key", "left_anti")
        )
        delta = since_born(delta, born_now.filter("born IS NOT NULL").select("key", "born"))
        write_batch(delta.select("key", "term", *TIMES), f"{self.path}/firsts", batch_id)
        by_bucket = lambda rows, name: rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch_id}")
        by_bucket(words, "words")
        by_bucket(born, "born")

    def _base(self) -> tuple[DataFrame | None, int]:
        """The newest base that was written whole, and the last landing in it."""
        path = f"{self.path}/bases"
        if not exists(self.spark, path):
            return None, -1
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = [x.getPath().getName() for x in place.getFileSystem(hadoop).listStatus(place)]
        whole = [int(n.split("=")[1]) for n in found if n.startswith("upto=") and exists(self.spark, f"{path}/{n}/_SUCCESS")]
        if not whole:
            return None, -1
        return self.spark.read.schema(WORDS).parquet(f"{path}/upto={max(whole)}"), max(whole)

    def _merged(self) -> tuple[DataFrame, int]:
        base, upto = self._base()
        deltas = self._batches("firsts", WORDS).filter(F.col("batch") > upto)
        newest = deltas.agg(F.max("batch")).first()[0]
        rows = deltas.select("key", "term", *TIMES)
        return _earliest(rows if base is None else rows.union(base)), upto if newest is None else newest

    def rare_terms(self) -> DataFrame:
        """As ``rare_link_terms`` of the whole book."""
        return rare_link_terms(self._merged()[0], self.rare)

    def compact(self) -> None:
        """Fold all deltas into a new base: per word the links up to the one that makes it common."""
        rows, upto = self._merged()
        order = Window.partitionBy("term").orderBy(F.least("own_at", "body_at"), "key")
        kept = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= self.rare + 1)
        kept.select("key", "term", *TIMES).write.mode("overwrite").parquet(f"{self.path}/bases/upto={upto}")
