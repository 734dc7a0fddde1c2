"""Reading and writing the library: JSON lines for review, Parquet tables for work."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import Library, from_documents, to_documents
from . import schemas


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists: the local index, else the shipped one."""
    return next((p for p in paths if exists(spark, p)), None)


def read_documents(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Good records and unreadable lines of the first existing JSON-lines path; none gives empty."""
    path = first_existing(spark, *paths)
    if path is None:
        return spark.createDataFrame([], schemas.DOCUMENT), spark.createDataFrame([], "line string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select("value", F.from_json("value", schemas.DOCUMENT + ", _bad string", options).alias("r"))
    bad = F.col("r._bad").isNotNull()
    return rows.filter(~bad).select("r.*").drop("_bad"), rows.filter(bad).select(F.col("value").alias("line"))


def read_library(spark: SparkSession, *paths: str) -> Library:
    return from_documents(read_documents(spark, *paths)[0])


def replace_path(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in the place of an old one: two renames, never a half-written index."""
    fs, target = _fs(spark, path)
    _, fresh = _fs(spark, staged)
    _, old = _fs(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot set aside {path}")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        fs.delete(old, True)


def write_documents(documents: DataFrame, path: str) -> int:
    """JSON lines in key order over range-partitioned files; returns the number of records."""
    spark = documents.sparkSession
    staged = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    documents.orderBy("key").write.mode("overwrite").json(staged)
    n = spark.read.text(staged).count()
    replace_path(spark, staged, path)
    return n


def write_tables(library: Library, path: str) -> None:
    """Facts and state as Parquet, facts split by kind so a job reads only the kinds it needs."""
    spark = library.facts.sparkSession
    for name, df, parts in (("facts", library.facts, ["kind"]), ("state", library.state, [])):
        staged = f"{path}/{name}.tmp-{uuid.uuid4().hex[:8]}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(staged)
        replace_path(spark, staged, f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> Library:
    return Library(
        spark.read.schema(schemas.FACTS).parquet(f"{path}/facts"), spark.read.schema(schemas.STATE).parquet(f"{path}/state")
    )


def export(library: Library, lines: DataFrame, path: str, generated_at: datetime) -> dict:
    """Three views of the published rows: JSON lines, one packaged document, and Markdown lines.

    The packaged document is written as sorted lines over as many files as its size asks for: a header, one
    record a line, a footer. Read in order they are one JSON document; no task holds more than its lines.
    """
    documents, large = to_documents(library)
    spark = documents.sparkSession
    documents = documents.drop("local_sections")
    n = write_documents(documents, f"{path}/resources.jsonl")
    large.write.mode("overwrite").json(f"{path}/large_resources.jsonl")
    rows = spark.read.schema(schemas.DOCUMENT).json(f"{path}/resources.jsonl")
    place = lambda part, m, k: F.struct(F.lit(part).alias("part"), m.alias("m"), k.alias("k")).alias("place")
    body = rows.select(place(1, -F.col("mentions"), F.col("key")), F.to_json(F.struct(*rows.columns)).alias("value"))
    first = body.agg(F.min("place").alias("first"))
    body = body.join(F.broadcast(first), F.lit(True)).select(
        "place", F.when(F.col("place") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value")
    )
    zero, blank = F.lit(0).cast("bigint"), F.lit("")
    opening = F.to_json(F.struct(F.lit(generated_at).cast("timestamp").alias("generated_at"), F.lit(n).alias("count")))
    frame = spark.range(1).select(F.explode(F.array(
        F.struct(place(0, zero, blank), F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(',"entries":[')).alias("value")),
        F.struct(place(2, zero, blank), F.lit("]}").alias("value")),
    )).alias("x")).select("x.*")
    body.unionByName(frame).orderBy("place").select("value").write.mode("overwrite").text(f"{path}/resources.json")
    lines.write.mode("overwrite").text(f"{path}/list.md")
    return {"published": n}
