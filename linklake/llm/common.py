"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage, shared_folder

__all__ = ["bucket", "cut_lineage", "crc_mod", "map_rows", "runs", "shared_folder", "table"]


#: Texts run from nothing to megabytes, so batches for Python are bounded by their bytes; a batch is held
#: several times over, by the JVM, Arrow and Python.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, in a session whose Arrow batches are bounded by ``BATCHES``."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def bucket(n: int, *cols: str) -> Column:
    """A number from 0 to n-1 that depends on the row alone, so that a recomputed task deals alike."""
    return F.pmod(F.xxhash64(*[F.col(x) for x in cols]), F.lit(n)).cast("int")


def map_rows(df: DataFrame, fn: Callable[..., tuple[list[int], dict[str, list]]], inputs: list[str], keep: list[str],
             fields: list[T.StructField]) -> DataFrame:
    """Run ``fn`` over Arrow batches; one row may give none, one or many.

    ``fn`` takes the input columns as lists and returns, for each row it gives, the place in the
    batch that the row comes from, and the new columns. ``keep`` columns are copied from there.
    Only ``keep`` and ``inputs`` are read; other columns of ``df`` never reach Python.
    """
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    arrow = to_arrow_schema(schema)
    names = list(dict.fromkeys(keep + inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, made = fn(*[batch.column(names.index(x)).to_pylist() for x in inputs])
            at = pa.array(places, pa.int64())
            kept = [batch.column(names.index(k)).take(at).cast(arrow.field(k).type) for k in keep]
            new = [pa.array(made[f.name], arrow.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays(kept + new, schema=arrow)

    return df.select(*names).mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], list]) -> Iterator[pa.RecordBatch]:
    """Cut a stream of batches that is sorted by ``key`` into whole runs of equal keys.

    Yields one batch per run; only one run and one batch are held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = key(batch)
        start = 0
        for i, k in enumerate(keys):
            if i == 0 and held and k == last:
                continue
            if i == 0 and held:
                yield _joined(held)
                held = []
            elif i and k != keys[i - 1]:
                held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, start = [], i
        held.append(batch.slice(start))
        last = keys[-1]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
