"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, components.

Method: equal vectors are one vector with a weight. Each gets the signs of its products with random
hyperplanes, some bits for each of several tables. Vectors that share a table's bits form a bucket; all
pairs of a bucket are verified by their cosine in double precision. The bits of a table grow with the
number of distinct vectors, so that buckets stay small, and the number of tables follows from the
chance that a pair at the threshold is found in at least one. A pair found in several tables counts in the first.
A bucket over a fixed size is cut into blocks, and every pair of its blocks is compared, so no bucket is
too large and none is skipped. Tasks give a count for every linked vector and a spanning forest, not pairs.

Defined results: a vector that is null or empty, has length zero, or holds a null or a non-finite number links with
nothing. Vectors of different dimension don't link. Repeated rows are copies of each other. Rows with a null
id count for others; their own component is the smallest id there, null if there is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, runs
from .components import components

THRESHOLD = 0.9
RECALL = 0.98  # least chance that a pair exactly at the threshold shares a bucket
BUCKET = 48  # distinct vectors in a bucket, were they spread evenly
BLOCK = 1024  # most vectors of a bucket that are compared in one step
SEED = 11


def tables_and_bits(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    bits = min(60, max(4, math.ceil(math.log2(max(2, n / BUCKET)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))), bits


def packed_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec): the doubles of every usable vector as bytes, null for the others."""
    fields = T.StructType([T.StructField("vec_id", rows.schema[vec_id].dataType), T.StructField("vec", T.BinaryType())])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = None if not x.is_valid or x.values.null_count or not len(x.values) else np.asarray(x.values.to_numpy(zero_copy_only=False), "<f8")
                if v is not None:
                    with np.errstate(over="ignore", invalid="ignore"):
                        length = np.linalg.norm(v / max(np.abs(v).max(), 5e-324)) if v.any() else 0.0
                    if not np.isfinite(length) or not length > 0:
                        v = None
                out.append(None if v is None else (v + 0.0).tobytes())  # + 0.0: minus zero is zero
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(out, pa.binary())], schema=arrow)

    return rows.select(vec_id, embedding).mapInArrow(run, fields)


def _matrix(vecs: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


SIGNED = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("codes", T.ArrayType(T.LongType())),
])


def signed(vectors: DataFrame, tables: int, bits: int, seed: int = SEED) -> DataFrame:
    """Add the bucket of every table to (node, weight, vec)."""
    arrow = to_arrow_schema(SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vecs, codes = batch.column(2).to_pylist(), [None] * batch.num_rows
            for size in {len(v) for v in vecs}:
                own = [i for i, v in enumerate(vecs) if len(v) == size]
                if size not in planes:
                    planes[size] = np.random.default_rng(seed + size).standard_normal((size // 8, tables * bits))
                signs = (_matrix([vecs[i] for i in own]) @ planes[size] > 0).reshape(len(own), tables, bits)
                made = signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                for i, c in zip(own, made.tolist(), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, arrow.field("codes").type)], schema=arrow)

    return vectors.select("node", "weight", "vec").mapInArrow(run, SIGNED)


LINKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])


def _compare(batch: pa.RecordBatch, table: int, threshold: float) -> tuple[list, list, list]:
    """Linked weight and local root of the vectors of one bucket, or of two blocks of it."""
    nodes, weights = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
    side = batch.column("side").to_numpy()
    unit = _matrix(batch.column("vec").to_pylist())
    codes = np.array(batch.column("codes").to_pylist(), np.int64)[:, :table]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    across = len(two) > 0 or batch.column("low")[0].as_py() != batch.column("high")[0].as_py()
    a, b = (one, two) if across else (one, one)
    cosines = unit[a] @ unit[b].T
    i, j = np.nonzero(cosines >= threshold - 1e-9)
    near = np.abs(cosines[i, j] - threshold) <= 1e-9
    i, j = a[i], b[j]
    good = np.ones(len(i), bool)
    for k in np.flatnonzero(near):  # so close to the threshold that the order of the sums could decide
        good[k] = math.fsum((unit[i[k]] * unit[j[k]]).tolist()) >= threshold
    if not across:
        good &= i < j
    i, j = i[good], j[good]
    if table:  # a pair that an earlier table brings together counts there
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            first[s] = ~(codes[i[s]] == codes[j[s]]).any(axis=1)
        i, j = i[first], j[first]
    if not len(i):
        return [], [], []
    count = np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes))
    root = np.arange(len(nodes))
    while True:  # hook every pair to the smaller root, then shorten; each round at least halves what is apart
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(count)
    return nodes[at].tolist(), count[at].astype(np.int64).tolist(), nodes[root[at]].tolist()


def bucket_links(vectors: DataFrame, tables: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, links, root) from every bucket that finds new links of the node. ``vectors``: as ``signed`` gives, written down."""
    place = F.posexplode("codes").alias("table", "code")
    dims = F.octet_length("vec").alias("dims")
    sizes = vectors.select(place, dims).groupBy("table", "code", "dims").count().filter(F.col("count") > block)
    sizes = cut_lineage(sizes.select("table", "code", "dims", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    rows = vectors.select("node", "weight", "vec", "codes", place, dims).join(sizes, ["table", "code", "dims"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "table", "code", "dims", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "weight", "vec", "codes",
    )
    key = ["table", "code", "dims", "low", "high"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    arrow = to_arrow_schema(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys(batch: pa.RecordBatch) -> list:
            return list(zip(*[batch.column(k).to_pylist() for k in key], strict=True))

        held: tuple[list, list, list] = ([], [], [])
        for group in runs(batches, keys):
            if group.num_rows > 1:
                for whole, new in zip(held, _compare(group, group.column("table")[0].as_py(), threshold), strict=True):
                    whole.extend(new)
            if len(held[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], schema=arrow)
                held = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], schema=arrow)

    return dealt.mapInArrow(run, LINKS)


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    packed = cut_lineage(packed_vectors(rows, vec_id, embedding))
    usable = packed.filter("vec IS NOT NULL")
    classes = usable.groupBy("vec").agg(F.min("vec_id").cast("long").alias("first_id"), F.count("*").alias("weight"))
    # the smallest id names a class; a class of null ids takes a number below all others from its bytes
    name = F.coalesce("first_id", F.lit(-(1 << 62)) - F.pmod(F.xxhash64("vec"), F.lit(1 << 61)))
    classes = cut_lineage(classes.withColumn("node", name))
    tables, bits = tables_and_bits(classes.count(), threshold, recall)
    made = cut_lineage(bucket_links(cut_lineage(signed(classes, tables, bits)), tables, threshold, block))
    links = made.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(made.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    found = classes.join(links, "node", "left").join(roots, "node", "left")
    found = found.select("node", "vec", "first_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    found = cut_lineage(found)
    least = cut_lineage(found.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut_lineage(found.join(least, "root").select("vec", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "component_id", F.lit(True).alias("usable")))
    met = packed.join(named, "vec", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
