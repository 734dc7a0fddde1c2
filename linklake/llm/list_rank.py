"""Distributed list ranking with weights.

A list is a table (arc, next, near, n, a, b): ``next`` is the following arc, ``END`` after the last; ``near`` is any number that
tends to be close for arcs that are close in the list; n, a and b are weights. The result gives for every arc the sums of the
weights of all arcs before it.

The list is shortened round by round until one arc is left, and then unfolded in reverse. A round deals the arcs to
tasks of at most about ``PART`` of them, by ``near`` (the first round by a given column, if any); a task folds each chain of
arcs it holds into the chain's first arc. Where dealing leaves most chains broken, a round of coin tosses follows: an arc
folds into the one before it if they tossed differently, about a quarter of them. Each round is written down, so a
lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage

END = -1
PART = 50_000
WEIGHTS = ["n", "a", "b"]
LIST = ["arc", "next", "near", *WEIGHTS]
FOLDED = T.StructType([T.StructField(x, T.LongType()) for x in [*LIST, "into", *(f"off_{w}" for w in WEIGHTS)]])


def fold_chains(arc: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each arc of a task: the place of its chain's first arc, the weights between them, and each first arc's new next and weights.

    By pointer doubling inside the task. ``weights`` has a row for each arc.
    """
    order = np.argsort(arc)
    at = np.searchsorted(arc, after, sorter=order)
    found = order[np.minimum(at, len(arc) - 1)]
    inside = arc[found] == after
    first = np.arange(len(arc))
    first[found[inside]] = np.flatnonzero(inside)
    off = np.where((first != np.arange(len(arc)))[:, None], weights[first], 0)
    while True:
        onward = first[first]
        if (onward == first).all():
            break
        off = off + off[first]
        first = onward
    last = np.flatnonzero(~inside)
    new_after, total = after.copy(), weights.copy()
    new_after[first[last]] = after[last]
    total[first[last]] = off[last] + weights[last]
    return first, off, new_after, total


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(FOLDED)
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    arc, after, near = (table.column(x).to_numpy() for x in LIST[:3])
    weights = np.stack([table.column(w).to_numpy() for w in WEIGHTS], axis=1)
    first, off, new_after, total = fold_chains(arc, after, weights)
    kept = first == np.arange(len(arc))
    columns = [pa.array(x) for x in (arc, new_after, near, *total.T)]
    columns += [pa.array(arc[first], mask=kept), *(pa.array(x, mask=kept) for x in off.T)]
    yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)


def _toss(arcs: DataFrame, turn: int) -> DataFrame:
    """A round of coin tosses, in the same shape as ``_in_task``'s."""
    side = F.xxhash64("arc", F.lit(turn)).bitwiseAND(1)
    before = arcs.select(F.col("next").alias("arc"), F.col("arc").alias("into"), *[F.col(w).alias(f"off_{w}") for w in WEIGHTS], side.alias("before"))
    met = arcs.join(before, "arc", "left").withColumn("folds", F.coalesce((side == 1) & (F.col("before") == 0), F.lit(False)))
    met = cut_lineage(met.select(*LIST, "folds", *[F.when(F.col("folds"), F.col(x)).alias(x) for x in FOLDED.names[len(LIST) :]]))
    taken = met.filter("folds").select(F.col("arc").alias("next"), F.col("next").alias("_next"), *[F.col(w).alias(f"_{w}") for w in WEIGHTS])
    longer = met.join(taken, "next", "left")
    sums = [(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in WEIGHTS]
    return longer.select("arc", F.coalesce("_next", "next").alias("next"), "near", *sums, *FOLDED.names[len(LIST) :])


def ranked(arcs: DataFrame, together: str | None = None, part: int = PART) -> DataFrame:
    """(arc, before_n, before_a, before_b) for every arc of one list; ``together`` names a column to deal by at first."""
    now, size, folded, turn = arcs, arcs.count(), [], 0
    while size > 1:
        parts = -(-size // part)
        dealt = now.repartition(parts, together) if not turn and together else now.repartitionByRange(parts, "near", "arc") if parts > 1 else now.coalesce(1)
        made = cut_lineage(dealt.select(*LIST).mapInArrow(_in_task, FOLDED))
        folded.append(made.filter("into is not null"))
        now = made.filter("into is null").select(*LIST)
        before, size = size, now.count()
        turn += 1
        if size > part and size > 0.8 * before:
            made = cut_lineage(_toss(now, turn))
            folded.append(made.filter("into is not null"))
            now = made.filter("into is null").select(*LIST)
            size = now.count()
    known = now.select("arc", *[F.lit(0).cast("long").alias(f"before_{w}") for w in WEIGHTS])
    for level in reversed(folded):
        into = known.withColumnRenamed("arc", "into")
        more = level.join(into, "into").select("arc", *[(F.col(f"before_{w}") + F.col(f"off_{w}")).alias(f"before_{w}") for w in WEIGHTS])
        known = cut_lineage(known.union(more))
    return known
