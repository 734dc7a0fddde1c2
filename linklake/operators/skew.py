"""Joins and neighbour lookups that keep working when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int = SALTS,
    spread: list[str] | None = None,
) -> DataFrame:
    """Join where ``big`` may hold a hot key and ``small`` has few rows per key.

    Rows of ``big`` are spread over ``salts`` sub-keys by a hash of the columns in ``spread`` (all
    by default) and ``small`` is repeated once per salt, so a hot key is split over ``salts``
    tasks. The hash depends on the row alone, so a recomputed task gives the same rows again.
    Left, inner, semi and anti joins keep their meaning because each row of ``big`` meets exactly
    one copy of ``small``.
    """
    salt = F.pmod(F.xxhash64(*[F.col(x) for x in (spread or big.columns)]), F.lit(salts))
    left = big.withColumn("_salt", salt.cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")


def with_neighbours(
    df: DataFrame, group: str, at: str, order: list[str], value: str, unit: str = "hour"
) -> DataFrame:
    """Add ``prev_<value>`` and ``next_<value>`` within ``group`` ordered by ``order``.

    Same result as ``lag`` / ``lead`` over the group, but rows are windowed per (group, time
    slice), so a group with a third of all rows is spread over its slices. Only the first and last
    value of each slice meet in the group-wide window.
    """
    c = F.col
    sliced = df.withColumn("_slice", F.date_trunc(unit, c(at)))
    inner = Window.partitionBy(group, "_slice").orderBy(*order)
    wrap = F.struct(c(value).alias("v"))
    out = sliced.withColumns({"_prev": F.lag(wrap).over(inner), "_next": F.lead(wrap).over(inner)})
    key = F.struct(*[c(o) for o in order])
    edges = sliced.groupBy(group, "_slice").agg(
        F.min_by(wrap, key).alias("_first"), F.max_by(wrap, key).alias("_last")
    )
    across = Window.partitionBy(group).orderBy("_slice")
    edges = edges.select(
        group, "_slice", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after")
    )
    joined = _join_null_safe(out, edges, [group, "_slice"])
    return joined.withColumns(
        {
            "prev_" + value: F.coalesce("_prev", "_before")["v"],
            "next_" + value: F.coalesce("_next", "_after")["v"],
        }
    ).drop("_slice", "_prev", "_next", "_before", "_after")


def last_before(
    events: DataFrame, values: DataFrame, group: str, at: str, value: str, unit: str = "day"
) -> DataFrame:
    """As-of lookup: add to each event the latest struct ``value`` of its group strictly before ``at``.

    Events and values are merged and windowed per (group, time slice); what a slice ends with is
    carried into later slices by a window over slices only. No event meets more than one value, and
    a hot group is spread over its slices.
    """
    c = F.col
    marked = events.withColumn("_is_value", F.lit(False)).unionByName(
        values.select(group, at, value).withColumn("_is_value", F.lit(True)), allowMissingColumns=True
    )
    marked = marked.withColumn("_slice", F.date_trunc(unit, c(at)))
    so_far = Window.partitionBy(group, "_slice").orderBy(at, "_is_value").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_inside", F.last(value, ignorenulls=True).over(so_far))
    ends = marked.groupBy(group, "_slice").agg(F.max_by(value, F.when(c(value).isNotNull(), c(at))).alias("_end"))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(group, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    out = _join_null_safe(marked.filter(~c("_is_value")), ends, [group, "_slice"])
    return out.withColumn(value, F.coalesce("_inside", "_carried")).drop("_is_value", "_slice", "_inside", "_carried")


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key: undated rows and rows without a group stay."""
    names = {x: f"_other{x}" for x in on}
    right = right.withColumnsRenamed(names)
    meets = [left[x].eqNullSafe(right[y]) for x, y in names.items()]
    return left.join(right, meets).drop(*names.values())


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
