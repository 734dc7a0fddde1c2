"""Live site analytics: hourly miss rates, late lines, search chains per visit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import parse_events
from ..sources.library_io import exists
from .word_table import write_batch

LATENESS = "1 hour"
VISIT_GAP_MS = 30 * 60 * 1000


def hourly_rates(records: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``window_start, visits, searches, misses, gaps, miss_rate`` per hour (append mode).

    An hour is final once the watermark passes its end; its state is then dropped.
    """
    c = F.col
    events = parse_events(records).filter("NOT malformed").withWatermark("at", lateness)
    visit = c("kind") == "s"
    total = lambda x: F.coalesce(F.sum(F.when(visit, c(x))), F.lit(0)).cast("bigint").alias(x)
    hours = events.groupBy(F.window("at", "1 hour")).agg(
        F.count_if(visit).alias("visits"), total("searches"), total("misses"), F.count_if(c("kind") == "miss").alias("gaps")
    )
    return hours.select(
        c("window.start").alias("window_start"), "visits", "searches", "misses", "gaps",
        F.try_divide(c("misses"), F.nullif(c("searches"), F.lit(0))).alias("miss_rate"),
    )


def keep_late(records: DataFrame, out: str, checkpoint: str, lateness: str = LATENESS) -> DataStreamWriter:
    """Side table of lines that arrive more than ``lateness`` behind the newest line of earlier batches."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = out + "_marks"
        if exists(spark, marks):
            mark = spark.read.parquet(marks).filter(F.col("batch") < batch_id).agg(F.max("newest").alias("newest"))
            late = batch.join(F.broadcast(mark), F.lit(True)).filter(
                F.col("at") < F.col("newest") - F.expr(f"INTERVAL {lateness}")
            )
            write_batch(late.drop("newest"), out, batch_id)
        write_batch(batch.agg(F.max("at").alias("newest")), marks, batch_id)

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _visit_chain(key, batches: Iterator, state: GroupState):
    """Counts of one visit, carried across micro-batches and written out when the visit falls silent.

    As in the batch job, only neighbours matter: a keystroke begins a search unless its text and the one
    before extend each other, and the last keystroke of a search says whether it missed. The carried row
    stands before the batch's rows; its own miss is taken back first, as it may not be the last one.
    """
    import numpy as np
    import pandas as pd

    if state.hasTimedOut:
        _, _, searches, misses = state.get
        state.remove()
        yield pd.DataFrame({"visit": [key[0]], "searches": [searches], "misses": [misses]})
        return
    text, found, searches, misses = state.get if state.exists else (None, None, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    q = np.array([text or "", *rows["q"].fillna("")], object)
    none_found = np.array([found == 0, *(rows["results"] == 0)], bool)
    typed = q != ""
    extends = np.array([bool(a and b) and (a.startswith(b) or b.startswith(a)) for a, b in zip(q, q[1:])], bool)
    ends = typed & ~np.append(extends, False)
    searches += int((typed[1:] & ~extends).sum())
    misses += int((ends & none_found).sum()) - int(typed[0] and none_found[0])
    last = rows["results"].iloc[-1]
    left = (q[-1], None if pd.isna(last) else int(last)) if typed[-1] else (None, None)
    state.update((*left, searches, misses))
    newest = int(rows["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + VISIT_GAP_MS)


def visit_chains(keystrokes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One ``visit, searches, misses`` record per visit, 30 silent minutes after its last keystroke.

    State is four values per open visit.
    """
    return (
        keystrokes.withWatermark("ts", lateness)
        .groupBy("visit")
        .applyInPandasWithState(
            _visit_chain, "visit string, searches bigint, misses bigint",
            "q string, n bigint, searches bigint, misses bigint", "append", GroupStateTimeout.EventTimeTimeout,
        )
    )
