"""Live operators on keyed state: links shown per session, and resources that fall stale.

Spark keeps one state per session or resource and touches only those of a batch or of a timer that fires. So the
work of a batch follows the batch and not what came before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHOWN = "msg_id bigint, session string, key string, rank int, at timestamp"
DUE = "key string, checked_at timestamp, due_at timestamp"
WEEK = timedelta(days=7)


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def shown_once(candidates: DataFrame, most: int = 3, silence: timedelta = timedelta(days=30)) -> DataFrame:
    """The ``most`` best of each message's streamed ``candidates`` (same columns) that its session hasn't been shown yet.

    State: the links shown to a session and by which message; a timer ends it when event time is ``silence`` past the session's
    last message, and messages further behind than that are left out by Spark's watermark. A message's candidates arrive in one batch. Messages without a session are sessions of their own, and a message that comes again,
    from a batch that was run twice, shows nothing more.
    """
    silence_ms = int(silence.total_seconds() * 1000)

    def pick(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        keys, by = map(list, state.get) if state.exists else ([], [])
        shown, answered, out = set(keys), set(by), []
        rows = pd.concat(list(batches)).sort_values(["at", "msg_id", "rank"])
        for (at, msg), group in rows.groupby(["at", "msg_id"], sort=True, dropna=False):
            if msg in answered:
                continue
            session = group["session"].iloc[0]
            for i, key in enumerate([k for k in group["key"] if k not in shown][:most]):
                out.append((msg, session, key, i + 1, at))
                shown.add(key)
                keys.append(key)
                by.append(int(msg))
        state.update((keys, by))
        last = rows["at"].max()
        state.setTimeoutTimestamp(max(0 if pd.isna(last) else _ms(last), state.getCurrentWatermarkMs()) + silence_ms)
        yield _table(out, SHOWN)

    own = F.coalesce(F.concat(F.lit("s:"), "session"), F.concat(F.lit("m:"), F.col("msg_id").cast("string")))
    timely = candidates.withWatermark("at", f"{silence_ms} milliseconds")
    return timely.withColumn("_own", own).groupBy("_own").applyInPandasWithState(
        pick, SHOWN, "keys array<string>, messages array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stale_resources(verdicts: DataFrame, lateness: str = "1 day", age: timedelta = WEEK) -> DataFrame:
    """``key, checked_at, due_at`` of each resource when event time passes ``age`` after its last fetch.

    ``verdicts`` (key, checked_at) is a stream of fetches. State: a resource's last fetch, and whether its lapse is reported. A
    fetch sets the timer anew; one that comes after the week was over reports the lapse itself, so results don't depend on how
    rows fall into batches. Fetches that are later than ``lateness`` behind the newest are left out by Spark's watermark.
    """
    age_ms = int(age.total_seconds() * 1000)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at_ms, reported = state.get if state.exists else (None, False)
        lapsed = []
        if state.hasTimedOut:
            lapsed, reported = [at_ms], True
        else:
            for fetched in sorted(_ms(x) for b in batches for x in b["checked_at"]):
                if at_ms is not None and fetched <= at_ms:
                    continue
                if at_ms is not None and not reported and fetched > at_ms + age_ms:
                    lapsed.append(at_ms)
                at_ms, reported = fetched, False
            if not reported and at_ms + age_ms <= state.getCurrentWatermarkMs():
                lapsed.append(at_ms)
                reported = True
        state.update((at_ms, reported))
        if not reported:
            state.setTimeoutTimestamp(at_ms + age_ms)
        times = pd.to_datetime(pd.Series(lapsed, dtype="int64"), unit="ms")
        yield pd.DataFrame({"key": key[0], "checked_at": times, "due_at": times + age})

    timely = verdicts.filter("key IS NOT NULL AND checked_at IS NOT NULL").withWatermark("checked_at", lateness)
    return timely.groupBy("key").applyInPandasWithState(watch, DUE, "at_ms bigint, reported boolean", "append", GroupStateTimeout.EventTimeTimeout)
