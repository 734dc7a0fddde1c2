"""Site analytics: events, visit summaries, miss rates, openings and search chains."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import shortened
from ..sources import schemas
from .skew import is_true, with_neighbours


def _param(name: str, args: str = "args") -> Column:
    """First value of a query-string field, form-decoded; empty when absent."""
    pair = F.try_element_at(F.filter(F.col(args), lambda p: F.substring_index(p, "=", 1) == name), F.lit(1))
    raw = F.substring(pair, len(name) + 2, 1 << 30)
    return F.coalesce(F.try_url_decode(raw), raw, F.lit(""))


def _number(name: str) -> Column:
    """Missing, zero or non-numeric counts are 0."""
    return F.coalesce(_param(name).try_cast("double"), F.lit(0.0)).cast("bigint")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``value`` log lines to ``at, c, a`` with ``bad`` for lines that are not JSON."""
    c = F.col
    parsed = lines.filter(F.trim("value") != "").withColumn(
        "r", F.from_json("value", schemas.SITE_EVENT_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    return parsed.select(
        c("r._bad").isNotNull().alias("bad"), F.try_to_timestamp("r.at").alias("at"), c("r.c").alias("c"), c("r.a").alias("a")
    )


def parse_events(records: DataFrame, since: datetime | None = None, keep_bots: bool = False) -> DataFrame:
    """One row per event with its decoded fields; unknown kinds are kept with ``malformed`` set.

    Old and undated records and, unless asked for, bots are dropped before the kind is looked at.
    """
    c = F.col
    bad = c("bad") if "bad" in records.columns else F.lit(False)
    keep = bad | c("at").isNotNull()
    if since is not None:
        keep = keep & (bad | (c("at") >= F.lit(since).cast("timestamp")))
    if not keep_bots:
        keep = keep & (bad | is_true(c("c") == "browser"))
    rows = records.filter(keep).withColumn("args", F.split(F.coalesce("a", F.lit("")), "&"))
    extra = [x for x in records.columns if x not in ("a", "c", "bad")]
    rows = rows.withColumn("kind", _param("e"))
    return rows.select(
        *extra, "kind", (bad | ~c("kind").isin(rules.EVENT_KINDS)).alias("malformed"),
        _number("n").alias("searches"), _number("m").alias("misses"), _number("o").alias("opens"),
        _number("f").alias("facets"), (_number("c") == 1).alias("copied"),
        _param("ref").alias("ref"), _param("w").alias("w"), _param("l").alias("lang"),
        _param("q").alias("q"), _param("k").alias("k"), _number("r").alias("r"),
    )


def summarise(events: DataFrame) -> DataFrame:
    """One row: visits and what they reported about themselves, plus reported gaps and openings."""
    c = F.col
    visit = ~c("malformed") & (c("kind") == "s")
    total = lambda x: F.coalesce(F.sum(F.when(visit, c(x))), F.lit(0)).cast("bigint").alias(x)
    return events.agg(
        F.count_if(visit).alias("visits"), total("searches"), total("misses"), total("facets"),
        F.count_if(visit & c("copied")).alias("copies"), F.count_if(visit & (c("searches") > 0)).alias("searching_visits"),
        F.coalesce(F.sum(F.when(visit, c("opens"))), F.lit(0)).cast("bigint").alias("open_count"),
        F.count_if(~c("malformed") & (c("kind") == "miss")).alias("gaps"),
        F.count_if(~c("malformed") & (c("kind") == "open")).alias("opens"),
        F.count_if("malformed").alias("malformed"),
    )


def report(events: DataFrame) -> DataFrame:
    """The summary with its rates; a rate over nothing is null."""
    c = F.col
    return summarise(events).withColumns(
        {
            "miss_rate": F.try_divide(c("misses"), F.nullif(c("searches"), F.lit(0))),
            "open_rate": F.try_divide(c("open_count"), F.nullif(c("searches"), F.lit(0))),
        }
    )


def tally(events: DataFrame, kind: str, key: str, limit: int | None = None) -> DataFrame:
    """``label, n`` of one kind by one field, empty labels dropped; most frequent first, then by label."""
    c = F.col
    rows = events.filter(~c("malformed") & (c("kind") == kind) & (c(key) != ""))
    out = rows.groupBy(c(key).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    return out if limit is None else out.limit(limit)


def most_opened(events: DataFrame, limit: int = 15) -> DataFrame:
    """``key, n, avg_rank`` over ranks above 0; null when no opening carried a rank."""
    c = F.col
    opens = events.filter(~c("malformed") & (c("kind") == "open") & (c("k") != ""))
    out = opens.groupBy(c("k").alias("key")).agg(
        F.count("*").alias("n"), F.avg(F.when(c("r") > 0, c("r"))).alias("avg_rank")
    )
    return out.orderBy(F.desc("n"), "key").limit(limit)


def search_chains(keystrokes: DataFrame, visit: str = "visit", at: str = "ts", order: str = "event_id") -> DataFrame:
    """``visit, searches, misses``: typing a query further, or back, is one search.

    A row starts a chain when it neither extends nor is a prefix of the query before it; it ends
    one when the row after it starts a chain, is empty or is missing. Misses count the last result
    of each chain. Only neighbours matter, so a very long visit is spread over time slices.
    """
    c = F.col
    rows = with_neighbours(keystrokes.select(visit, at, order, "q", "results"), visit, at, [at, order], "q")
    related = lambda a, b: a.isNotNull() & (a != "") & b.isNotNull() & (b != "") & (F.startswith(a, b) | F.startswith(b, a))
    typed = is_true(c("q") != "")
    starts = typed & ~is_true(related(c("prev_q"), c("q")))
    ends = typed & ~is_true(related(c("q"), c("next_q")))
    return rows.groupBy(visit).agg(
        F.count_if(starts).alias("searches"), F.count_if(ends & (c("results") == 0)).alias("misses")
    )


def client_class(user_agent: Column) -> Column:
    return F.when(user_agent == "", "none").when(user_agent.rlike(rules.BOT_AGENT), "bot").otherwise("browser")


def not_opted_out(visits: DataFrame) -> DataFrame:
    """Drop visits that refuse measurement; an unreadable signal counts as a refusal."""
    signals = ("dnt", "gpc", "opt_out")
    return visits.filter(~F.greatest(*[F.coalesce(F.col(s), F.lit(True)) for s in signals]))


def visit_records(pageviews: DataFrame, longest: int | None = None, language: int | None = None) -> DataFrame:
    """First summary of each visit as the fields that are sent: zero and blank ones are left out.

    Texts are cut to ``longest`` characters and the language to ``language``, if given.

    Input: ``visit, ts, searches, misses, opens, facets, copied, referrer, own_host, width, language``.
    """
    c = F.col
    host = F.regexp_replace(F.regexp_extract("referrer", r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1), r"^www\.", "")
    first = pageviews.groupBy("visit").agg(
        F.min_by(F.struct(*[x for x in pageviews.columns if x != "visit"]), "ts").alias("v")
    ).select("visit", "v.*")
    nonzero = lambda x: F.when(c(x) != 0, c(x))
    cut = lambda x: F.when(x != "", shortened(x, longest))
    return first.select(
        "visit", nonzero("searches").alias("n"), nonzero("misses").alias("m"), nonzero("opens").alias("o"),
        nonzero("facets").alias("f"), F.when(c("copied"), 1).alias("c"), cut(F.when(host != c("own_host"), host)).alias("ref"),
        F.when(c("width") < 560, "sm").when(c("width") < 1000, "md").otherwise("lg").alias("w"),
        cut(shortened(F.coalesce("language", F.lit("")), language)).alias("l"),
    )


def encode_event(kind: str, fields: dict[str, Column], longest: int | None = None) -> Column:
    """The query string one event is logged as."""
    parts = [F.lit("e=" + kind)]
    for name, value in fields.items():
        text = value.cast("string")
        parts.append(F.when((text != "") & (text != "0"), F.concat(F.lit(name + "="), F.url_encode(shortened(text, longest)))))
    return F.concat_ws("&", *parts)
