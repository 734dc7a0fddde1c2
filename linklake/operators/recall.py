"""Bringing earlier links back for a new message, live or replayed over history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import memory_words, utf16_length
from ..session import cut_lineage
from .memory import SHORT_REMARK, LinkBook, find_links, keywords, pick_links, weighted_terms
from .skew import is_true, last_before, salted_join, with_neighbours

RARE_LINKS = 5
MIN_SCORE = 10.0
RECENT_DAYS = 7


def asks_about_past(text: Column) -> Column:
    return is_true(text.rlike(rules.ASKS_ABOUT_PAST))


def link_words(said: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """``key, term, own_at, body_at, title_at``: the earliest time at which a text holds each word, by kind of text.

    Titles, topics, notes and short remarks are a link's own words; its text and long remarks are
    body words. Titles and texts have no time and count from the beginning.
    """
    c = F.col
    short = utf16_length(c("text")) <= SHORT_REMARK
    said = said.select("key", c("text"), c("at"), F.when(short, "own").otherwise("body").alias("part"))
    notes = notes.select("key", "text", "at", F.lit("own").alias("part"))
    long_form = F.array(
        F.struct(F.lit("title").alias("part"), F.concat_ws(" ", "title", F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")).alias("text")),
        F.struct(F.lit("body").alias("part"), c("text").alias("text")),
    )
    head = links.select("key", F.explode(long_form).alias("f")).select(
        "key", "f.text", F.lit(None).cast("timestamp").alias("at"), "f.part"
    )
    texts = said.unionByName(notes).unionByName(head).filter("text <> ''").dropDuplicates(["key", "text", "part", "at"])
    words = texts.select("key", "at", "part", F.explode(memory_words(c("text"))).alias("term"))
    when = lambda *parts: F.min(F.when(c("part").isin(*parts), F.coalesce(c("at"), F.lit("1970-01-01").cast("timestamp"))))
    return words.groupBy("key", "term").agg(
        when("own", "title").alias("own_at"), when("body").alias("body_at"), when("title").alias("title_at")
    )


def since_born(words: DataFrame, born: DataFrame) -> DataFrame:
    """``link_words`` from when each link exists: nothing of it is available before its first remark (``born``)."""
    live = lambda x: F.when(F.col(x).isNotNull(), F.greatest(x, "born")).alias(x)
    return salted_join(words, born, ["key"], spread=["term"]).select("key", "term", live("own_at"), live("body_at"), live("title_at"))


def link_terms(book: LinkBook) -> DataFrame:
    """``key, term, own_at, body_at, title_at``: from when each word identifies a link."""
    born = book.said.groupBy("key").agg(F.min("at").alias("born"))
    return since_born(link_words(book.said, book.notes, book.links), born)


def rare_link_terms(terms: DataFrame, rare: int = RARE_LINKS) -> DataFrame:
    """For each term the first ``rare`` links that hold it, and when one more made it common.

    A term counts as rare at time t while at most ``rare`` links hold it, that is until the link
    after those appears. Keeping that one moment replaces counting links as of every message.
    """
    c = F.col
    since = F.least("own_at", "body_at")
    order = Window.partitionBy("term").orderBy("since", "key")
    ranked = terms.withColumn("since", since).withColumn("r", F.row_number().over(order)).filter(c("r") <= rare + 1)
    one_more = F.max(F.when(c("r") == rare + 1, c("since"))).over(Window.partitionBy("term"))
    return ranked.withColumn("common_from", one_more).filter(c("r") <= rare).drop("r", "since")


def link_standing(book: LinkBook) -> DataFrame:
    """Per link: when first said and by which session, when first said by any other, first note."""
    c = F.col
    by_session = book.said.groupBy("key", "session").agg(F.min("at").alias("at"))
    marked = F.struct(c("at"), F.coalesce("session", F.lit("")).alias("s"), c("session").alias("session"))
    first = by_session.groupBy("key").agg(F.min(marked).alias("f"))
    joined = salted_join(by_session, first, ["key"], spread=["session"])
    other = joined.groupBy("key").agg(
        F.min("f").alias("f"), F.min(F.when(~c("session").eqNullSafe(c("f.session")), c("at"))).alias("other_at")
    )
    notes = book.notes.groupBy("key").agg(F.min("at").alias("noted_at"))
    out = other.join(notes, "key", "left").join(book.links.select("key", "title"), "key")
    return out.select(
        "key", c("f.at").alias("born"), c("f.session").alias("first_session"), "other_at", "noted_at",
        F.coalesce(F.when(c("title") != "", c("title")), c("key")).alias("thing"),
    )


def _said_elsewhere(as_of: bool) -> Column:
    """Some other session than the message's handed the link over (before the message, as of)."""
    c = F.col
    there = F.when(~c("session").eqNullSafe(c("first_session")), c("born")).otherwise(c("other_at"))
    return is_true(there < c("at")) if as_of else there.isNotNull()


def recall_candidates(
    messages: DataFrame, book: LinkBook, vocab: DataFrame, total: DataFrame, as_of: bool = False,
    skip: bool = True, rare: int = RARE_LINKS, min_score: float = MIN_SCORE, picks: DataFrame | None = None, terms: DataFrame | None = None,
) -> DataFrame:
    """Every link that passes the rare-word rule for a message, with its score, before the top 3.

    ``terms`` are the book's rare words where they are kept (``rare_link_terms``); they are worked out when not given.

    The word join meets at most ``rare`` links per term. ``skip`` leaves out links in the message
    itself (``picks``, found again when not given) and links only ever handed over in the same session.
    """
    c = F.col
    asked = keywords(messages, vocab, total)
    if terms is None:
        terms = rare_link_terms(link_terms(book), rare)
    hits = salted_join(asked, terms, ["term"], spread=["msg_id"])
    if as_of:
        hits = hits.filter(c("common_from").isNull() | (c("at") <= c("common_from")))
        own, body = is_true(c("own_at") < c("at")), is_true(c("body_at") < c("at"))
    else:
        hits = hits.filter(c("common_from").isNull())
        own, body = c("own_at").isNotNull(), c("body_at").isNotNull()
    hits = hits.withColumns({"own": own, "body": ~own & body}).filter("own OR body")
    per_link = hits.groupBy("msg_id", "at", "session", "key").agg(
        F.count_if("own").alias("n_own"), F.count("*").alias("n_hits"),
        F.sum(c("weight") * F.when(c("own"), 1.0).otherwise(0.5)).alias("raw"),
        F.array_sort(F.collect_set("term")).alias("matched"),
    )
    per_link = per_link.filter((c("n_own") >= 1) & (c("n_hits") >= 2) & (c("raw") >= min_score))
    out = per_link.join(link_standing(book), "key").withColumn("score", F.round("raw", 2))
    if skip:
        fresh = (pick_links(messages) if picks is None else picks).select("msg_id", "key")
        out = out.filter(_said_elsewhere(as_of)).join(fresh, ["msg_id", "key"], "left_anti")
    noted = is_true(c("noted_at") < c("at")) if as_of else c("noted_at").isNotNull()
    return out.select("msg_id", "at", "session", "key", "score", noted.alias("noted"), c("born").alias("first_seen"), "matched")


def rank_rare(candidates: DataFrame, limit: int | None = 3) -> DataFrame:
    best = Window.partitionBy("msg_id").orderBy(F.desc("score"), F.desc("noted"), F.desc("first_seen"), "key")
    ranked = candidates.withColumn("rank", F.row_number().over(best))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def recall_rare(messages: DataFrame, book: LinkBook, vocab: DataFrame, total: DataFrame, limit: int = 3, **kw) -> DataFrame:
    """``msg_id, rank, key, score, matched``: links sharing two words this person rarely uses."""
    return rank_rare(recall_candidates(messages, book, vocab, total, **kw), limit)


def remark_trail(book: LinkBook) -> DataFrame:
    """Each remark with its session and the time of the latest earlier remark by another session.

    That earlier time is where the session last changed, so it is found by looking at neighbours.
    """
    c = F.col
    remarks = book.said.select("key", "at", "session").distinct()
    ordered = with_neighbours(remarks, "key", "at", ["at", "session"], "session", unit="day")
    newest = remarks.groupBy("key").agg(F.max(F.struct("at", "session")).alias("n"))
    ordered = salted_join(ordered, newest, ["key"], spread=["at", "session"])
    changes = ordered.filter(
        (F.struct("at", "session") != c("n")) & ~c("session").eqNullSafe(c("next_session"))
    ).select("key", "at", F.struct(c("at").alias("other_at")).alias("change"))
    return last_before(ordered.select("key", "at", "session"), changes, "key", "at", "change").select(
        "key", "at", F.struct(c("at").alias("said_at"), c("session").alias("said_in"), c("change.other_at").alias("other_at")).alias("remark")
    )


def recent_candidates(
    messages: DataFrame, book: LinkBook, vocab: DataFrame, total: DataFrame, days: int = RECENT_DAYS, skip: bool = True,
    picks: DataFrame | None = None, longest: int | None = None,
) -> DataFrame:
    """``msg_id, at, session, term, key, thing, in_title, last_at`` of links handed over lately.

    Words meet links on (term, day): a link takes part only on days it was handed over and the
    ``days`` after. The exact time and session test is an as-of lookup of the link's last remark,
    so messages are never paired with single remarks. Messages of more than ``longest`` UTF-16 units are
    left out if it is set.
    """
    c = F.col
    heard = messages if longest is None else messages.filter(utf16_length(c("text")) <= longest)
    asked = weighted_terms(heard, vocab, total).filter("total > 0 AND n <= total / 50").select("msg_id", "at", "session", "term")
    asked = asked.filter(~(c("term").rlike("[一-鿿]") & c("term").rlike(rules.FUNCTION_CHARS))).withColumn("day", F.to_date("at"))
    active = book.said.select("key", F.to_date("at").alias("d")).distinct()
    active = active.select("key", F.explode(F.sequence(c("d"), F.date_add("d", days))).alias("day")).distinct()
    own = link_terms(book).filter("own_at IS NOT NULL").select("key", "term", "own_at", "title_at")
    lately = salted_join(own, active, ["key"], spread=["term"])
    pairs = salted_join(lately, asked, ["term", "day"], spread=["key"]).filter(c("own_at") < c("at"))
    pairs = pairs.select("msg_id", "at", "session", "term", "key", is_true(c("title_at") < c("at")).alias("in_title"))
    if skip:
        fresh = (pick_links(messages) if picks is None else picks).select("msg_id", "key")
        pairs = pairs.join(fresh, ["msg_id", "key"], "left_anti")
    # The largest table of the job, read below for the meetings and for the words: written down once.
    pairs = cut_lineage(pairs)

    meetings = last_before(pairs.select("msg_id", "at", "session", "key").distinct(), remark_trail(book), "key", "at", "remark")
    elsewhere = F.when(~c("remark.said_in").eqNullSafe(c("session")), c("remark.said_at")).otherwise(c("remark.other_at"))
    meetings = meetings.filter(elsewhere >= c("at") - F.make_dt_interval(F.lit(days)))
    meetings = meetings.select("msg_id", "key", c("remark.said_at").alias("last_at"))
    things = book.links.select("key", F.coalesce(F.when(c("title") != "", c("title")), c("key")).alias("thing"))
    return pairs.join(meetings, ["msg_id", "key"]).join(things, "key").select(
        "msg_id", "at", "session", "term", "key", "thing", "in_title", "last_at"
    )


def rank_recent(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """A word speaks when it names two different things and stands in a title; newest links first."""
    c = F.col
    candidates = cut_lineage(candidates)
    words = candidates.groupBy("msg_id", "term").agg(
        F.count_distinct("thing").alias("things"), F.max("in_title").alias("titled")
    ).filter("things >= 2 AND titled")
    hits = candidates.join(words.select("msg_id", "term"), ["msg_id", "term"]).groupBy("msg_id", "at", "session", "key").agg(
        F.max("last_at").alias("last_at"), F.array_sort(F.collect_set("term")).alias("matched")
    )
    newest = Window.partitionBy("msg_id").orderBy(F.desc("last_at"), "key")
    return hits.withColumn("rank", F.row_number().over(newest)).filter(c("rank") <= limit)


def recall_recent(
    messages: DataFrame, book: LinkBook, vocab: DataFrame, total: DataFrame, limit: int = 3, longest: int | None = None, **kw
) -> DataFrame:
    return rank_recent(recent_candidates(messages, book, vocab, total, longest=longest, **kw), limit)


def route_prompts(
    messages: DataFrame, book: LinkBook, vocab: DataFrame, total: DataFrame, picks: DataFrame | None = None
) -> DataFrame:
    """``msg_id, route, rank, key``: a question about an earlier link is searched, the rest recalled.

    A link is recalled once per session: what an earlier message of the session was shown makes room for the next.
    """
    c = F.col
    asking = messages.filter(asks_about_past(c("text")))
    other = messages.filter(~asks_about_past(c("text")))
    topic = keywords(asking, vocab, total).groupBy("msg_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("query"))
    found = find_links(book, topic.select(c("msg_id").alias("query_id"), "query"), k=5)
    found = found.select(c("query_id").alias("msg_id"), F.lit("search").alias("route"), "rank", c("doc").alias("key"))
    fresh = (pick_links(asking) if picks is None else picks).select("msg_id", "key")
    found = found.join(fresh, ["msg_id", "key"], "left_anti")
    ranked = rank_rare(recall_candidates(other, book, vocab, total, picks=picks), None)
    recalled = once_per_session(_rare_rows(ranked)).select("msg_id", F.lit("recall").alias("route"), "rank", "key")
    return found.select("msg_id", "route", "rank", "key").unionByName(recalled)


# --- replay over history -----------------------------------------------------------------


def history(messages: DataFrame) -> DataFrame:
    """Each message once: a text first typed in another session is a copy; repeats in its own stay."""
    c = F.col
    dated = messages.filter("at IS NOT NULL").withColumn("_t", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    owner = dated.groupBy("_t").agg(F.min_by(F.struct("session"), F.struct("at", "msg_id")).alias("o"))
    kept = salted_join(dated, owner, ["_t"], spread=["msg_id"])
    return kept.filter(c("session").eqNullSafe(c("o.session"))).drop("_t", "o")


def book_at(book: LinkBook, at) -> LinkBook:
    """The book as it stood at one moment: later remarks and notes, and links without any, are gone."""
    said = book.said.filter(F.col("at") < F.lit(at).cast("timestamp"))
    born = said.groupBy("key").agg(F.min("at").alias("first_seen"))
    links = book.links.drop("first_seen").join(born, "key")
    notes = book.notes.filter(F.col("at") < F.lit(at).cast("timestamp")).join(born.select("key"), "key", "left_semi")
    return LinkBook(links, said, notes)


REPLAY_SCHEMA = "msg_id bigint, channel string, session string, key string, rank int"


def _once_per_session(batches):
    """Rows arrive sorted by (session, channel, at, msg_id, ...); state is the set of links shown.

    ``rare`` keeps the best three not shown yet. ``recent`` leaves shown links out before it asks
    whether a word still names two things, as a live run would.
    """
    import itertools

    import pandas as pd

    def rows():
        for pdf in batches:
            yield from pdf.itertuples(index=False)

    def recent_keys(group, shown):
        live = [r for r in group if r.key not in shown]
        live.sort(key=lambda r: r.term)
        hits = {}
        for _, named in itertools.groupby(live, key=lambda r: r.term):
            named = list(named)
            if len({r.thing for r in named}) >= 2 and any(r.in_title for r in named):
                hits.update({r.key: r.last_at for r in named})
        by_key = sorted(hits)
        return sorted(by_key, key=lambda k: hits[k], reverse=True)

    out, shown, now = [], set(), None
    for (session, channel, _, msg), group in itertools.groupby(rows(), key=lambda r: (r.session, r.channel, r.at, r.msg_id)):
        if (session, channel) != now:
            now, shown = (session, channel), set()
        group = list(group)
        keys = [r.key for r in group if r.key not in shown] if channel == "rare" else recent_keys(group, shown)
        for i, key in enumerate(keys[:3]):
            shown.add(key)
            out.append((msg, channel, session, key, i + 1))
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["msg_id", "channel", "session", "key", "rank"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["msg_id", "channel", "session", "key", "rank"])


def replay(
    messages: DataFrame, book: LinkBook, vocab: DataFrame, total: DataFrame, picks: DataFrame | None = None
) -> DataFrame:
    """Both channels over all history, each message against the book as of its time.

    Spark reduces history to candidates; only the order-dependent "not yet shown in this session"
    pass runs in Python, streaming over rows sorted by session with the shown links as its state.
    """
    c = F.col
    heard = messages.filter(~asks_about_past(c("text")))
    rare = _rare_rows(rank_rare(recall_candidates(heard, book, vocab, total, as_of=True, picks=picks), None))
    recent = recent_candidates(heard, book, vocab, total, picks=picks)
    recent = recent.select(
        "msg_id", F.lit("recent").alias("channel"), "session", "at", F.lit(0).alias("rank"), "key", "term", "thing",
        "in_title", "last_at",
    )
    return once_per_session(rare.unionByName(recent))


def _rare_rows(ranked: DataFrame) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return ranked.select(
        "msg_id", F.lit("rare").alias("channel"), "session", "at", "rank", "key", none("string").alias("term"),
        none("string").alias("thing"), none("boolean").alias("in_title"), none("timestamp").alias("last_at"),
    )


def once_per_session(rows: DataFrame) -> DataFrame:
    """The order-dependent pass: candidates of a session in time order, each link shown at most once a channel."""
    dealt = rows.repartition("session", "channel")
    return dealt.sortWithinPartitions("session", "channel", "at", "msg_id", "rank").mapInPandas(_once_per_session, REPLAY_SCHEMA)


def firing_rates(messages: DataFrame, fired: DataFrame) -> DataFrame:
    """``messages, asking, rare, recent, both`` and the rates of the two channels."""
    c = F.col
    per_message = fired.groupBy("msg_id").agg(
        F.max(c("channel") == "rare").alias("rare"), F.max(c("channel") == "recent").alias("recent")
    )
    counts = per_message.agg(
        F.count_if("rare").alias("rare"), F.count_if("recent").alias("recent"), F.count_if(c("rare") & c("recent")).alias("both")
    )
    n = messages.agg(F.count("*").alias("messages"), F.count_if(asks_about_past(c("text"))).alias("asking"))
    return n.join(F.broadcast(counts), F.lit(True)).select(
        "messages", "asking", "rare", "recent", "both",
        F.try_divide(c("rare"), c("messages")).alias("rare_rate"), F.try_divide(c("recent"), c("messages")).alias("recent_rate"),
    )


def sample_hits(fired: DataFrame, messages: DataFrame, n: int = 30, seed: int = 1, channel: str = "recent", probe: str | None = None) -> DataFrame:
    """A repeatable sample of messages one channel spoke on, oldest first."""
    ids = fired.filter(F.col("channel") == channel).select("msg_id").distinct()
    rows = messages.join(ids, "msg_id", "left_semi")
    if probe:
        rows = rows.filter(F.col("text").contains(probe))
    return rows.orderBy(F.xxhash64("msg_id", F.lit(seed)), "msg_id").limit(n).orderBy("at", "msg_id")


