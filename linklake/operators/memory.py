"""Link memory: links handed over in messages, what was said about them, and what they are."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.privacy import with_privacy
from ..functions.text import fold_space, is_relayed, memory_words, own_words, shortened, utf16_length
from .screening import drop_ignored
from .search import Index, best_scores, build_index, expand_queries, top_k
from .skew import is_true, salted_join

REACH = 100
SHORT_REMARK = 80
DETAILS = {
    "kind": "string", "title": "string", "text": "string", "author": "string", "posted_at": "string",
    "media": "array<string>", "stars": "bigint", "topics": "array<string>", "status": "string",
    "enriched_at": "timestamp", "enrich_error": "string",
}


@dataclass
class LinkBook:
    """``links`` has one row per link, ``said`` one per remark, ``notes`` one per conclusion."""

    links: DataFrame
    said: DataFrame
    notes: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "LinkBook":
        details = ", ".join(f"{k} {t}" for k, t in DETAILS.items())
        return LinkBook(
            spark.createDataFrame([], f"key string, url string, first_seen timestamp, {details}"),
            spark.createDataFrame([], "key string, text string, at timestamp, session string, project string, ord bigint"),
            spark.createDataFrame([], "key string, text string, at timestamp"),
        )


# --- capture -----------------------------------------------------------------------------


def _around(own: Column, at: Column, length: Column) -> Column:
    """The sentence or two around a link: whole sentences only where the window cuts the text."""
    stop = "[" + rules.SENTENCE_STOPS + "]"
    not_stop = "[^" + rules.SENTENCE_STOPS + "]"
    before = F.substring(own, F.greatest(at - REACH, F.lit(0)) + 1, F.least(at, F.lit(REACH)))
    after = F.substring(own, at + length + 1, F.lit(REACH))
    before = F.when(at - REACH > 0, F.regexp_replace(before, f"^{not_stop}*{stop}", "")).otherwise(before)
    cut = F.regexp_extract(after, f"(?s)^(.*{stop})", 1)
    after = F.when((at + length + REACH < F.length(own)) & (cut != ""), cut).otherwise(after)
    said = F.concat(before, F.lit(" "), after)
    for pattern in (rules.MESSAGE_LINK, r"</?pasted_content[^>]*>", r"\[Image #\d+\]"):
        said = F.regexp_replace(said, pattern, " ")
    return fold_space(said)


def pick_links(messages: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """``msg_id, key, url, said, idx`` and the message columns: links a person handed over.

    Relayed messages and quoted lines are out; so are fragments, bare addresses, private URLs,
    work items and ignored hosts. One row per (message, link).
    """
    c = F.col
    keep = [x for x in messages.columns if x != "text"]
    own = F.regexp_replace("text", r"(?md)^[^\S\n]*>[^\n]*", "")
    texts = messages.filter(~is_relayed(c("text")) & F.contains(c("text"), F.lit("http"))).select(*keep, own.alias("own"))
    found = texts.withColumns(
        {
            "_links": F.regexp_extract_all("own", F.lit(rules.MESSAGE_LINK), F.lit(0)),
            "_gaps": F.split("own", rules.MESSAGE_LINK),
        }
    ).filter(F.size("_links") > 0)
    placed = F.aggregate(
        F.arrays_zip(c("_links").alias("m"), F.slice("_gaps", F.lit(1), F.size("_links")).alias("g")),
        F.struct(F.lit(0).alias("off"), F.expr("cast(array() as array<struct<m:string,at:int>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["off"] + F.length(x["g"]) + F.length(x["m"])).alias("off"),
            F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), (acc["off"] + F.length(x["g"])).alias("at")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    rows = found.select(*keep, "own", F.posexplode(placed).alias("idx", "l"))
    rows = rows.withColumn("_raw", F.regexp_replace("l.m", r"[.,;:!?*]+$", ""))
    rows = rows.withColumn("said", _around(c("own"), c("l.at"), F.length("_raw"))).drop("own", "l")
    rows = urls.canonicalise(rows, "_raw").filter(
        c("u_host").rlike(r"(?i)\.[a-z]{2,}$") & ~c("u_host").rlike(r"^\d+(\.\d+){3}$")
    )
    rows = urls.with_link_key(with_privacy(rows).filter("NOT is_private"))
    for pattern in rules.NOT_A_RESOURCE:
        rows = rows.filter(~c("key").rlike(pattern))
    rows = rows.select(*keep, "idx", "key", c("u_url").alias("url"), "said")
    if ignore is not None:
        rows = drop_ignored(rows, ignore)
    rest = [x for x in rows.columns if x not in ("msg_id", "key", "idx")]
    first = rows.groupBy("msg_id", "key").agg(F.min_by(F.struct(*rest), "idx").alias("r"), F.min("idx").alias("idx"))
    return first.select("msg_id", "key", "idx", "r.*")


def capture(book: LinkBook | None, picks: DataFrame) -> LinkBook:
    """Fold picked links into the book. The same words in the same session are kept once."""
    c = F.col
    spark = picks.sparkSession
    project = urls.blank_to_null(F.regexp_extract("cwd", r"([^/]+)/*$", 1)) if "cwd" in picks.columns else F.lit(None).cast("string")
    new_said = picks.select(
        "key", c("said").alias("text"), "at", "session", project.alias("project"),
        F.xxhash64("msg_id", "idx").alias("ord"),
    )
    said = new_said if book is None else book.said.unionByName(new_said)
    alone = F.when(c("session").isNull(), c("ord"))
    order = F.struct("at", "ord")
    said = said.groupBy("key", "session", "text", alone.alias("_a")).agg(
        F.min("at").alias("at"), F.min_by("project", order).alias("project"), F.min_by("ord", order).alias("ord")
    ).select("key", "text", "at", "session", "project", "ord")
    new_links = picks.groupBy("key").agg(
        F.min_by("url", F.struct("at", "msg_id", "idx")).alias("url"), F.min("at").alias("first_seen")
    )
    if book is None:
        details = [F.lit(None).cast(t).alias(k) for k, t in DETAILS.items()]
        links = new_links.select("key", "url", "first_seen", *details)
        return LinkBook(links, said, LinkBook.empty(spark).notes)
    joined = book.links.join(new_links.withColumnsRenamed({"url": "_url", "first_seen": "_seen"}), "key", "full")
    links = joined.select(
        "key", F.coalesce("url", "_url").alias("url"), F.least("first_seen", "_seen").alias("first_seen"), *DETAILS
    )
    return LinkBook(links, said, book.notes)


def add_notes(book: LinkBook, notes: DataFrame) -> LinkBook:
    """``target`` (key or URL), ``text``, ``at`` rows attached to links that are in the book."""
    c = F.col
    keyed = urls.with_link_key(urls.canonicalise(notes, "target", keep_bad=True), name="_by_url")
    keyed = keyed.select("target", "text", "at", "_by_url")
    known = book.links.select("key")
    exact = keyed.join(known, c("target") == c("key"), "left").withColumnRenamed("key", "_exact")
    by_url = exact.join(known, c("_by_url") == c("key"), "left")
    found = by_url.select(F.coalesce("_exact", "key").alias("key"), "text", "at").filter("key IS NOT NULL")
    return LinkBook(book.links, book.said, book.notes.unionByName(found))


# --- vocabulary --------------------------------------------------------------------------


def message_terms(messages: DataFrame) -> DataFrame:
    """``msg_id, at, session, term``: distinct own words of each message that was not relayed."""
    keep = [x for x in ("msg_id", "at", "session") if x in messages.columns]
    return messages.filter(~is_relayed(F.col("text"))).select(
        *keep, F.explode(memory_words(own_words(F.col("text")))).alias("term")
    )


def learn_vocab(messages: DataFrame, keep: int = 3) -> tuple[DataFrame, DataFrame]:
    """``vocab(term, n)`` with n >= ``keep`` and the one-row ``total(total)``."""
    vocab = message_terms(messages).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= keep)
    total = messages.agg(F.count_if(~is_relayed(F.col("text"))).alias("total"))
    return vocab, total


def weighted_terms(messages: DataFrame, vocab: DataFrame, total: DataFrame) -> DataFrame:
    """Message terms with ``n`` (how often this person says the word), ``m`` and the weight."""
    terms = message_terms(messages)
    known = salted_join(terms, vocab, ["term"], "left", spread=["msg_id"])
    m = F.greatest(F.col("total"), F.lit(1))
    return known.join(F.broadcast(total), F.lit(True)).select(
        *terms.columns, F.coalesce("n", F.lit(0)).alias("n"), "total", m.alias("m"),
        F.log((m + 1) / (F.coalesce("n", F.lit(0)) + 1)).alias("weight"),
    )


def keywords(messages: DataFrame, vocab: DataFrame, total: DataFrame) -> DataFrame:
    """``msg_id, term``: words used in at most one message in 500."""
    return weighted_terms(messages, vocab, total).filter("n <= m / 500")


# --- the book read back ------------------------------------------------------------------


def newest_links(book: LinkBook, limit: int = 20) -> DataFrame:
    return book.links.orderBy(F.desc("first_seen"), "key").limit(limit)


def describe_links(book: LinkBook, limit: int | None = None) -> DataFrame:
    """One line per link: day, what it is, the best remark, the last conclusion, the last project."""
    c = F.col
    order = F.struct("at", "ord")
    spoken = F.when(c("text") != "", c("text"))
    short = F.when(utf16_length(spoken) <= SHORT_REMARK, spoken)
    # The longest short remark; of equal ones the first said.
    rank = F.struct(utf16_length(short).alias("l"), (-F.unix_micros("at")).alias("a"), (-c("ord").cast("decimal(20,0)")).alias("o"))
    said = book.said.groupBy("key").agg(
        F.max_by(short, F.when(short.isNotNull(), rank)).alias("short"),
        F.min_by(spoken, F.when(spoken.isNotNull(), order)).alias("any"),
        F.max_by("project", F.when(c("project").isNotNull(), order)).alias("project"),
    )
    notes = book.notes.groupBy("key").agg(F.max_by("text", "at").alias("note"))
    out = book.links.join(said, "key", "left").join(notes, "key", "left")
    what = F.coalesce(urls.blank_to_null(c("title")), urls.blank_to_null(c("text")), F.lit(""))
    return out.select(
        "key", "url", F.date_format("first_seen", "yyyy-MM-dd").alias("day"),
        shortened(F.regexp_replace(what, r"(?U)\s+", " "), limit).alias("what"),
        shortened(F.coalesce("short", "any", F.lit("")), limit).alias("said"),
        F.coalesce("note", F.lit("")).alias("note"), "project",
    )


def book_fields(book: LinkBook) -> DataFrame:
    """Search fields of the book: title, text, remarks and notes as claims, projects and topics as tags."""
    c = F.col
    scalar = F.array(
        F.struct(F.lit("key").alias("field"), c("key").alias("text")),
        F.struct(F.lit("url").alias("field"), c("url").alias("text")),
        F.struct(F.lit("title").alias("field"), c("title").alias("text")),
        F.struct(F.lit("description").alias("field"), c("text").alias("text")),
    )
    tags = F.transform(
        F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tags").alias("field"), t.alias("text"))
    )
    head = book.links.select(c("key").alias("doc"), F.explode(F.concat(scalar, tags)).alias("f")).select("doc", "f.field", "f.text")
    spoken = book.said.select("key", "text").unionByName(book.notes.select("key", "text"))
    claims = spoken.select(c("key").alias("doc"), F.lit("claims").alias("field"), "text")
    projects = book.said.select(c("key").alias("doc"), F.lit("tags").alias("field"), c("project").alias("text")).distinct()
    return head.unionByName(claims).unionByName(projects).filter("text <> ''")


def find_links(book: LinkBook, queries: DataFrame, k: int = 8, index: Index | None = None) -> DataFrame:
    """Explicit search of the book: ranked, not gated. ``query_id, doc, score, rank``."""
    index = index or build_index(book_fields(book), book.links.agg(F.count("*").alias("n")))
    return top_k(best_scores(index, expand_queries(queries), k), k)


# --- enrichment --------------------------------------------------------------------------


def enrich_due(book: LinkBook, as_of: datetime, everything: bool = False) -> DataFrame:
    """Links never enriched, or whose last attempt failed more than a day ago."""
    c = F.col
    old = c("enriched_at") < F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    due = F.lit(everything) | c("enriched_at").isNull() | is_true(c("enrich_error").isNotNull() & old)
    return book.links.filter(due).select("key", "url", "enriched_at", "enrich_error")


def enrichment(
    book: LinkBook, posts: DataFrame, repos: DataFrame, pages: DataFrame, as_of: datetime,
    title_length: int | None = None, text_length: int | None = None,
) -> DataFrame:
    """What each link is, by kind: the post's words, the repository's facts, or the page's title.

    ``posts`` are best snapshots by ``post_id``; ``repos`` and ``pages`` are verdict rows by link key.
    """
    c = F.col
    links = book.links.select("key", "url").withColumns(
        {"post_id": urls.post_id(c("url")), "repo": F.regexp_extract("key", r"^github\.com/([^/]+/[^/]+)", 1)}
    )
    words = F.trim(F.regexp_replace("p.text", r"https?://\S+", ""))
    significant = lambda s: utf16_length(F.regexp_replace(s, r"(?U)[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\s:：]", ""))
    head = F.aggregate(
        F.split(words, r"\r?\n"), F.lit(""),
        lambda acc, l: F.when(significant(acc) >= 12, acc).otherwise(F.trim(F.concat(acc, F.lit(" "), F.trim(l)))),
    )
    media = F.when(F.size("p.media") > 0, F.array_distinct("p.media"))
    post_title = F.coalesce(
        urls.blank_to_null(c("p.article.title")), urls.blank_to_null(shortened(head, title_length)),
        F.when(F.array_contains(media, "video"), F.concat(F.lit("@"), c("p.author"), F.lit(rules.VIDEO_POST))),
    )
    parts = [urls.blank_to_null(c("p.article.title")), urls.blank_to_null(c("p.article.preview")), urls.blank_to_null(words)]
    post_text = shortened(F.concat_ws("\n", *parts), text_length)
    p = posts.select("post_id", F.struct(*[x for x in posts.columns if x != "post_id"]).alias("p"))
    r = repos.select("key", F.struct("status", "page_title", "description", "github").alias("r"))
    g = pages.select("key", F.struct("status", "page_title", "og_title", "description").alias("g"))
    kind = F.when(c("post_id").isNotNull(), "post").when(c("repo") != "", "repo").otherwise("page")
    out = links.withColumn("kind", kind).join(p, "post_id", "left").join(r, "key", "left").join(g, "key", "left")
    by = lambda post, repo, page: F.when(c("kind") == "post", post).when(c("kind") == "repo", repo).otherwise(page)
    null = F.lit(None)
    missing = by(c("p").isNull(), c("r").isNull(), c("g").isNull())
    return out.select(
        "key", F.when(~missing, c("kind")).alias("kind"),
        by(post_title, F.when(c("r").isNotNull(), F.coalesce("r.page_title", "repo")), F.coalesce("g.page_title", "g.og_title")).alias("title"),
        by(post_text, c("r.description"), c("g.description")).alias("text"),
        by(c("p.author"), null, null).cast("string").alias("author"),
        by(c("p.created_at"), null, null).cast("string").alias("posted_at"),
        by(media, null, null).cast("array<string>").alias("media"),
        by(null, c("r.github.stars"), null).cast("bigint").alias("stars"),
        by(null, c("r.github.topics"), null).cast("array<string>").alias("topics"),
        by(null, c("r.status"), c("g.status")).cast("string").alias("status"),
        F.lit(as_of).cast("timestamp").alias("enriched_at"),
        F.when(missing, F.concat(c("kind"), F.lit(" unavailable"))).alias("enrich_error"),
    )


def apply_enrichment(book: LinkBook, details: DataFrame) -> LinkBook:
    """Replace the detail columns of the named links; remarks captured meanwhile stay untouched."""
    c = F.col
    new = details.select("key", F.lit(True).alias("_hit"), F.struct(*DETAILS).alias("_d"))
    links = book.links.join(new, "key", "left").select(
        "key", "url", "first_seen", *[F.when(c("_hit"), c("_d." + k)).otherwise(c(k)).alias(k) for k in DETAILS]
    )
    return LinkBook(links, book.said, book.notes)
