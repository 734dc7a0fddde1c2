"""The registered queries: each runs one operator over whole tables of a data directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.html import with_page_metadata
from ..operators import analytics as an
from ..operators import extract, liveness, memory, publish, recall, redirects, screening, search, views
from ..operators.library import Library, apply_fetches, entries, from_documents, to_documents, upsert, upsert_report
from ..operators.memory import LinkBook
from ..session import cut_lineage, shared_folder
from ..sources import agent_logs, bookmarks, events, library_io, posts, schemas
from . import bridge, pipelines

AS_OF = datetime(2024, 2, 1)
MOMENT = datetime(2024, 1, 3)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _joined(name: str, sep: str = "|"):
    return F.array_join(name, sep)


def _iso(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- shared inputs -----------------------------------------------------------------------


def _library(spark, d) -> Library:
    lib = upsert(None, bridge.sightings(spark, d))
    return Library(cut_lineage(lib.facts), lib.state)


def _checked(spark, d) -> Library:
    return apply_fetches(_library(spark, d), liveness.verdicts(bridge.fetches(spark, d).drop("page_id"))).kept()


def _picks(spark, d) -> tuple[DataFrame, DataFrame]:
    msgs = cut_lineage(bridge.messages(spark, d))
    return msgs, cut_lineage(memory.pick_links(msgs))


def _book(spark, d) -> tuple[LinkBook, DataFrame, DataFrame]:
    """The link book of all messages with page titles as what each link is, the messages, the picks."""
    msgs, picks = _picks(spark, d)
    book = memory.capture(None, picks)
    pages = with_page_metadata(bridge.view(spark, d, "fetch_log").select("url", "html"))
    keyed = urls.with_link_key(urls.canonicalise(pages.select("url", "page_title")))
    # The words of three conversations stand in for the post that they were about.
    said = bridge.table(spark, d, "conversations").select(
        F.concat(F.lit("x.com/status/"), (F.lit(1_000_000_000) + (c("conv_id") / 3).cast("bigint")).cast("string")).alias("key"), c("text").alias("page_title")
    )
    titles = keyed.select("key", "page_title").unionByName(said).groupBy("key").agg(F.min("page_title").alias("_title"))
    book.links = cut_lineage(book.links.join(titles, "key", "left").withColumn("title", c("_title")).drop("_title"))
    book.said = cut_lineage(book.said)
    notes = picks.filter(c("key").startswith("x.com/status/")).select(
        c("key").alias("target"), F.concat(F.lit("conclusion "), c("session")).alias("text"), (c("at") + F.expr("INTERVAL 1 HOUR")).alias("at")
    )
    book = memory.add_notes(book, notes)
    book.notes = cut_lineage(book.notes)
    return book, msgs, picks


def _vocab(msgs):
    vocab, total = memory.learn_vocab(msgs)
    return cut_lineage(vocab), total


# --- URLs and screening ------------------------------------------------------------------


@query
def canonical_urls(spark, d):
    rows = urls.canonicalise(bridge.sightings(spark, d).select("sighting_id", "url"))
    return rows.select("sighting_id", c("u_url").alias("canonical_url"), c("u_host").alias("host"))


@query
def resource_keys(spark, d):
    rows = urls.canonicalise(bridge.sightings(spark, d).select("sighting_id", "url"))
    return urls.with_resource_key(rows).select("sighting_id", urls.canonical_host(c("u_host")).alias("site"), "key")


@query
def best_urls(spark, d):
    rows = urls.with_resource_key(urls.canonicalise(bridge.sightings(spark, d).select("sighting_id", "url")))
    rows = rows.withColumn("rank", urls.url_rank())
    return rows.groupBy("key").agg(F.min_by("u_url", F.struct("rank", "sighting_id")).alias("url"))


@query
def link_keys(spark, d):
    raw = F.regexp_extract_all("text", F.lit(r"https?://\S+"), F.lit(0))
    rows = bridge.messages(spark, d).select("msg_id", F.posexplode(raw).alias("n", "url"))
    rows = urls.with_link_key(urls.canonicalise(rows))
    return rows.select("msg_id", "n", "key", urls.post_id(c("u_url")).alias("post_id"))


@query
def privacy_screen(spark, d):
    rows = screening.screen(bridge.sightings(spark, d).select("sighting_id", "url"))
    return rows.select("sighting_id", "kind", "is_private", _joined("reasons").alias("reasons"), "public_ancestor")


def _blocklist(spark, d):
    pages = urls.canonicalise(bridge.table(spark, d, "pages").select("url"))
    return pages.filter(c("u_host").rlike("pills|spam")).select(urls.canonical_host(c("u_host")).alias("domain")).distinct()


@query
def blocklist_screen(spark, d):
    rows = screening.screen(bridge.sightings(spark, d).select("sighting_id", "url"), _blocklist(spark, d))
    return rows.select("sighting_id", "is_private", _joined("reasons").alias("reasons"), "public_ancestor")


# --- extraction --------------------------------------------------------------------------


@query
def post_links(spark, d):
    rows = extract.links_in(bridge.view(spark, d, "posts"))
    return rows.select("post_id", "pos", "url", "shortened")


@query
def post_resources(spark, d):
    rows = extract.extract_resources(bridge.view(spark, d, "posts"))
    return rows.select("post_id", c("pos.n").alias("line"), c("pos.k").alias("k"), "url", "name", "note", "section")


@query
def post_contexts(spark, d):
    return extract.post_context(bridge.view(spark, d, "posts"))


@query
def post_leads(spark, d):
    return extract.leads_in(bridge.view(spark, d, "posts")).select("post_id", "name", "pos")


@query
def post_library(spark, d):
    """Posts to library rows: extraction and provenance, written down once, then screen and fold."""
    p = bridge.view(spark, d, "posts").select(
        "post_id", "text", F.concat(F.lit("https://x.com/i/status/"), "post_id").alias("url"), "author",
        F.lit("fxtwitter").alias("channel"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        *[F.lit(None).cast("bigint").alias(x) for x in ("likes", "retweets", "views")], F.lit(AS_OF).cast("timestamp").alias("seen_at"),
    )
    head = entries(upsert(None, cut_lineage(extract.post_sightings(p))))
    return head.select("key", "mentions", _joined("flags").alias("flags"))


@query
def page_metadata(spark, d):
    rows = with_page_metadata(bridge.table(spark, d, "pages"))
    return rows.select("page_id", c("page_title").alias("title"), "og_title", "description", "site_name", "image", "lang")


@query
def captured_links(spark, d):
    return memory.pick_links(bridge.messages(spark, d)).select("msg_id", "key", "url", "said")


@query
def ignored_links(spark, d):
    """Links left after an ignore list of block-listed sites and one host/path prefix."""
    hosts = _blocklist(spark, d).select(c("domain").alias("pattern"))
    first = urls.with_link_key(urls.canonicalise(bridge.table(spark, d, "pages").select("url")))
    prefix = first.select(F.regexp_extract("key", r"^[^/]+/(?:en|de)", 0).alias("pattern")).filter("pattern <> ''").distinct()
    return memory.pick_links(bridge.messages(spark, d), hosts.unionByName(prefix)).select("msg_id", "key")


# --- library -----------------------------------------------------------------------------


@query
def library_upsert(spark, d):
    """All facts of the folded library, one row each with its first sighting; no record is gathered."""
    lib = _library(spark, d)
    said = lib.facts.filter(c("kind").isin("name", "section", "local_section", "tag", "claim")).select(
        "key", "kind", "value", c("from").alias("origin"), c("pos.id").alias("place")
    )
    head = cut_lineage(entries(lib).select("key", "url", "mentions", "first_seen", "last_seen", "flags"))
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    facts = F.concat(
        F.array(one("url", c("url")), one("mentions", c("mentions")), one("first_seen", _iso("first_seen")), one("last_seen", _iso("last_seen"))),
        F.transform("flags", lambda f: one("flag", f)),
    )
    sources = lib.facts.filter("kind = 'source'").groupBy("key").agg(F.count("*").cast("string").alias("value"))
    rest = head.select("key", F.explode(facts).alias("x")).select("key", "x.kind", "x.value")
    rest = rest.unionByName(sources.withColumn("kind", F.lit("n_sources")))
    none = {"origin": F.lit(None).cast("string"), "place": F.lit(None).cast("bigint")}
    return said.unionByName(rest.withColumns(none))


@query
def upsert_created(spark, d):
    """Page addresses first, derived sightings second: which keys the second batch creates."""
    all_rows = bridge.sightings(spark, d)
    first = all_rows.filter(c("sighting_id") % 4 == 0)
    return upsert_report(upsert(None, first), all_rows.filter(c("sighting_id") % 4 != 0))


@query
def corroboration(spark, d):
    return publish.corroboration(_library(spark, d).facts)


@query
def risk_flags(spark, d):
    head = entries(_library(spark, d))
    return head.select("key", F.explode("flags").alias("flag"))


@query
def publish_gate(spark, d):
    head = entries(_checked(spark, d))
    return publish.publish_gate(head).select("key", "why", "mentions")


@query
def held_counts(spark, d):
    return publish.held_counts(entries(_checked(spark, d)))


@query
def published_sources(spark, d):
    facts = publish.published_library(_checked(spark, d)).facts.filter("kind = 'source'")
    return facts.groupBy("key", "source.type").agg(
        F.count("*").alias("n"), F.count("source.author").alias("authors"), F.count("source.folder").alias("folders"),
        F.count("source.by").alias("people"), F.max(F.length("source.at")).cast("bigint").alias("at_chars"),
    )


@query
def library_stats(spark, d):
    return publish.library_stats(_checked(spark, d))


@query
def flag_list(spark, d):
    return publish.flagged(entries(_library(spark, d)), "demoted").select("key", "mentions")


@query
def bookmark_folders(spark, d):
    """Bookmark trees of 50 pages each are flattened again and counted per folder."""
    pages = bridge.table(spark, d, "pages")
    leaf = F.struct(
        F.lit("url").alias("type"), F.concat(F.lit("t"), "page_id").alias("name"), "url",
        (F.lit(13_300_000_000_000_000) + c("page_id")).cast("string").alias("date_added"),
    )
    profile = F.concat(F.lit("profile"), F.floor(c("page_id") / 50).cast("string"))
    inner = pages.groupBy(profile.alias("profile"), F.concat(F.lit("f"), c("page_id") % 4).alias("name")).agg(F.collect_list(leaf).alias("kids"))
    folder = F.to_json(F.struct(F.lit("folder").alias("type"), "name", c("kids").alias("children")))
    trees = inner.groupBy("profile").agg(F.array_sort(F.collect_list(folder)).alias("f")).select(
        "profile",
        F.parse_json(
            F.concat(F.lit('{"roots":{"bar":{"type":"folder","name":"Bar","children":['), F.array_join("f", ","), F.lit("]}}}"))
        ).alias("tree"),
    )
    flat = bookmarks.flatten(trees)
    return flat.groupBy("profile", "folder", "folder_name").agg(
        F.count("*").alias("n"), F.min("title").alias("first_title"), F.max(F.unix_micros("added")).alias("last_added")
    )


# --- liveness and redirects --------------------------------------------------------------


@query
def liveness_verdicts(spark, d):
    rows = liveness.with_liveness(bridge.fetches(spark, d))
    return rows.select("page_id", "status", "note")


@query
def status_counts(spark, d):
    return liveness.status_counts(entries(_checked(spark, d)))


@query
def refresh_due(spark, d):
    due = liveness.refresh_due(entries(_checked(spark, d)), AS_OF)
    return due.select("key", "fetcher", _iso("checked_at").alias("checked_at"))


@query
def verified_library(spark, d):
    head = entries(_checked(spark, d))
    return head.select("key", "title", "lang", c("liveness.status").alias("status"), c("liveness.code").cast("bigint").alias("code"), "mentions")


def _repo_api(spark, d) -> DataFrame:
    """Answers of the repository interface, one for each part."""
    part = bridge.table(spark, d, "part")
    body = F.to_json(
        F.struct(
            c("p_name").alias("full_name"), c("p_type").alias("description"), c("p_size").alias("stargazers_count"),
            c("p_brand").alias("language"), F.split("p_name", " ").alias("topics"), (c("p_size") > 25).alias("archived"),
        )
    )
    code = F.when(c("p_size") % 10 == 0, 404).when(c("p_size") % 10 == 1, 451).when(c("p_size") % 10 == 2, 500).otherwise(200)
    return part.select(
        F.concat(F.lit("github.com/p/"), c("p_partkey").cast("string")).alias("key"), code.alias("code"), body.alias("body"),
        F.lit(AS_OF).cast("timestamp").alias("checked_at"),
    )


@query
def repo_facts(spark, d):
    """Repository API answers built from the parts table."""
    api = _repo_api(spark, d)
    v = liveness.repo_verdicts(api)
    return v.select(
        "key", "status", "note", c("page_title").alias("title"), "description", c("github.stars").alias("stars"),
        F.size("github.topics").cast("bigint").alias("n_topics"), c("github.archived").alias("archived"),
    )


@query
def redirect_edges(spark, d):
    edges = redirects.redirect_edges(entries(_checked(spark, d)))
    return edges.join(redirects.claimants(edges), "dst").select("src", "dst", "claimants")


@query
def redirect_merge(spark, d):
    lib = _checked(spark, d)
    head = cut_lineage(entries(lib))
    moves = cut_lineage(redirects.plan_moves(head))
    merged = redirects.merge_redirects(lib, moves, head)
    aliases = merged.facts.filter("kind = 'alias'").groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("a"))
    return entries(merged).join(aliases, "key", "left").select("key", "mentions", _joined("a").alias("aliases"), _iso("first_seen").alias("first_seen"))


@query
def submissions(spark, d):
    """Every derived sighting checked as a submission against the library of the page addresses."""
    rows = bridge.view(spark, d, "sightings")
    sub = rows.select(c("sighting_id").alias("submission_id"), "url", "note", F.lit(None).cast("string").alias("from_post"), c("name").alias("submitter"))
    head = entries(_library(spark, d))
    checked = liveness.check_submissions(sub, head, liveness.verdicts(bridge.fetches(spark, d).drop("page_id")))
    return checked.select(
        "submission_id", "key", "accepted", "reason", "suggested_url", "status", "duplicate", "known_mentions",
        _joined("flags").alias("flags"), F.size("warnings").cast("bigint").alias("n_warnings"),
    )


@query
def submission_entries(spark, d):
    rows = bridge.view(spark, d, "sightings")
    sub = rows.select(c("sighting_id").alias("submission_id"), "url", "note", F.lit(None).cast("string").alias("from_post"), c("src_by").alias("submitter"))
    checked = liveness.check_submissions(sub, entries(_library(spark, d)), liveness.verdicts(bridge.fetches(spark, d).drop("page_id")))
    head = entries(upsert(None, liveness.submission_sightings(checked, AS_OF)))
    return head.select("key", "mentions", "first_claim")


@query
def issue_bodies(spark, d):
    rows = bridge.view(spark, d, "sightings")
    sub = rows.select(c("sighting_id").alias("submission_id"), "url", "note", F.lit(None).cast("string").alias("from_post"), c("src_by").alias("submitter"))
    checked = liveness.check_submissions(sub, entries(_library(spark, d)), liveness.verdicts(bridge.fetches(spark, d).drop("page_id")))
    return views.issue_bodies(checked)


# --- search ------------------------------------------------------------------------------


def _doc_fields(spark, d):
    docs = bridge.table(spark, d, "documents")
    both = F.array(
        F.struct(F.lit("description").alias("field"), c("text").alias("text")), F.struct(F.lit("tags").alias("field"), c("source").alias("text"))
    )
    return docs.select(c("doc_id").alias("doc"), F.explode(both).alias("f")).select("doc", "f.field", "f.text")


@query
def tokens(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id", "text")
    return tx.explode_tokens(docs, "text").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query
def term_df(spark, d):
    return search.count_terms(_doc_fields(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query
def expanded_queries(spark, d):
    """Part types as queries: typed terms and the terms their synonyms add."""
    part = bridge.table(spark, d, "part")
    raw = F.concat_ws(" ", "p_name", F.when(c("p_size") % 3 == 0, "open source tool").when(c("p_size") % 3 == 1, "Design 动画 editing"))
    rows = search.expand_queries(part.select(c("p_partkey").alias("query_id"), raw.alias("query")))
    return rows.select("query_id", "term", "weight")


@query
def bm25_topk(spark, d):
    """Every benchmark passage as a query over all documents."""
    queries = bridge.table(spark, d, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))
    index = search.build_index(_doc_fields(spark, d), bridge.table(spark, d, "documents").agg(F.count("*").alias("n")))
    best = search.top_k(search.best_scores(index, search.expand_queries(queries), 10).withColumn("score", F.round("score", 6)), 10)
    return best.select("query_id", "doc", "rank", "score")


@query
def library_search(spark, d):
    """Note texts and section names of all sightings as queries over the verified library."""
    lib = _checked(spark, d)
    head = cut_lineage(entries(lib))
    v = bridge.view(spark, d, "sightings")
    queries = v.select(F.concat_ws(" ", "note", "tag").alias("query")).distinct().withColumn("query_id", c("query"))
    index = search.build_index(search.library_fields(lib, head), head.agg(F.count("*").alias("n")))
    scored = search.best_scores(index, search.expand_queries(queries), 5, search.prior(search.allowed(head)))
    scored = scored.withColumn("score", F.round("score", 6))
    return search.top_k(scored, 5).select("query_id", "doc", "rank", "score")


@query
def lookup_alias(spark, d):
    lib = _checked(spark, d)
    head = cut_lineage(entries(lib))
    moves = cut_lineage(redirects.plan_moves(head))
    merged = redirects.merge_redirects(lib, moves, head)
    wanted = head.select(c("key").alias("name"))
    return search.get_by_key(merged, entries(merged), wanted).select("name", "key")


@query
def browse(spark, d):
    lib = _library(spark, d)
    return search.browse(lib, entries(lib), section="ction3", tag="tag3", limit=200).select("key", "mentions")


@query
def brief_entries(spark, d):
    lib = _checked(spark, d)
    b = search.brief(lib, entries(lib))
    return b.select("key", "name", "description", _joined("tags").alias("tags"), _joined("claimed").alias("claimed"), "status", "sources")


# --- link memory -------------------------------------------------------------------------


@query
def link_book(spark, d):
    book, _, _ = _book(spark, d)
    said = book.said.groupBy("key").agg(F.count("*").alias("remarks"), F.count_distinct("session").alias("sessions"))
    return book.links.join(said, "key").select("key", "url", _iso("first_seen").alias("first_seen"), "remarks", "sessions")


@query
def link_notes(spark, d):
    book, _, _ = _book(spark, d)
    return book.notes.groupBy("key").agg(F.count("*").alias("n"), F.max_by("text", "at").alias("last_note"))


@query
def own_words(spark, d):
    m = bridge.messages(spark, d)
    return m.select("msg_id", tx.own_words(c("text")).alias("own"))


@query
def message_terms(spark, d):
    return memory.message_terms(bridge.messages(spark, d)).select("msg_id", "term")


@query
def vocabulary(spark, d):
    vocab, total = memory.learn_vocab(bridge.messages(spark, d))
    return vocab.join(F.broadcast(total), F.lit(True)).select("term", "n", "total")


@query
def message_keywords(spark, d):
    return memory.keywords(bridge.messages(spark, d), *memory.learn_vocab(bridge.messages(spark, d))).select("msg_id", "term")


@query
def asks_about_past(spark, d):
    return bridge.messages(spark, d).select("msg_id", recall.asks_about_past(c("text")).alias("asks"))


@query
def recall_rare(spark, d):
    book, msgs, picks = _book(spark, d)
    out = recall.recall_rare(msgs, book, *_vocab(msgs), picks=picks)
    return out.select("msg_id", "rank", "key", "score", _joined("matched").alias("matched"))


@query
def recall_recent(spark, d):
    book, msgs, picks = _book(spark, d)
    out = recall.recall_recent(msgs, book, *_vocab(msgs), picks=picks)
    return out.select("msg_id", "rank", "key", _joined("matched").alias("matched"))


@query
def find_links(spark, d):
    """Every page title as a question to the link book."""
    book, _, _ = _book(spark, d)
    titles = with_page_metadata(bridge.table(spark, d, "pages")).select(c("page_id").alias("query_id"), c("page_title").alias("query"))
    index = search.build_index(memory.book_fields(book), book.links.agg(F.count("*").alias("n")))
    scored = search.best_scores(index, search.expand_queries(titles), 5).withColumn("score", F.round("score", 6))
    return search.top_k(scored, 5).select("query_id", "doc", "rank", "score")


@query
def newest_links(spark, d):
    book, _, _ = _book(spark, d)
    return memory.newest_links(book, 20).select("key", _iso("first_seen").alias("first_seen"))


@query
def link_descriptions(spark, d):
    book, _, _ = _book(spark, d)
    return memory.describe_links(book).select("key", "day", "what", "said", "note", "project")


@query
def prompt_routes(spark, d):
    book, msgs, picks = _book(spark, d)
    return recall.route_prompts(msgs, book, *_vocab(msgs), picks)


@query
def message_history(spark, d):
    """Messages and their copies in a forked session an hour later: the copies go."""
    msgs = bridge.messages(spark, d)
    fork = msgs.select(
        (c("msg_id") + 500).alias("msg_id"), "text", (c("at") + F.expr("INTERVAL 1 HOUR")).alias("at"),
        F.concat(F.lit("fork"), "session").alias("session"), "cwd",
    )
    return recall.history(msgs.unionByName(fork)).select("msg_id", "session")


@query
def book_as_of(spark, d):
    book, _, _ = _book(spark, d)
    then = recall.book_at(book, MOMENT)
    said = then.said.groupBy("key").agg(F.count("*").alias("remarks"))
    notes = then.notes.groupBy("key").agg(F.count("*").alias("notes"))
    return then.links.join(said, "key").join(notes, "key", "left").select(
        "key", _iso("first_seen").alias("first_seen"), "remarks", F.coalesce("notes", F.lit(0)).alias("notes")
    )


@query
def replay(spark, d):
    book, msgs, picks = _book(spark, d)
    return recall.replay(recall.history(msgs), book, *_vocab(msgs), picks).select("msg_id", "channel", "key", "rank")


@query
def replay_rates(spark, d):
    book, msgs, picks = _book(spark, d)
    msgs = recall.history(msgs)
    return recall.firing_rates(msgs, recall.replay(msgs, book, *_vocab(msgs), picks))


@query
def replay_sample(spark, d):
    book, msgs, picks = _book(spark, d)
    fired = recall.replay(recall.history(msgs), book, *_vocab(msgs), picks)
    return recall.sample_hits(fired, msgs, 30, 7, "rare").select("msg_id", "session")


@query
def enrichment(spark, d):
    """What each link is, by kind, from posts built of the documents and from the fetched pages."""
    book, _, _ = _book(spark, d)
    docs = bridge.table(spark, d, "documents")
    snaps = docs.select(
        (c("doc_id") + 1_000_000_000).cast("string").alias("post_id"), "text", c("source").alias("author"),
        F.lit("2024-01-01").alias("created_at"), F.lit(None).cast("struct<title:string,preview:string>").alias("article"),
        F.array(F.lit("photo")).alias("media"),
    )
    pages = liveness.verdicts(bridge.fetches(spark, d).withColumn("key", c("url")).drop("page_id"))
    pages = urls.with_link_key(urls.canonicalise(pages.withColumnRenamed("key", "raw"), "raw"))
    pages = pages.groupBy("key").agg(
        *[F.max_by(x, F.struct("checked_at", "raw")).alias(x) for x in ("status", "page_title", "og_title", "description")]
    )
    api = _repo_api(spark, d)
    named = api.select(
        F.xxhash64("key").alias("msg_id"), F.lit(0).alias("idx"), "key", F.concat(F.lit("https://"), "key").alias("url"),
        F.lit("a repository").alias("said"), c("checked_at").alias("at"), F.lit("repositories").alias("session"),
    )
    book = memory.capture(book, named)
    repos = liveness.repo_verdicts(api)
    details = memory.enrichment(book, snaps, repos, pages, AS_OF)
    out = memory.apply_enrichment(book, details)
    return out.links.select("key", "kind", "title", "author", F.length("text").cast("bigint").alias("text_chars"), "status", "enrich_error")


@query
def enrich_due(spark, d):
    book, _, _ = _book(spark, d)
    stamped = book.links.withColumns(
        {
            "enriched_at": F.when(c("key").contains("status"), c("first_seen")),
            "enrich_error": F.when(c("key").endswith("5"), "failed"),
        }
    )
    due = memory.enrich_due(LinkBook(stamped, book.said, book.notes), AS_OF)
    return due.select("key", "enrich_error")


# --- analytics ---------------------------------------------------------------------------


def _events(spark, d, **kw):
    return an.parse_events(bridge.view(spark, d, "site_log").withColumnRenamed("tm", "at"), **kw)


@query
def site_events(spark, d):
    e = _events(spark, d, since=datetime(2024, 1, 5))
    return e.select("event_id", "kind", "malformed", "searches", "misses", "opens", "copied", "w", "lang", "q", "k", "r")


@query
def event_log_lines(spark, d):
    """Events written as log lines, some broken, and read back."""
    v = bridge.view(spark, d, "site_log").withColumnRenamed("tm", "at")
    line = F.to_json(F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"), "c", "a"))
    lines = v.select(F.when(c("event_id") % 50 == 7, F.concat(F.lit("broken "), line)).otherwise(line).alias("value"))
    return an.summarise(an.parse_events(an.parse_lines(lines)))


@query
def visit_summary(spark, d):
    return an.summarise(_events(spark, d))


@query
def miss_rate(spark, d):
    return an.report(_events(spark, d, since=datetime(2024, 1, 16))).select(
        "searches", "misses", "open_count", F.round("miss_rate", 8).alias("miss_rate"), F.round("open_rate", 8).alias("open_rate")
    )


@query
def gap_tally(spark, d):
    return an.tally(_events(spark, d), "miss", "q")


@query
def language_tally(spark, d):
    return an.tally(_events(spark, d, keep_bots=True), "s", "lang")


@query
def most_opened(spark, d):
    return an.most_opened(_events(spark, d), 15).withColumn("avg_rank", F.round("avg_rank", 8))


@query
def search_chains(spark, d):
    return an.search_chains(bridge.view(spark, d, "keystrokes"))


@query
def client_classes(spark, d):
    agent = F.when(c("user_id") % 5 == 0, "").when(c("user_id") % 5 == 1, F.concat(F.lit("Mozilla "), "event_type")).when(
        c("user_id") % 5 == 2, F.concat(F.lit("GoogleBot/"), "event_type")
    ).when(c("user_id") % 5 == 3, "curl/8.1").otherwise("Safari")
    e = bridge.table(spark, d, "events")
    return e.groupBy(an.client_class(agent).alias("class")).agg(F.count("*").alias("n"))


def _pageviews(spark, d):
    e = bridge.table(spark, d, "events")
    return e.select(
        F.concat(c("user_id").cast("string"), F.lit("-"), F.date_format("ts", "dd")).alias("visit"), F.struct("ts", "event_id").alias("ts"),
        (c("event_id") % 7).alias("searches"), (c("event_id") % 3).alias("misses"), (c("event_id") % 2).alias("opens"),
        F.lit(0).cast("bigint").alias("facets"), (c("event_id") % 4 == 0).alias("copied"),
        F.concat(F.lit("https://www.site"), (c("event_id") % 5).cast("string"), F.lit(".com/x?q=1")).alias("referrer"),
        F.lit("site3.com").alias("own_host"), (c("event_id") % 1500).alias("width"), F.lit("en-US-posix").alias("language"),
        F.when(c("event_id") % 6 != 0, c("event_id") % 9 == 0).alias("dnt"), F.lit(False).alias("gpc"), (c("event_id") % 13 == 0).alias("opt_out"),
    )


@query
def visit_records(spark, d):
    return an.visit_records(_pageviews(spark, d))


@query
def opted_in(spark, d):
    rows = an.not_opted_out(_pageviews(spark, d))
    return rows.agg(F.count("*").alias("n"), F.sum("searches").alias("searches"))


# --- views -------------------------------------------------------------------------------


@query
def section_groups(spark, d):
    rows = views.grouped_sections(entries(_library(spark, d)), 3)
    return rows.select("key", "group", "group_size", "group_order")


@query
def list_lines(spark, d):
    rows = views.list_lines(entries(_checked(spark, d)))
    return rows.select("key", "group", "line")


@query
def wall_cards(spark, d):
    lib = _checked(spark, d)
    head = entries(lib)
    keyed = urls.with_resource_key(urls.canonicalise(bridge.table(spark, d, "pages"))).groupBy("key").agg(F.min("page_id").alias("p"))
    curation = keyed.filter(c("p") % 3 != 0).select(
        "key", F.concat(F.lit("cat"), c("p") % 4).alias("cat"), F.when(c("p") % 5 != 0, F.concat(F.lit("标题"), "p")).alias("zh"),
        F.concat(F.lit("line "), "p").alias("en"), F.lit(None).cast("string").alias("name"),
    )
    number = (c("p") % 4).cast("string")
    cats = keyed.select(F.concat(F.lit("cat"), number).alias("cat"), F.concat(F.lit("label"), number).alias("label"), F.lit(0).alias("pos")).distinct()
    shots = keyed.filter(c("p") % 7 != 1).select("key", F.lit(320).alias("w"), F.lit(200).alias("h"))
    cards, missing = views.wall_sites(lib, head, curation, cats, shots)
    n = missing.groupBy(F.regexp_replace("missing", "^shot:", "").alias("key")).agg(F.count("*").alias("missing"))
    return cards.join(n, "key", "left").select("key", "kind", "cat", "title", "by", "w", _joined("tags").alias("tags"), F.coalesce("missing", F.lit(0)).alias("missing"))


def _wall_items(spark, d):
    e = bridge.table(spark, d, "part")
    return e.select(
        F.concat(F.when(c("p_size") > 30, "s").otherwise("v"), c("p_partkey").cast("string")).alias("key"),
        F.when(c("p_size") <= 30, "video").when(c("p_size") % 3 == 0, "repo").otherwise("site").alias("kind"),
        F.timestamp_seconds(F.lit(1_700_000_000) + c("p_partkey") * 60).alias("at"), (c("p_size") % 5).cast("bigint").alias("mentions"),
        c("p_brand").alias("cat"), (c("p_retailprice") > 1900).alias("pick"),
    )


@query
def wall_order(spark, d):
    items = _wall_items(spark, d)
    featured = items.filter("pick").select("key", F.crc32("key").alias("pos"))
    return views.wall_order(items, featured).select("key", "wall_pos")


@query
def wall_videos(spark, d):
    part = bridge.table(spark, d, "part")
    ids = c("p_partkey").cast("string")
    vids = part.select(
        ids.alias("id"), F.concat(F.lit("https://x.com/i/status/"), ids).alias("url"), c("p_brand").alias("cat"), c("p_name").alias("zh"),
        c("p_type").alias("name"), F.lit("maker").alias("author"), F.lit(AS_OF).cast("timestamp").alias("at"),
        c("p_size").cast("bigint").alias("likes"), (c("p_size") % 11 == 0).alias("hide"),
    )
    media = part.select(
        ids.alias("id"),
        F.explode(F.when(c("p_size") % 5 == 0, F.array(F.lit("clip"), F.lit("still"))).otherwise(F.array(F.lit("clip"), F.lit("still"), F.lit("full")))).alias("part"),
        F.lit(640).alias("w"), F.lit(360).alias("h"),
    )
    english = part.filter(c("p_size") % 2 == 0).select(ids.alias("id"), F.concat(F.lit("en "), "p_name").alias("en"))
    cards, missing = views.wall_videos(vids, media, english)
    shown = cards.select("key", "title", "en", F.lit(None).cast("string").alias("missing"))
    lost = missing.select(F.split("missing", ":")[1].alias("key"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("en"), "missing")
    return shown.unionByName(lost)


@query
def category_counts(spark, d):
    items = _wall_items(spark, d)
    cats = items.select("cat").distinct().select("cat", F.crc32("cat").alias("cat_pos"))
    return views.category_counts(items, cats).select("cat", "n")


# --- sources -----------------------------------------------------------------------------


@query
def best_snapshots(spark, d):
    """Two captures of every document as a post: the second is cut or holds fewer short links."""
    docs = bridge.table(spark, d, "documents")
    first = docs.select(
        c("doc_id").cast("string").alias("post_id"), F.lit("fxtwitter").alias("channel"),
        F.when(c("doc_id") % 3 == 0, F.concat("text", F.lit(" https://t.co/a https://t.co/b"))).otherwise(c("text")).alias("text"),
        (c("doc_id") % 5 == 0).alias("truncated"),
    )
    second = docs.select(
        c("doc_id").cast("string").alias("post_id"), F.lit("syndication").alias("channel"),
        F.when(c("doc_id") % 2 == 0, F.concat("text", F.lit(" https://t.co/a and more words"))).otherwise(F.concat(F.lit("S "), "text")).alias("text"),
        (c("doc_id") % 4 == 0).alias("truncated"),
    )
    best = posts.best_snapshot(posts.with_completeness(first.unionByName(second)))
    return best.select("post_id", "channel", c("unexpanded").cast("bigint").alias("unexpanded"), F.length("text").cast("bigint").alias("chars"))


@query
def expanded_links(spark, d):
    p = bridge.view(spark, d, "posts")
    entities = F.array(
        F.struct(F.lit("http://t.co/abc").alias("url"), F.concat(F.lit("https://full.example.com/"), "post_id").alias("expanded_url")),
        F.struct(F.lit("").alias("url"), F.lit("https://never.example.com").alias("expanded_url")),
    )
    return p.select("post_id", F.md5(posts.expand_links(c("text"), entities)).alias("digest"))


@query
def collected_inputs(spark, d):
    """Post numbers and plain links of all sightings given by hand, with what is rejected and why."""
    v = bridge.view(spark, d, "sightings")
    raw = F.when(c("page_id") % 3 == 0, c("url")).when(c("page_id") % 3 == 1, (c("page_id") + 1_000_000_000).cast("string")).otherwise(F.concat(F.lit("no link "), "url"))
    inputs = v.select(c("sighting_id").alias("input_id"), raw.alias("raw"))
    p = bridge.view(spark, d, "posts").select(
        (c("post_id").cast("bigint") + 1_000_000_000).cast("string").alias("post_id"), "text", "author", F.lit("fxtwitter").alias("channel"),
        F.lit("2024-01-01").alias("created_at"), F.concat(F.lit("https://x.com/i/status/"), "post_id").alias("url"),
        *[F.lit(None).cast("bigint").alias(x) for x in ("likes", "retweets", "views")],
    )
    found, leads, failed = posts.collect_inputs(inputs, p, AS_OF)
    counts = found.groupBy(c("source.type").alias("what")).agg(F.count("*").alias("n"))
    return counts.unionByName(failed.groupBy(c("why").alias("what")).agg(F.count("*").alias("n"))).unionByName(
        leads.select(F.lit("leads").alias("what"), F.size("leads").alias("k")).groupBy("what").agg(F.sum("k").alias("n"))
    )


def _log_lines(rows: DataFrame, line) -> DataFrame:
    return rows.select(c("session").alias("file"), F.struct(F.lit(0).cast("bigint").alias("block"), c("n").alias("n")).alias("pos"), line.alias("value"))


@query
def agent_log_1(spark, d):
    """Conversations written as session logs of the first kind and read back."""
    conv = bridge.table(spark, d, "conversations").select(c("conv_id").cast("string").alias("session"), c("turn").alias("n"), "role", "text")
    body = F.to_json(
        F.struct(
            c("role").alias("type"), c("session").alias("sessionId"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("/p").alias("cwd"),
            (c("n") % 10 == 8).alias("isMeta"), F.struct("role", c("text").alias("content")).alias("message"),
        )
    )
    queued = F.to_json(
        F.struct(
            F.lit("attachment").alias("type"), c("session").alias("sessionId"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("/p").alias("cwd"),
            F.struct(
                F.lit("queued_command").alias("type"),
                F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("queued: "), "text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("i").alias("text"))).alias("prompt"),
                F.lit("prompt").alias("commandMode"), F.struct(F.when(c("n") % 4 == 1, "peer").otherwise("human").alias("kind")).alias("origin"),
            ).alias("attachment"),
        )
    )
    lines = _log_lines(conv, body).unionByName(_log_lines(conv.withColumn("n", c("n") + 100_000).filter("role = 'assistant'"), queued))
    return agent_logs.messages_1(lines).select("session", "queued", "cwd", F.md5("text").alias("digest"))


@query
def agent_log_2(spark, d):
    """Conversations written as session logs of the second kind, a third of them not interactive."""
    conv = bridge.table(spark, d, "conversations").select(c("conv_id").cast("string").alias("session"), c("turn").alias("n"), "role", "text", "conv_id")
    head = conv.select("session", "conv_id").distinct().withColumn("n", F.lit(-1).cast("bigint"))
    origin = F.when(c("conv_id") % 3 == 0, "exec").when(c("conv_id") % 3 == 1, "codex-tui").otherwise("Codex Desktop")
    header = F.to_json(F.struct(F.struct(c("session").alias("id"), F.lit("/q").alias("cwd"), origin.alias("originator")).alias("payload")))
    body = F.to_json(
        F.struct(
            F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            F.struct(
                F.lit("message").alias("type"), "role",
                F.array(F.struct(c("text").alias("text")), F.struct(F.lit("<environment_context> x").alias("text"))).alias("content"),
            ).alias("payload"),
        )
    )
    lines = _log_lines(head, header).unionByName(_log_lines(conv, body))
    return agent_logs.messages_2(lines).select("session", "cwd", F.md5("text").alias("digest"))


@query
def document_round_trip(spark, d):
    """Library to nested documents and back: facts per kind stay the same."""
    docs, large = to_documents(_library(spark, d))
    return from_documents(docs).facts.unionByName(large).groupBy("key", "kind").agg(F.count("*").alias("n")).filter("kind <> 'flag' AND kind <> 'url'")


# --- files -------------------------------------------------------------------------------


@query
def library_files(spark, d):
    """The library written as JSON lines and read back where the first place asked is missing."""
    lib = _library(spark, d)
    docs, large = to_documents(lib)
    path = _scratch(spark, "index")
    library_io.write_documents(docs, path)
    back = library_io.read_library(spark, path + "-missing", path)
    whole = Library(back.facts.unionByName(large), back.state)
    return entries(whole).select("key", "url", "mentions", _iso("first_seen").alias("first_seen"), _iso("last_seen").alias("last_seen"))


@query
def event_log_files(spark, d):
    """The event log as plain and as compressed files, read as one input; broken lines are counted."""
    v = bridge.view(spark, d, "site_log")
    line = F.when(c("event_id") % 50 == 7, "{broken").otherwise(F.to_json(F.struct(F.date_format("tm", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), "c", "a")))
    path = _scratch(spark, "log")
    for name, rows, how in (("plain", c("event_id") % 3 == 0, "none"), ("old", c("event_id") % 3 != 0, "gzip")):
        v.filter(rows).select(line.alias("value")).write.option("compression", how).text(f"{path}/{name}")
    rows = events.read_event_log(spark, f"{path}/*")
    return rows.groupBy("bad", "c", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("a").alias("kinds"))


@query
def backfill(spark, d):
    """All messages into a new link book and vocabulary, in numbers."""
    book, vocab, total = pipelines.backfill(cut_lineage(bridge.messages(spark, d)))
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(book.links, "links").unionByName(n(book.said, "said")).unionByName(n(vocab, "terms")).unionByName(
        total.select(F.lit("messages").alias("what"), c("total").alias("n"))
    )


# --- streaming ---------------------------------------------------------------------------


def _finish(query_) -> None:
    query_.awaitTermination()  # raises what the stream failed with


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query
def stream_miss_rate(spark, d):
    """The event log as a stream: one final row per hour. A later row moves the watermark past the last hour."""
    from ..streaming.analytics import hourly_rates

    rows = bridge.view(spark, d, "site_log").select(c("tm").cast("timestamp").alias("at"), "c", "a")
    folder, out = _scratch(spark, "events"), _scratch(spark, "rates")
    end = rows.agg((F.max("at") + F.expr("INTERVAL 2 DAYS")).alias("at")).select("at", F.lit("browser").alias("c"), F.lit("e=s").alias("a"))
    for part in (rows, end.filter("at IS NOT NULL")):
        part.write.mode("append").parquet(folder)
        hours = hourly_rates(spark.readStream.schema(rows.schema).parquet(folder))
        _finish(hours.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start())
    return spark.read.parquet(out).select(_iso("window_start").alias("window_start"), "visits", "searches", "misses", "gaps", F.round("miss_rate", 8).alias("miss_rate"))


@query
def stream_distinct_messages(spark, d):
    """Messages as a stream, repeats of a text within a session dropped."""
    from ..streaming.capture import distinct_messages

    stream = bridge.stream(spark, d, "conversations").filter("role = 'user'").select(
        c("conv_id").cast("string").alias("session"), "text", F.timestamp_seconds(F.lit(1_700_000_000) + c("conv_id") * 3600 + c("turn")).alias("at")
    )
    out = _scratch(spark, "distinct")
    _finish(distinct_messages(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out).groupBy("session").agg(F.count("*").alias("n"))


@query
def stream_search_chains(spark, d):
    """Keystrokes as a stream, a record per visit; a later row moves the watermark past the last visit."""
    from ..streaming.analytics import visit_chains

    keys = bridge.view(spark, d, "keystrokes").filter("ts IS NOT NULL")
    keys = keys.select("visit", c("ts").cast("timestamp").alias("ts"), "event_id", "q", "results")
    folder, out = _scratch(spark, "keys"), _scratch(spark, "chains")
    end = keys.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(
        F.lit("(end)").alias("visit"), "ts", F.lit(-1).cast("bigint").alias("event_id"), F.lit("").alias("q"), F.lit(0).cast("bigint").alias("results")
    )
    for rows in (keys, end.filter("ts IS NOT NULL")):
        rows.write.mode("append").parquet(folder)
        stream = visit_chains(spark.readStream.schema(keys.schema).parquet(folder))
        _finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start())
    return spark.read.schema("visit string, searches bigint, misses bigint").parquet(out).filter("visit <> '(end)'")


@query
def stream_recall(spark, d):
    """Prompts as a stream in two landings: rare-word recall, a link once per session over both.

    The book's words land before them in two parts, with a compaction in between.
    """
    from ..streaming.capture import prompt_candidates, recalled

    book, msgs, _ = _book(spark, d)
    vocab, total = _vocab(msgs)
    folder, found, out = (_scratch(spark, x) for x in ("prompts", "candidates", "recalled"))
    words = _landed_words(spark, book, _scratch(spark, "words"))
    for rows in (msgs.filter(c("at") < F.lit(MOMENT)), msgs.filter(c("at") >= F.lit(MOMENT))):
        rows.write.mode("append").parquet(folder)
        prompts = spark.readStream.schema(msgs.schema).parquet(folder)
        _finish(prompt_candidates(prompts, book, words, vocab, total, found, found + "-cp").trigger(availableNow=True).start())
        shown = recalled(spark, found).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp")
        _finish(shown.trigger(availableNow=True).start())
    return spark.read.parquet(out).select("msg_id", "session", "rank", "key")


def _landed_words(spark, book, path):
    """The word table of a book whose remarks land in two parts, later ones first."""
    from ..operators.memory import LinkBook
    from ..streaming.word_table import WordTable

    words = WordTable(spark, path)
    early = c("at") < F.lit(MOMENT)
    words.land(LinkBook(book.links.filter(F.xxhash64("key") % 2 == 0), book.said.filter(~early), book.notes), 0)
    words.compact()
    words.land(LinkBook(book.links.filter(F.xxhash64("key") % 2 != 0), book.said.filter(early), book.notes.limit(0)), 1)
    return words


@query
def word_table(spark, d):
    """For each rare word of the book the first links that hold it, from the table kept by landings."""
    book, _, _ = _book(spark, d)
    rows = _landed_words(spark, book, _scratch(spark, "words")).rare_terms()
    return rows.select("term", "key", _iso(F.least("own_at", "body_at")).alias("since"), _iso("common_from").alias("common_from"))


@query
def stream_stale(spark, d):
    """Fetches as a stream in two landings: each time a resource had gone a week without one. A later row ends the stream."""
    from ..streaming.keyed import stale_resources

    fetches = bridge.fetches(spark, d).select("key", c("checked_at").cast("timestamp").alias("checked_at"))
    folder, out = _scratch(spark, "fetched"), _scratch(spark, "stale")
    end = fetches.agg((F.max("checked_at") + F.expr("INTERVAL 30 DAYS")).alias("checked_at")).select(F.lit("(end)").alias("key"), "checked_at")
    half = F.lit(MOMENT).cast("timestamp") + F.expr("INTERVAL 15 DAYS")
    for rows in (fetches.filter(c("checked_at") < half), fetches.filter(c("checked_at") >= half), end.filter("checked_at IS NOT NULL")):
        rows.write.mode("append").parquet(folder)
        stale = stale_resources(spark.readStream.schema(fetches.schema).parquet(folder))
        _finish(stale.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start())
    return spark.read.parquet(out).filter("key <> '(end)'").select("key", _iso("checked_at").alias("checked_at"), _iso("due_at").alias("due_at"))


@query
def stream_growing_log(spark, d):
    """Logs of messages that are written to while a stream follows them: half lines, completed lines, files cut short."""
    from ..sources.growing_log import growing_lines

    rows = bridge.table(spark, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    line = F.concat(F.lit("{\"turn\":"), c("turn").cast("string"), F.lit(",\"text\":\""), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\"}"))
    rows = rows.select(F.floor(c("conv_id") / 20).cast("int").alias("log"), "conv_id", "turn", line.alias("line"))
    logs, out = _scratch(spark, "logs"), _scratch(spark, "followed")
    # first and second turns; the second turn's lines stop halfway at first, and a third of the files is written anew in the end
    first, second, rest = rows.filter("turn = 0"), rows.filter("turn = 1"), rows.filter("turn > 1")
    last = second.groupBy("log").agg(F.max("conv_id").alias("conv_id"))
    cut = second.join(last, ["log", "conv_id"], "left_semi")
    whole = second.join(last, ["log", "conv_id"], "left_anti")
    begun = cut.withColumn("line", F.substring("line", 1, 20))
    ended = cut.withColumn("line", F.substring("line", 21, 1 << 20))
    steps = [
        [(first, "a", "\n"), (whole, "a", "\n"), (begun, "a", "")],
        [(ended, "a", "\n"), (rest.filter("log % 3 <> 0"), "a", "\n")],
        [(first.filter("log % 3 = 0 AND conv_id % 20 = 1"), "w", "\n")],
    ]
    for step in steps:
        for part, mode, after in step:
            _write_logs(part, logs, mode, after)
        query_ = growing_lines(spark, logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").start()
        try:
            query_.processAllAvailable()
        finally:
            query_.stop()
    read = spark.read.parquet(out)
    return read.select(F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("int").alias("log"), "pos", "value")


def _write_logs(rows: DataFrame, folder: str, mode: str, after: str) -> None:
    """Append lines to the log files of a folder, or write these anew; a file is written by one task."""
    import os
    from urllib.parse import urlparse

    local = urlparse(folder).path

    def write(batches):
        os.makedirs(local, exist_ok=True)
        opened = set()
        for batch in batches:
            for log, line in zip(batch.column("log").to_pylist(), batch.column("line").to_pylist(), strict=True):
                with open(f"{local}/{log}.jsonl", mode if log not in opened else "a", encoding="utf-8") as f:
                    f.write(line + after)
                opened.add(log)
        return iter(())

    rows.repartition("log").sortWithinPartitions("log", "turn", "conv_id").select("log", "line").mapInArrow(write, "n int").count()
