"""The library as facts: one row per (resource, kind, value), folded by mergeable aggregates.

A library is two tables. ``facts`` holds every distinct thing known about a resource (addresses,
names, sections, tags, flags, claims, sources, aliases) with the position at which it was first
seen. ``state`` holds the latest verified page facts per resource. Folding a batch, merging two
libraries and following renames are all the same aggregation by (key, kind, value), which
combines on the map side; nothing ever gathers all sightings of a resource in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk, urls
from ..functions.privacy import with_privacy
from ..session import cut_lineage
from ..sources import schemas
from .screening import with_blocklist
from .skew import is_true

LIST_KINDS = {
    "names": "name", "sections": "section", "local_sections": "local_section",
    "tags": "tag", "flags": "flag", "aliases": "alias",
}


@dataclass
class Library:
    facts: DataFrame
    state: DataFrame

    def kept(self) -> "Library":
        """Both tables written down, so that the readers below do not fold the sightings again."""
        return Library(cut_lineage(self.facts), cut_lineage(self.state))

    @staticmethod
    def empty(spark: SparkSession) -> "Library":
        return Library(
            spark.createDataFrame([], schemas.FACTS), spark.createDataFrame([], schemas.STATE)
        )


def mention_id(source: Column) -> Column:
    """What counts as one independent source of a mention."""
    some = lambda *cs: F.coalesce(*[urls.blank_to_null(x) for x in cs], F.lit(""))
    return (
        F.when(source["type"] == "x", F.concat(F.lit("x:"), some(source["author"], source["post_id"])))
        .when(
            source["type"] == "chrome",
            F.concat(F.lit("chrome:"), F.coalesce(urls.blank_to_null(source["folder"]), F.lit("default"))),
        )
        .when(source.isNotNull(), F.concat(source["type"], F.lit(":"), some(source["by"], source["at"])))
    )


def source_id(source: Column) -> Column:
    place = F.coalesce(urls.blank_to_null(source["post_id"]), urls.blank_to_null(source["folder"]), F.lit(""))
    return F.to_json(F.array(source["type"], place, F.coalesce(source["author"], F.lit(""))))


def place_sightings(sightings: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Canonical address, screen verdict and resource key of each sighting (narrow, no shuffle).

    A private address is replaced by its public ancestor and flagged ``demoted``; without an
    ancestor the sighting keeps its address and is flagged ``private``.
    """
    c = F.col
    placed = urls.canonicalise(sightings)
    if blocklist is not None:
        placed = with_blocklist(placed, blocklist)
    placed = with_privacy(placed, blocked="blocked" if blocklist is not None else None)
    up = c("public_ancestor").isNotNull()
    placed = placed.withColumns(
        {
            "flag": F.when(c("is_private"), F.when(up, "demoted").otherwise("private")),
            "u_path": F.when(up, F.expr("substring(public_ancestor, length(u_origin) + 1)")).otherwise(c("u_path")),
            "u_query": F.when(up, "").otherwise(c("u_query")),
            "u_hash": F.when(up, "").otherwise(c("u_hash")),
            "u_url": F.coalesce("public_ancestor", "u_url"),
        }
    )
    placed = urls.with_resource_key(placed)
    placed = placed.withColumn("rank", urls.url_rank())
    return placed.select(*[x for x in sightings.columns if x != "url"], c("u_url").alias("url"), "key", "rank", "flag")


def sighting_facts(placed: DataFrame) -> DataFrame:
    """One pass over the sightings: each becomes its handful of facts."""
    c = F.col
    none = F.lit(None)

    def fact(kind, value, keep, idx=0, origin=none, source=none, rank=none):
        return F.when(
            keep & value.isNotNull() & (value != ""),
            F.struct(
                F.lit(kind).alias("kind"), value.alias("value"), origin.cast("string").alias("from"),
                source.cast(schemas.SOURCE).alias("source"), rank.cast(schemas.RANK).alias("rank"),
                (idx if isinstance(idx, Column) else F.lit(idx)).alias("idx"),
            ),
        )

    yes = F.lit(True)
    local = is_true(c("source.type") == "chrome")
    origin = F.coalesce(
        urls.blank_to_null(c("source.post")), urls.blank_to_null(c("source.folder")),
        urls.blank_to_null(c("source.type")), F.lit("unknown"),
    )
    single = F.array(
        fact("url", c("url"), yes, rank=c("rank")),
        fact("name", c("name"), yes),
        fact("section", c("section"), ~local),
        fact("local_section", c("section"), local),
        fact("flag", c("flag"), yes),
        fact("claim", c("note"), yes, origin=origin),
        fact("source", source_id(c("source")), c("source").isNotNull(), source=c("source")),
    )
    tags = F.transform(F.coalesce(c("tags"), F.array().cast("array<string>")), lambda t, i: fact("tag", t, yes, idx=i))
    rows = placed.select(
        "key", "seen_at", "sighting_id", F.explode(F.array_compact(F.concat(single, tags))).alias("f")
    )
    return rows.select(
        "key", "f.kind", "f.value", "f.from", "f.source", "f.rank",
        F.struct(
            F.lit(0).alias("grp"), c("seen_at").alias("at"), c("sighting_id").alias("id"), c("f.idx").alias("idx")
        ).alias("pos"),
        c("seen_at").alias("last_at"),
    )


def fold_facts(facts: DataFrame) -> DataFrame:
    """Keep the first occurrence of each (key, kind, value); mergeable, so batches can be unioned."""
    first = F.min_by(F.struct("from", "source", "rank"), "pos").alias("first")
    folded = facts.groupBy("key", "kind", "value").agg(
        first, F.min("pos").alias("pos"), F.max("last_at").alias("last_at")
    )
    return folded.select("key", "kind", "value", "first.from", "first.source", "first.rank", "pos", "last_at")


def upsert(library: Library | None, sightings: DataFrame, blocklist: DataFrame | None = None) -> Library:
    """Fold sightings into a library. Two batches one after the other equal one combined batch."""
    new = sighting_facts(place_sightings(sightings, blocklist))
    if library is None:
        return Library(fold_facts(new), sightings.sparkSession.createDataFrame([], schemas.STATE))
    return Library(fold_facts(library.facts.unionByName(new)), library.state)


def upsert_report(library: Library, sightings: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Keys touched by a batch and whether each was created or merged."""
    touched = place_sightings(sightings, blocklist).groupBy("key").agg(F.count("*").alias("sightings"))
    known = library.facts.select("key").distinct().withColumn("known", F.lit(True))
    return touched.join(known, "key", "left").select("key", "sightings", F.col("known").isNull().alias("created"))


def _address_flags(facts: DataFrame) -> DataFrame:
    """Risk flags of every address that was the best one of its resource at some time.

    An address leads when it is the first of its rank and every better rank came later. Addresses
    are first reduced to one per (key, rank); ranks are few, so the window per key stays small.
    """
    c = F.col
    per_rank = (
        facts.filter("kind = 'url'")
        .groupBy("key", "rank")
        .agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("url"))
    )
    better = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    led = per_rank.withColumn("best_before", F.min("pos").over(better)).filter(
        c("best_before").isNull() | (c("pos") < c("best_before"))
    )
    return (
        led.select("key", F.explode(risk.url_flags(c("url"))).alias("flag"))
        .groupBy("key")
        .agg(F.collect_set("flag").alias("address_flags"))
    )


def entries(library: Library) -> DataFrame:
    """One row per resource: best address, first labels, corroboration, flags, verified state."""
    c = F.col
    kind = lambda *k: c("kind").isin(*k)
    first = lambda k, name: F.min_by(
        F.when(kind(k), c("value")), F.when(kind(k), c("pos"))
    ).alias(name)
    text = F.when(kind("name", "claim", "section", "local_section"), c("value")).when(kind("source"), c("source.context"))
    framing = F.when(kind("claim", "section"), c("value")).when(kind("source"), c("source.context"))
    lead = F.when(kind("url"), F.struct("rank", "pos"))
    head = library.facts.groupBy("key").agg(
        F.min_by("value", lead).alias("url"),
        F.min("pos.at").alias("first_seen"),
        F.max("last_at").alias("last_seen"),
        F.count_distinct(F.when(kind("source"), mention_id(c("source")))).alias("mentions"),
        F.collect_set(F.when(kind("flag"), c("value"))).alias("stored_flags"),
        F.max(risk.has_risk_words(text)).alias("risky_words"),
        F.max(kind("section", "local_section") & risk.is_media_section(c("value"))).alias("media_section"),
        F.max(risk.has_free_framing(framing)).alias("free_framing"),
        is_true(F.max(kind("source") & (c("source.type") != "chrome"))).alias("vouched"),
        first("name", "first_name"), first("section", "first_section"),
        first("local_section", "first_local_section"), first("tag", "first_tag"), first("claim", "first_claim"),
    )
    head = head.join(_address_flags(library.facts), "key", "left").join(library.state, "key", "left")
    return _with_flags(head)


def _with_flags(head: DataFrame) -> DataFrame:
    c = F.col
    none = F.array().cast("array<string>")
    risky = (
        c("risky_words") | (c("media_section") & c("free_framing"))
        | risk.has_risk_words(c("key")) | risk.has_risk_words(c("title")) | risk.has_risk_words(c("description"))
    )
    shadow = F.when(
        risk.names_shadow_library(c("key")), F.array(F.lit("legal_risk"), F.lit("shadow_library"))
    ).otherwise(none)
    flags = F.array_union(
        F.array_union(c("stored_flags"), F.coalesce(c("address_flags"), none)),
        F.array_union(shadow, F.when(risky, F.array(F.lit("legal_risk"))).otherwise(none)),
    )
    return head.withColumn("flags", F.array_sort(flags)).drop(
        "stored_flags", "address_flags", "risky_words", "media_section", "free_framing"
    )


def apply_fetches(library: Library, verdicts: DataFrame) -> Library:
    """Bring the latest fetch per key into ``state``; topics become tags.

    ``verdicts`` comes from ``liveness.verdicts`` (columns of ``STATE`` plus ``og_title``). Sighting
    and verification stay apart: only keys already in the library are touched.
    """
    c = F.col
    known = library.facts.select("key").distinct()
    # of fetches at one time the order of status, code and final address decides
    newest = F.struct("checked_at", "status", "code", "final_url")
    latest = verdicts.join(known, "key", "left_semi").groupBy("key").agg(
        F.max_by(F.struct(*[c(x) for x in verdicts.columns if x != "key"]), newest).alias("v")
    )
    latest = cut_lineage(latest)  # read three times below; pages are parsed once
    old = library.state.select("key", F.struct(*[c(x) for x in library.state.columns if x != "key"]).alias("s"))
    both = old.join(latest, "key", "full")
    named = c("v.page_title").isNotNull() & (c("v.status") != "dead")
    keep = lambda new, old_name: F.coalesce(urls.blank_to_null(new), c("s." + old_name)).alias(old_name)
    state = both.select(
        "key",
        F.when(named, F.coalesce("v.og_title", "v.page_title")).otherwise(c("s.title")).alias("title"),
        keep(c("v.description"), "description"),
        keep(c("v.site_name"), "site_name"),
        keep(c("v.lang"), "lang"),
        keep(c("v.image"), "image"),
        F.when(
            c("v").isNotNull(),
            F.struct(
                c("v.status").alias("status"), c("v.code").cast("int").alias("code"), c("v.note").alias("note"),
                c("v.checked_at").alias("checked_at"), c("v.final_url").alias("final_url"), c("v.ms").alias("ms"),
            ),
        ).otherwise(c("s.liveness")).cast(schemas.LIVENESS).alias("liveness"),
        F.coalesce(c("v.github"), c("s.github")).cast(schemas.GITHUB).alias("github"),
        F.coalesce(c("v.checked_at"), c("s.updated_at")).alias("updated_at"),
    )
    topics = latest.select("key", "v.checked_at", F.posexplode("v.github.topics").alias("idx", "value"))
    tag_facts = topics.select(
        "key", F.lit("tag").alias("kind"), "value", F.lit(None).cast("string").alias("from"),
        F.lit(None).cast(schemas.SOURCE).alias("source"), F.lit(None).cast(schemas.RANK).alias("rank"),
        F.struct(
            F.lit(0).alias("grp"), c("checked_at").alias("at"), F.lit(0).cast("bigint").alias("id"), c("idx").alias("idx")
        ).alias("pos"),
        F.lit(None).cast("timestamp").alias("last_at"),
    )
    # A risky title stays on record even when a later fetch replaces it.
    risky = risk.has_risk_words(c("v.page_title")) | risk.has_risk_words(c("v.og_title")) | risk.has_risk_words(c("v.description"))
    flags = latest.filter(risky).select("key", F.lit("legal_risk").alias("value"))
    added = tag_facts.unionByName(flag_facts(flags))
    return Library(fold_facts(library.facts.unionByName(added)), state)


def flag_facts(flags: DataFrame) -> DataFrame:
    """``key, value`` rows as facts of kind ``flag``."""
    return flags.select(
        "key", F.lit("flag").alias("kind"), "value", F.lit(None).cast("string").alias("from"),
        F.lit(None).cast(schemas.SOURCE).alias("source"), F.lit(None).cast(schemas.RANK).alias("rank"),
        F.struct(
            F.lit(1).alias("grp"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("bigint").alias("id"),
            F.lit(0).alias("idx"),
        ).alias("pos"),
        F.lit(None).cast("timestamp").alias("last_at"),
    )


# --- nested documents --------------------------------------------------------------------


def from_documents(documents: DataFrame) -> Library:
    """Nested records (one per resource) to facts and state."""
    c = F.col
    none = F.lit(None)

    def row(kind, value, origin=none, source=none, rank=none):
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), origin.cast("string").alias("from"),
            source.cast(schemas.SOURCE).alias("source"), rank.cast(schemas.RANK).alias("rank"),
        )

    def rows(kind):
        return lambda value: row(kind, value)

    parts = urls.canonicalise(documents).withColumn("rank", urls.url_rank())
    lists = [
        F.transform(F.coalesce(c(col), F.array().cast("array<string>")), rows(kind))
        for col, kind in LIST_KINDS.items()
    ]
    claims = F.transform(c("claims"), lambda x: row("claim", x["text"], origin=x["from"]))
    sources = F.transform(c("sources"), lambda s: row("source", source_id(s), source=s))
    all_rows = F.concat(
        F.array(row("url", c("u_url"), rank=c("rank"))), *lists,
        *[F.coalesce(x, F.slice(F.array(row("url", c("u_url"))), 1, 0)) for x in (claims, sources)],
    )
    facts = parts.select("key", "first_seen", "last_seen", F.posexplode(all_rows).alias("idx", "f")).select(
        "key", "f.kind", "f.value", "f.from", "f.source", "f.rank",
        F.struct(
            F.lit(0).alias("grp"), c("first_seen").alias("at"), F.lit(-1).cast("bigint").alias("id"), c("idx").alias("idx")
        ).alias("pos"),
        c("last_seen").alias("last_at"),
    )
    state = documents.select(
        "key", "title", "description", "site_name", "lang", "image", "liveness", "github", "updated_at"
    ).filter("title IS NOT NULL OR description IS NOT NULL OR liveness IS NOT NULL OR github IS NOT NULL")
    return Library(fold_facts(facts.filter("value <> ''")), state)


def to_documents(library: Library, max_facts: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Nested records for export, and the facts of resources too large for one record.

    A record is built only when its resource has at most ``max_facts`` facts. Larger ones come
    back whole in the second table as fact rows, so nothing is cut and no task gathers them.
    """
    c = F.col
    sizes = library.facts.groupBy("key").agg(F.count("*").alias("n"))
    small = library.facts.join(sizes.filter(c("n") <= max_facts), "key", "left_semi")
    large = library.facts.join(sizes.filter(c("n") > max_facts), "key", "left_semi")
    values = lambda k: F.transform(
        F.array_sort(F.collect_list(F.when(c("kind") == k, F.struct("pos", "value")))), lambda x: x["value"]
    )
    nested = small.groupBy("key").agg(
        *[values(kind).alias(name) for name, kind in LIST_KINDS.items() if name != "flags"],
        F.transform(
            F.array_sort(F.collect_list(F.when(c("kind") == "claim", F.struct("pos", "value", "from")))),
            lambda x: F.struct(x["value"].alias("text"), x["from"].alias("from")),
        ).alias("claims"),
        F.transform(
            F.array_sort(F.collect_list(F.when(c("kind") == "source", F.struct("pos", "value", "source")))),
            lambda x: x["source"],
        ).alias("sources"),
    )
    head = entries(library)
    wanted = [f.name for f in schemas.struct(schemas.DOCUMENT)]
    return nested.join(head, "key").select(*wanted), large
