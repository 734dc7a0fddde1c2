"""What may be published, and in what shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .library import Library, entries, fold_facts, mention_id, source_id
from .skew import is_true, salted_join


def held_reason(allow_risk: bool = False) -> Column:
    """Null when the row of ``entries`` may be published, else the first rule that holds it back."""
    has = lambda f: F.array_contains("flags", f)
    risk = F.lit(False) if allow_risk else has("legal_risk")
    return (
        F.when(has("private"), "private")
        .when(risk, "legal_risk")
        .when(has("demoted") & ~F.col("vouched"), "demoted-without-public-source")
        .when(is_true(F.col("liveness.status") == "dead"), "dead")
    )


def publish_gate(head: DataFrame, allow_risk: bool = False) -> DataFrame:
    return head.withColumn("why", held_reason(allow_risk))


def exportable(head: DataFrame, allow_risk: bool = False) -> tuple[DataFrame, DataFrame]:
    """Published rows (most corroborated first) and held rows with their reason."""
    gated = publish_gate(head, allow_risk)
    published = gated.filter("why IS NULL").drop("why").orderBy(F.desc("mentions"), "key")
    return published, gated.filter("why IS NOT NULL").select("key", "why")


def held_counts(head: DataFrame, allow_risk: bool = False) -> DataFrame:
    return exportable(head, allow_risk)[1].groupBy("why").agg(F.count("*").alias("n"))


def sanitise_source(s: Column) -> Column:
    """Posts ship whole; a bookmark keeps only its month; others lose who, where and which title."""
    month = F.when(s["at"] != "", F.left(s["at"], F.lit(7)))
    hidden = s.withField("at", month)
    for name in ("by", "path", "folder", "title"):
        hidden = hidden.withField(name, F.lit(None).cast("string"))
    bookmark = hidden.withField("type", F.lit("bookmark"))
    for name in ("post", "post_id", "author", "context", "channel"):
        bookmark = bookmark.withField(name, F.lit(None).cast("string"))
    bookmark = bookmark.withField("resolved_by_hand", F.lit(None).cast("boolean")).withField(
        "engagement", F.lit(None).cast("struct<likes:bigint,retweets:bigint,views:bigint>")
    )
    return F.when(s["type"] == "x", s).when(s["type"] == "chrome", bookmark).otherwise(hidden)


def published_library(library: Library, allow_risk: bool = False) -> Library:
    """The library as it ships: published keys only, local folders gone, sources sanitised."""
    keys = exportable(entries(library), allow_risk)[0].select("key")
    facts = salted_join(library.facts.filter("kind <> 'local_section'"), keys, ["key"], "left_semi", spread=["key", "kind", "value"])
    is_source = F.col("kind") == "source"
    clean = facts.withColumn("source", F.when(is_source, sanitise_source(F.col("source"))))
    # The fact keeps its identity but not the folder name inside it.
    clean = clean.withColumn(
        "value",
        F.when(is_source & (F.col("source.type") == "bookmark"), F.sha2("value", 256)).otherwise(F.col("value")),
    )
    return Library(clean, library.state.join(keys, "key", "left_semi"))


def corroboration(facts: DataFrame) -> DataFrame:
    """Independent sources per resource; distinct pairs are formed before the count per key."""
    return (
        facts.filter("kind = 'source'")
        .groupBy("key")
        .agg(F.count_distinct(mention_id(F.col("source"))).alias("mentions"))
    )


def library_stats(library: Library, head: DataFrame | None = None) -> DataFrame:
    """``metric, label, n``: entries, liveness, flags, source types, corroborated resources."""
    head = entries(library) if head is None else head
    flags = F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("clean")))
    labelled = F.array(
        F.struct(F.lit("entries").alias("metric"), F.lit("all").alias("label")),
        F.struct(F.lit("liveness").alias("metric"), F.coalesce("liveness.status", F.lit("unchecked")).alias("label")),
        F.when(F.col("mentions") > 1, F.struct(F.lit("corroborated").alias("metric"), F.lit("all").alias("label"))),
    )
    flag_rows = F.transform(flags, lambda f: F.struct(F.lit("flags").alias("metric"), f.alias("label")))
    per_entry = head.select(F.explode(F.array_compact(F.concat(labelled, flag_rows))).alias("m")).select("m.metric", "m.label")
    per_source = library.facts.filter("kind = 'source'").select(
        F.lit("sources").alias("metric"), F.col("source.type").alias("label")
    )
    return per_entry.unionByName(per_source).groupBy("metric", "label").agg(F.count("*").alias("n"))


def flagged(head: DataFrame, flag: str | None = None) -> DataFrame:
    rows = head if not flag else head.filter(F.array_contains("flags", flag))
    return rows.orderBy(F.desc("mentions"), "key")


__all__ = [
    "held_reason", "publish_gate", "exportable", "held_counts", "sanitise_source", "published_library",
    "corroboration", "library_stats", "flagged", "fold_facts", "source_id",
]
