"""Post snapshots from two capture channels, and inputs given by hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.text import utf16_length
from ..operators.extract import UNEXPANDED, leads_in, links_in, post_sightings
from . import schemas

# The order in which the two channels are asked.
CHANNELS = ["fxtwitter", "syndication"]


def expand_links(text: Column, entities: Column) -> Column:
    """Swap shortened links in a text for their targets (``array<struct<url,expanded_url>>``)."""
    usable = F.filter(entities, lambda e: (e["url"] != "") & (e["expanded_url"] != ""))
    swapped = F.aggregate(usable, text, lambda t, e: F.replace(t, e["url"], e["expanded_url"]))
    return F.coalesce(swapped, text)


def with_completeness(snapshots: DataFrame) -> DataFrame:
    """Count links still shortened in each snapshot (row-local)."""
    found = F.regexp_extract_all("text", F.lit(rules.ANY_LINK), F.lit(0))
    short = F.filter(found, lambda u: F.regexp_replace(u, "(?i)^http://", "https://").rlike(UNEXPANDED))
    return snapshots.withColumn("unexpanded", F.coalesce(F.size(short), F.lit(0)))


def best_snapshot(snapshots: DataFrame) -> DataFrame:
    """One row per post: the first complete channel, else the one with fewer short links or more text.

    Channels are asked in the order of ``CHANNELS``, then any others by name. Of several snapshots of a
    channel the order of their values decides. A post has as many snapshots as it was captured.
    """
    c = F.col
    columns = [x for x in snapshots.columns if x != "post_id"]
    turn = F.coalesce(*[F.when(c("channel") == x, i) for i, x in enumerate(CHANNELS)], F.lit(len(CHANNELS)))
    row = F.struct(turn.alias("_turn"), "channel", *[x for x in columns if x != "channel"])
    held = snapshots.groupBy("post_id").agg(F.array_sort(F.collect_list(row)).alias("held"))
    complete = lambda s: (s["unexpanded"] == 0) & ~F.coalesce(s["truncated"], F.lit(False))
    better = lambda a, b: (b["unexpanded"] < a["unexpanded"]) | (utf16_length(b["text"]) > utf16_length(a["text"]))
    pick = F.aggregate(
        F.slice("held", F.lit(2), F.size("held")), c("held")[0],
        lambda a, b: F.when(complete(a), a).when(complete(b) | better(a, b), b).otherwise(a),
    )
    return held.select("post_id", pick.alias("p")).select("post_id", *[c("p")[x].alias(x) for x in columns])


def collect_inputs(inputs: DataFrame, posts: DataFrame, as_of: datetime, credit: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sightings, leads and rejects of a batch of (input_id, raw) post addresses and plain links.

    ``credit(raw, post_id)`` names the post a hand-resolved link was recommended in; that post is
    then its source, marked ``resolved_by_hand``.
    """
    c = F.col
    rows = inputs.withColumn("post_id", urls.post_id(c("raw")))
    asked = rows.filter("post_id IS NOT NULL").select("input_id", "raw", "post_id")
    dated = posts.withColumn("seen_at", F.lit(as_of).cast("timestamp")).join(asked.select("post_id").distinct(), "post_id", "left_semi")
    from_posts = post_sightings(dated)

    named = leads_in(dated).groupBy("post_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("leads")
    )
    linked = links_in(dated).filter("NOT shortened").select("post_id").distinct().withColumn("linked", F.lit(True))
    state = asked.join(dated.select("post_id", F.lit(True).alias("read")), "post_id", "left")
    state = state.join(linked, "post_id", "left").join(named, "post_id", "left")
    leads = state.filter("linked IS NULL AND leads IS NOT NULL").select("post_id", "leads")
    failed_posts = state.filter("linked IS NULL").select(
        "input_id", "raw",
        F.when(c("read").isNull(), "post could not be read").when(c("leads").isNotNull(), "no links in the post, but it names resources")
        .otherwise("post had no links").alias("why"),
    )

    plain = urls.canonicalise(rows.filter("post_id IS NULL").drop("post_id"), "raw", keep_bad=True)
    failed_links = plain.filter("u_url IS NULL").select("input_id", "raw", F.lit("not a URL").alias("why"))
    good = urls.drop_parts(plain.filter("u_url IS NOT NULL").withColumn("url", c("u_url")))
    fields = schemas.struct(schemas.SOURCE).fields
    manual = {"type": F.lit("manual"), "at": F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%S.000Z"))}
    source = F.struct(*[manual.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    if credit is not None:
        p = posts.select(
            c("post_id").alias("_post"), F.struct("url", "author", "created_at", "likes", "retweets", "views", "channel", "text").alias("p")
        )
        good = good.join(credit.select("raw", c("post_id").alias("_post")), "raw", "left").join(p, "_post", "left")
        first_line = urls.blank_to_null(F.split("p.text", r"\r?\n")[0])
        known = {
            "type": F.lit("x"), "post": c("p.url"), "post_id": c("_post"), "author": c("p.author"), "at": c("p.created_at"),
            "context": first_line, "channel": c("p.channel"), "resolved_by_hand": F.lit(True),
            "engagement": F.struct(c("p.likes").alias("likes"), c("p.retweets").alias("retweets"), c("p.views").alias("views")),
        }
        credited = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        source = F.when(c("p").isNotNull(), credited).otherwise(source)
    direct = good.select(
        c("input_id").alias("sighting_id"), "url", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("tags"), source.alias("source"),
        F.lit(as_of).cast("timestamp").alias("seen_at"),
    )
    return from_posts.unionByName(direct), leads, failed_posts.unionByName(failed_links)
