"""Following renames: resources that turned out to be the same site are folded together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut_lineage
from ..sources import schemas
from .library import Library, flag_facts, fold_facts, mention_id
from .skew import salted_join


def redirect_edges(head: DataFrame) -> DataFrame:
    """``src, dst`` for live resources whose final address belongs to another resource."""
    c = F.col
    live = head.filter((c("liveness.final_url") != "") & (c("liveness.status") != "dead"))
    to = urls.canonicalise(live.select(c("key").alias("src"), c("liveness.final_url").alias("final")), "final")
    return urls.with_resource_key(to, name="dst").select("src", "dst").filter("src <> dst")


def claimants(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("claimants"))


def usable_edges(edges: DataFrame, catch_all: int = 3) -> DataFrame:
    """Edges into targets with fewer than ``catch_all`` claimants; others look like landing pages."""
    few = claimants(edges).filter(F.col("claimants") < catch_all).select("dst")
    return edges.join(few, "dst", "left_semi").select("src", "dst")


def terminal_targets(edges: DataFrame) -> DataFrame:
    """``src, dst`` with chains followed to their end by pointer doubling.

    Each round joins the pointer table with itself, so a chain of n hops takes about log2(n)
    rounds. A resource has one outgoing edge, so a walk that does not end is in a cycle; pointers
    carry the smallest key met on the way, and a cycle collapses to its smallest key.
    """
    c = F.col
    hops = cut_lineage(edges.select("src", "dst", F.least("src", "dst").alias("low")))
    steps = 1
    while True:
        nxt = hops.select(c("src").alias("mid"), c("dst").alias("far"), c("low").alias("far_low"))
        stepped = hops.join(nxt, hops["dst"] == nxt["mid"], "left").select(
            "src", F.coalesce("far", "dst").alias("dst"), F.least("low", F.coalesce("far_low", "low")).alias("low"),
            c("far").isNotNull().alias("open"),
        )
        stepped = cut_lineage(stepped)
        # Ended chains have no open pointer; a walk still open after 2^k > n steps is in a cycle.
        n_open, n_all = stepped.agg(F.count_if("open"), F.count("*")).first()
        hops = stepped.select("src", "dst", "low")
        if n_open == 0:
            return hops.select("src", "dst")
        steps *= 2
        if steps > 2 * n_all:
            break
    # Pointers that never end: the smallest key on the walk, then the smallest key of the cycle.
    open_rows = stepped.filter("open").select("src", "dst", "low")
    on_cycle = open_rows.select(c("src").alias("node"), c("low").alias("node_low"))
    settled = open_rows.join(on_cycle, c("dst") == c("node")).select("src", c("node_low").alias("dst"))
    ended = stepped.filter("NOT open").select("src", "dst")
    return ended.unionByName(settled).filter("src <> dst")


def plan_moves(head: DataFrame, catch_all: int = 3) -> DataFrame:
    """``src, dst, kind``: merged into an existing resource, or renamed when the target is new.

    Of several sources of one new target the first by key is the rename; the rest merge into it.
    """
    c = F.col
    moves = terminal_targets(usable_edges(redirect_edges(head), catch_all))
    known = head.select(c("key").alias("dst"), F.lit(True).alias("known"))
    first = Window.partitionBy("dst").orderBy("src")
    return moves.join(known, "dst", "left").select(
        "src", "dst",
        F.when(c("known") | (F.row_number().over(first) > 1), "merged").otherwise("renamed").alias("kind"),
    )


def merge_redirects(library: Library, moves: DataFrame, head: DataFrame) -> Library:
    """Re-key facts along ``moves`` and fold again. Merged resources lose their ``demoted`` flag.

    Flags that follow from the old key or address are written down as facts before the move.
    """
    c = F.col
    standing = head.select(c("key").alias("src"), F.explode("flags").alias("value"))
    standing = standing.join(moves, "src").select(c("dst").alias("key"), "value", "kind")
    standing = standing.filter("kind = 'renamed' OR value <> 'demoted'").select("key", "value")
    by_src = moves.select(c("src").alias("key"), "dst", c("kind").alias("move"))
    facts = salted_join(library.facts, by_src, ["key"], "left", spread=["key", "kind", "value"])
    merged = F.coalesce(c("move") == "merged", F.lit(False))
    kept = facts.filter(~(merged & (c("kind") == "flag") & (c("value") == "demoted")))
    # The address of a merged resource no longer competes, but still dates its first sighting.
    kept = kept.withColumn("kind", F.when(merged & (c("kind") == "url"), "moved_url").otherwise(c("kind")))
    # A moved source stays a source of its own where it names another person than the target's.
    moved_source = merged & (c("kind") == "source")
    kept = kept.withColumn("value", F.when(moved_source, F.concat_ws(" ", "value", mention_id(c("source")))).otherwise(c("value")))
    rekeyed = kept.select(
        F.coalesce("dst", "key").alias("key"), "kind", "value", "from", "source", "rank",
        c("pos").withField("grp", c("pos.grp") + merged.cast("int")).alias("pos"), "last_at",
    )
    aliases = moves.select(
        c("dst").alias("key"), F.lit("alias").alias("kind"), c("src").alias("value"),
        F.lit(None).cast("string").alias("from"), F.lit(None).cast(schemas.SOURCE).alias("source"),
        F.lit(None).cast(schemas.RANK).alias("rank"),
        F.struct(
            F.lit(1).alias("grp"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("bigint").alias("id"),
            F.lit(0).alias("idx"),
        ).alias("pos"),
        F.lit(None).cast("timestamp").alias("last_at"),
    )
    state = library.state.join(by_src, "key", "left").filter(~merged).select(
        F.coalesce("dst", "key").alias("key"), *[x for x in library.state.columns if x != "key"]
    )
    return Library(fold_facts(rekeyed.unionByName(aliases).unionByName(flag_facts(standing))), state)
