"""Block-list lookup, ignore lists and the tabular screen report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.privacy import host_suffixes, with_privacy
from .skew import salted_join


def with_blocklist(df: DataFrame, blocklist: DataFrame, host: str = "u_host") -> DataFrame:
    """Add ``blocked``: the block-listed domains each host equals or lies under.

    Hosts are reduced to distinct ones before the suffix equi-join, and only blocked hosts are
    joined back; the join back is salted because one blocked host may own very many rows.
    """
    domains = blocklist.select(F.lower(F.trim("domain")).alias("domain")).filter("domain <> ''").distinct()
    hosts = df.select(F.col(host).alias("_host")).distinct()
    hits = (
        hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
        .join(domains, "domain")
        .groupBy("_host")
        .agg(F.array_sort(F.collect_set("domain")).alias("blocked"))
    )
    return salted_join(df.withColumn("_host", F.col(host)), hits, ["_host"], "left").drop("_host")


def screen(df: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Privacy verdict per URL row: ``kind, is_private, reasons, public_ancestor``."""
    c = F.col
    parts = urls.canonicalise(df, keep_bad=True)
    if blocklist is not None:
        parts = with_blocklist(parts, blocklist)
    out = with_privacy(parts, blocked="blocked" if blocklist is not None else None)
    bad = c("u_url").isNull()
    out = out.withColumns(
        {
            "canonical_url": c("u_url"),
            "kind": F.when(bad, "invalid").when(c("is_private"), "private").otherwise("public"),
            "reasons": F.when(bad, F.array(F.lit("unparseable"))).otherwise(c("reasons")),
            "is_private": bad | c("is_private"),
        }
    )
    return urls.drop_parts(out.drop("blocked"))


def read_ignore_list(lines: DataFrame) -> DataFrame:
    """``value`` lines -> ``pattern`` rows: comments and blanks dropped, lower case."""
    p = F.lower(F.trim(F.regexp_replace("value", "#.*", ""))).alias("pattern")
    return lines.select(p).filter("pattern <> ''").distinct()


def drop_ignored(df: DataFrame, ignore: DataFrame, key: str = "key") -> DataFrame:
    """Anti-join on the owner's ignore list: a host or parent domain, or a host/path prefix.

    Every key is turned into the finite set of patterns that would ignore it (its host suffixes
    and its path prefixes), which makes the match an equi-join on distinct keys.
    """
    k = F.lower(F.col("_key"))
    host = F.regexp_extract(k, r"^[^/?#]*", 0)
    pieces = F.split(k, "/")
    prefixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))),
        lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"),
    )
    paths = F.filter(prefixes, lambda p: F.contains(p, F.lit("/")))
    keys = df.select(F.col(key).alias("_key")).distinct()
    hit = (
        keys.select("_key", F.explode(F.concat(host_suffixes(host), paths)).alias("pattern"))
        .join(ignore, "pattern", "left_semi")
        .select("_key")
        .distinct()
    )
    return salted_join(df.withColumn("_key", F.col(key)), hit, ["_key"], "left_anti").drop("_key")
