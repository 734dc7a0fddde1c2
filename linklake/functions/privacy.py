"""Privacy screen over canonical URL parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .urls import literal_array, path_segments


def first_contained(text: Column, needles: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in needles])


def _tagged(prefix: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), value))


def _host_reasons(host: Column) -> list[Column]:
    labels = F.split(host, r"\.")
    inner = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
    hit = F.try_element_at(F.filter(inner, lambda s: s.isin(rules.PRIVATE_LABELS)), F.lit(1))
    return [
        F.when(host.rlike(rules.PRIVATE_NETWORK), F.lit("private-network")),
        _tagged("host-prefix:", hit),
    ]


def with_privacy(df: DataFrame, prefix: str = "u_", blocked: str | None = None) -> DataFrame:
    """Add ``reasons``, ``is_private`` and ``public_ancestor`` to rows with canonical parts.

    ``blocked`` names an array column of block-listed domains the host falls under (see
    ``operators.screening.with_blocklist``). The ancestor is the deepest path prefix that
    screens clean with the query removed; the host rules are the same for every prefix, so only
    the path rules are tried again.
    """
    c = F.col
    host, query, frag = c(prefix + "host"), c(prefix + "query"), c(prefix + "hash")
    path = F.lower(c(prefix + "path"))
    secret = F.try_element_at(
        F.filter(
            c(prefix + "params"),
            lambda p: p["k"].rlike(rules.SECRET_PARAM)
            | ((F.length(p["v"]) > 60) & p["v"].rlike(rules.OPAQUE_VALUE)),
        ),
        F.lit(1),
    )
    query_reason = F.when(
        secret.isNotNull(),
        F.concat(
            F.lit("query:"), secret["k"],
            F.when(secret["k"].rlike(rules.SECRET_PARAM), "").otherwise("(opaque)"),
        ),
    )
    out = df.withColumns({"_network": _host_reasons(host)[0], "_label": _host_reasons(host)[1], "_path": path})
    fixed = F.array_compact(
        F.array(
            c("_network"),
            c("_label"),
            _tagged("path:", first_contained(c("_path"), rules.HARD_PATHS)),
            _tagged("soft-path:", first_contained(c("_path"), rules.SOFT_PATHS)),
            query_reason,
            F.when((frag != "") & frag.rlike(rules.SECRET_FRAGMENT), "fragment-credential"),
            F.when(c("_path").rlike(rules.FILE_PATH), "direct-file"),
        )
    )
    if blocked:
        listed = F.transform(F.coalesce(c(blocked), F.array().cast("array<string>")), lambda d: F.concat(F.lit("blocklist:"), d))
        fixed = F.concat(fixed, listed)
    out = out.withColumn("reasons", fixed)
    only_soft = (F.size("reasons") > 0) & F.forall(c("reasons"), lambda r: r.startswith("soft-path:"))
    forgiven = only_soft & (F.size(path_segments(c("_path"))) <= 1) & (query == "")
    out = out.withColumn("is_private", (F.size("reasons") > 0) & ~forgiven)

    segs = path_segments(c(prefix + "path"))
    n = F.size(segs)
    # Walks up with the query removed; ``i`` segments are kept. A soft word is forgiven at depth <= 1.
    prefixes = F.transform(
        F.sequence(n - 1, F.lit(0), F.lit(-1)),
        lambda i: F.struct(i.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(segs, F.lit(1), i), "/")).alias("p")),
    )
    clean = F.filter(
        prefixes,
        lambda s: first_contained(F.lower(s["p"]), rules.HARD_PATHS).isNull()
        & ~F.lower(s["p"]).rlike(rules.FILE_PATH)
        & ((s["depth"] <= 1) | first_contained(F.lower(s["p"]), rules.SOFT_PATHS).isNull()),
    )
    host_clean = c("_network").isNull() & c("_label").isNull()
    if blocked:
        host_clean = host_clean & (F.coalesce(F.size(blocked), F.lit(0)) <= 0)
    best = F.try_element_at(clean, F.lit(1))["p"]
    out = out.withColumn(
        "public_ancestor",
        F.when(c("is_private") & host_clean & (n > 0), F.concat(c(prefix + "origin"), best)),
    )
    return out.drop("_network", "_label", "_path")


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``; turns a suffix match into an equi-join key."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


__all__ = ["with_privacy", "host_suffixes", "first_contained", "literal_array"]
