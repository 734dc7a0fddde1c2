"""URL canonicalisation as staged column expressions (JVM only, no UDF).

``canonicalise`` ends in an ``inline`` generator. It drops rows that are not URLs and is at the
same time a fence: filters on the result cannot be pushed below it, which would evaluate the
regex chain once more for every filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

_ESCAPE = r"""[^\x21-\x7e]|["<>`{}]"""
_LOCALE = "^(?:(?:" + "|".join(rules.LOCALE_LABELS) + r")\.)+(?=[^.]+\.[^.]+)"


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.regexp_replace(c, r"\+", " "))


def _escape_non_ascii(c: Column) -> Column:
    """Percent-encode what a URL parser encodes; rows of plain ASCII skip the work."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    encoded = F.transform(
        chars, lambda ch: F.when(ch.rlike(_ESCAPE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    )
    return F.when(c.rlike(_ESCAPE), F.array_join(encoded, "")).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; only paths that hold ``/.`` pay for it."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        segs,
        F.slice(segs, 1, 0),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(folded, "/")
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(F.contains(path, F.lit("/.")), closed).otherwise(path)


def canonicalise(df: DataFrame, url: str = "url", prefix: str = "u_", keep_bad: bool = False) -> DataFrame:
    """Add ``<prefix>url, host, origin, path, query, params, hash`` for the canonical form of ``url``.

    Rows that are not http(s) URLs are dropped, or kept with nulls under ``keep_bad``.
    """
    c = F.col
    t = "_" + prefix
    trimmed = F.rtrim(F.btrim(c(url), F.lit(rules.WHITESPACE)), F.lit(rules.TRAILING_PUNCTUATION))
    out = df.withColumn(t + "s", trimmed)
    out = out.withColumn(
        t + "s",
        F.when(c(t + "s").rlike("(?i)^https?://"), c(t + "s")).when(
            c(t + "s").rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+(/|$)"), F.concat(F.lit("https://"), c(t + "s"))
        ),
    )
    out = out.withColumn(t + "rest", F.ltrim(F.expr(f"substring({t}s, instr({t}s, ':') + 1)"), F.lit("/\\")))
    out = out.withColumn(t + "auth", F.regexp_extract(t + "rest", r"^[^/\\?#]*", 0))
    out = out.withColumns(
        {
            t + "hp": F.lower(F.substring_index(t + "auth", "@", -1)),
            t + "tail": F.expr(f"substring({t}rest, length({t}auth) + 1)"),
        }
    )
    has_port = F.contains(c(t + "hp"), F.lit(":"))
    out = out.withColumns(
        {
            t + "host": F.when(has_port, F.regexp_replace(t + "hp", r":\d*$", "")).otherwise(c(t + "hp")),
            t + "port": F.when(has_port, F.regexp_extract(t + "hp", r":(\d*)$", 1)).otherwise(""),
            t + "pq": F.substring_index(t + "tail", "#", 1),
            t + "frag": F.when(
                F.contains(c(t + "tail"), F.lit("#")), F.expr(f"substring({t}tail, instr({t}tail, '#'))")
            ).otherwise(""),
        }
    )
    out = out.withColumns(
        {
            t + "host": F.when(c(t + "host").endswith("."), F.expr(f"substring({t}host, 1, length({t}host) - 1)")).otherwise(c(t + "host")),
            t + "path": F.replace(F.substring_index(t + "pq", "?", 1), F.lit("\\"), F.lit("/")),
            t + "params": F.when(
                F.contains(c(t + "pq"), F.lit("?")), F.filter(F.split(F.expr(f"substring({t}pq, instr({t}pq, '?') + 1)"), "&"), lambda p: p != "")
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    pairs = F.transform(
        c(t + "params"),
        lambda p, i: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            _form_decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v"),
        ),
    )
    out = out.withColumn(t + "path", _escape_non_ascii(c(t + "path")))
    path = F.rtrim(_resolve_dots(c(t + "path")), F.lit("/"))
    out = out.withColumns(
        {
            t + "params": F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(rules.TRACKING_PARAM))),
            t + "path": path,
            t + "frag": F.when(c(t + "frag").isin("#", "#/"), "").otherwise(_escape_non_ascii(c(t + "frag"))),
            t + "origin": F.concat(
                F.lit("https://"),
                c(t + "host"),
                F.when(c(t + "port").isin("", "80", "443"), "").otherwise(
                    F.concat(F.lit(":"), c(t + "port").cast("decimal(20,0)").cast("string"))
                ),
            ),
        }
    )
    query = F.array_join(
        F.transform(c(t + "params"), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"
    )
    out = out.withColumns(
        {
            t + "path": F.when(c(t + "path") == "", "/").otherwise(c(t + "path")),
            t + "query": F.when(F.size(t + "params") > 0, F.concat(F.lit("?"), query)).otherwise(""),
        }
    )
    valid = (
        (c(t + "host").rlike(r"""^(?:[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]+|\[[0-9a-f:.]+\])$"""))
        & ((c(t + "port") == "") | (c(t + "port").cast("decimal(20,0)") <= 65535))
    )
    parts = F.struct(
        F.concat(c(t + "origin"), c(t + "path"), c(t + "query"), c(t + "frag")).alias(prefix + "url"),
        c(t + "host").alias(prefix + "host"),
        c(t + "origin").alias(prefix + "origin"),
        c(t + "path").alias(prefix + "path"),
        c(t + "query").alias(prefix + "query"),
        c(t + "params").alias(prefix + "params"),
        c(t + "frag").alias(prefix + "hash"),
    )
    rows = F.when(valid, F.array(parts)).otherwise(F.slice(F.array(parts), 1, 0))
    fence = F.inline_outer(rows) if keep_bad else F.inline(rows)
    return out.select(*[c(x) for x in df.columns], fence)


def drop_parts(df: DataFrame, prefix: str = "u_", keep: tuple[str, ...] = ()) -> DataFrame:
    names = [prefix + x for x in ("url", "host", "origin", "path", "query", "params", "hash")]
    return df.drop(*[n for n in names if n not in keep])


def canonical_host(host: Column) -> Column:
    """Fold language and ``www`` skins, but never a user's own sub-domain."""
    root = F.substring_index(host, ".", -2)
    user_space = root.isin(rules.USER_SPACE_HOSTS) & (host != root)
    return F.when(user_space, host).otherwise(F.regexp_replace(host, _LOCALE, ""))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def identity_depth(host: Column) -> Column:
    """Rows of the host table name a host or any of its sub-domains; entries have 2 or 3 labels."""
    table = F.create_map(*[F.lit(x) for kv in rules.PATH_DEPTH.items() for x in kv])
    look = lambda h: F.try_element_at(table, h)
    return F.coalesce(
        look(host), look(F.substring_index(host, ".", -2)), look(F.substring_index(host, ".", -3)), F.lit(0)
    )


def with_resource_key(df: DataFrame, prefix: str = "u_", name: str = "key") -> DataFrame:
    """Identity under which sightings are folded: host plus identifying path segments."""
    c = F.col
    out = df.withColumn("_h", canonical_host(c(prefix + "host")))
    out = out.withColumn("_d", identity_depth(c("_h")))
    segs = F.slice(path_segments(c(prefix + "path")), F.lit(1), c("_d"))
    key = F.when(c("_d") == 0, c("_h")).otherwise(
        F.concat_ws("/", c("_h"), blank_to_null(F.lower(F.array_join(segs, "/"))))
    )
    return out.withColumn(name, key).drop("_h", "_d")


def url_rank(prefix: str = "u_") -> Column:
    """Lower is better: shallow path, no query, no fragment, short. Ties go to the first seen."""
    c = F.col
    return F.struct(
        F.size(path_segments(c(prefix + "path"))).alias("depth"),
        (c(prefix + "query") != "").alias("has_query"),
        (c(prefix + "hash") != "").alias("has_hash"),
        F.length(prefix + "url").alias("len"),
    )


def post_id(text: Column) -> Column:
    t = F.trim(text)
    in_url = F.regexp_extract(text, r"(?i)(?:twitter|x)\.com/[^/]+/status(?:es)?/(\d+)", 1)
    return F.when(t.rlike(r"^\d{10,25}$"), t).otherwise(blank_to_null(in_url))


def with_link_key(df: DataFrame, prefix: str = "u_", name: str = "key") -> DataFrame:
    """Identity of a link in the link book: the post, or host + path + query."""
    c = F.col
    path = F.rtrim(F.regexp_replace(c(prefix + "path"), r"(?i)\.git$", ""), F.lit("/"))
    out = df.withColumns(
        {"_post": post_id(c(prefix + "url")), "_p": path, "_h": canonical_host(c(prefix + "host"))}
    )
    root = F.when(c(prefix + "query") != "", "/").otherwise("")
    tail = F.when(c("_p") != "", c("_p")).otherwise(root)
    key = F.when(c("_post").isNotNull(), F.concat(F.lit("x.com/status/"), c("_post"))).otherwise(
        F.concat(c("_h"), tail, c(prefix + "query"))
    )
    return out.withColumn(name, key).drop("_post", "_p", "_h")
