"""Page metadata by regular expressions over the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import blank_to_null

# The entities that are decoded by name.
NAMED_ENTITIES = [
    (r"&(?:amp|#38);", "&"), (r"&(?:lt|#60);", "<"), (r"&(?:gt|#62);", ">"),
    (r"&(?:quot|#34);", '"'), (r"&(?:apos|#39);", "'"), (r"&nbsp;", " "),
]


def _code_point(n: Column) -> Column:
    """UTF-8 text of a code point, for the range a page can hold."""
    hexed = (
        F.when(n < 0x80, F.format_string("%02X", n))
        .when(n < 0x800, F.format_string("%02X%02X", 192 + F.shiftright(n, 6), 128 + n.bitwiseAND(63)))
        .when(
            n < 0x10000,
            F.format_string(
                "%02X%02X%02X", 224 + F.shiftright(n, 12), 128 + F.shiftright(n, 6).bitwiseAND(63), 128 + n.bitwiseAND(63)
            ),
        )
        .otherwise(
            F.format_string(
                "%02X%02X%02X%02X",
                240 + F.shiftright(n, 18), 128 + F.shiftright(n, 12).bitwiseAND(63),
                128 + F.shiftright(n, 6).bitwiseAND(63), 128 + n.bitwiseAND(63),
            )
        )
    )
    return F.decode(F.unhex(hexed), "UTF-8")


def _decode_numeric(text: Column, pattern: str, base: int) -> Column:
    """Replace each distinct numeric entity; texts without any skip the work."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    digits = lambda e: F.regexp_extract(e, pattern, 1)
    number = lambda e: F.conv(digits(e), base, 10).cast("bigint").cast("int")
    out = F.aggregate(found, text, lambda acc, e: F.replace(acc, e, F.coalesce(_code_point(number(e)), F.lit(""))))
    return F.when(text.rlike(pattern), out).otherwise(text)


def decode_entities(text: Column) -> Column:
    for pattern, plain in NAMED_ENTITIES:
        text = F.regexp_replace(text, pattern, plain)
    return text


def _collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


META_TAG = r"(?i)<meta[^>]+>"


def _meta_content(tags: Column, name: str) -> Column:
    """``content`` of the first of the meta tags that bears the name; its closing quote must match its opening one."""
    named = rf"""(?i)<meta[^>]+(?:name|property)\s*=\s*(["']){name}\1"""
    tag = F.try_element_at(F.filter(tags, lambda t: t.rlike(named)), F.lit(1))
    value = F.regexp_extract(tag, r"""(?is)content\s*=\s*(["'])(.*?)\1""", 2)
    return blank_to_null(F.trim(value))


def _first_title(html: Column) -> Column:
    """First non-empty title outside inline svg.

    The text is cut at ``<title``; a title counts when the pieces before it open no more svg
    elements than they close.
    """
    pieces = F.split(html, r"(?i)(?=<title[^>]*>)")
    opened = lambda s: F.regexp_count(s, F.lit(r"(?i)<svg[\s>]")) - F.regexp_count(s, F.lit(r"(?i)</svg[\s>]"))
    titled = F.transform(
        pieces,
        lambda s: F.struct(
            opened(s).alias("svg"),
            F.trim(F.regexp_extract(s, r"(?is)^<title[^>]*>(.*?)</title>", 1)).alias("text"),
        ),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("title"))
    folded = F.aggregate(
        titled,
        start,
        lambda acc, s: F.struct(
            (acc["depth"] + s["svg"]).alias("depth"),
            F.coalesce(acc["title"], F.when((acc["depth"] <= 0) & (s["text"] != ""), s["text"])).alias("title"),
        ),
    )
    return folded["title"]


def with_page_metadata(df: DataFrame, html: str = "html", title_most: int | None = None, description_most: int | None = None) -> DataFrame:
    """Add ``page_title, og_title, description, site_name, image, lang`` read from ``html``.

    The meta tags are found in one pass and looked through by name. ``title_most`` and
    ``description_most`` cut those texts to so many characters; by default they stay whole.
    """
    c = F.col
    h, tags = c(html), c("_meta_tags")
    pick = lambda *names: F.coalesce(*[_meta_content(tags, n) for n in names])
    raw = {
        "page_title": _first_title(h),
        "og_title": pick("og:title", "twitter:title"),
        "description": pick("description", "og:description", "twitter:description"),
        "site_name": pick("og:site_name", "application-name"),
        "image": pick("og:image", "twitter:image"),
    }
    lang = F.regexp_extract(h, r"""(?i)<html[^>]+lang\s*=\s*["']([^"']+)["']""", 1)
    out = df.withColumn("_meta_tags", F.regexp_extract_all(h, F.lit(META_TAG), F.lit(0)))
    out = out.withColumns({**raw, "lang": blank_to_null(lang)}).drop("_meta_tags")
    # Decoded in steps of their own, so that no step repeats the one before it.
    out = out.withColumns({n: decode_entities(c(n)) for n in raw})
    out = out.withColumns({n: _decode_numeric(c(n), r"&#(\d+);", 10) for n in raw})
    out = out.withColumns({n: _collapse(_decode_numeric(c(n), r"(?i)&#x([0-9a-f]+);", 16)) for n in raw})
    cut = lambda n, most: c(n) if most is None else F.left(n, F.lit(most))
    return out.withColumns(
        {"page_title": blank_to_null(cut("page_title", title_most)), "description": blank_to_null(cut("description", description_most))}
    )
