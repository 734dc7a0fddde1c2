"""Resource lists out of post text: links, names, notes, sections, framing and leads.

Lines of a post are exploded and looked at through windows per post. The only shuffle is by post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.text import clean_label, shortened, trim_space, utf16_length
from .skew import is_true

UNEXPANDED = r"^https://t\.co/"


def _blank(c: Column) -> Column:
    return trim_space(c) == ""


def links_in(posts: DataFrame, id_col: str = "post_id", text: str = "text") -> DataFrame:
    """Every link of a text in order; one row per address, unexpanded short links all kept."""
    c = F.col
    found = posts.select(
        id_col, F.posexplode(F.regexp_extract_all(c(text), F.lit(rules.ANY_LINK), F.lit(0))).alias("pos", "raw")
    )
    found = urls.canonicalise(found, "raw").select(
        id_col, "pos", c("u_url").alias("url"), c("u_url").rlike(UNEXPANDED).alias("shortened")
    )
    identity = F.when(c("shortened"), c("pos")).otherwise(F.lit(-1))
    return found.groupBy(id_col, "url", "shortened", identity.alias("_n")).agg(F.min("pos").alias("pos")).drop("_n")


def is_bare_link(line: Column) -> Column:
    """A line that starts with its only link, whatever follows the link."""
    t = trim_space(line)
    one = F.regexp_count(t, F.lit(rules.POST_LINK)) == 1
    link = F.regexp_extract(t, rules.POST_LINK, 0)
    lead = F.regexp_replace(t, rules.LINK_LEAD, "")
    rest = trim_space(F.regexp_replace(F.replace(t, link, F.lit("")), rules.LINK_LEAD, ""))
    return is_true(one & ((rest == "") | F.startswith(lead, link)))


def _without_emoji(line: Column) -> Column:
    ascii_only = F.octet_length(line) == F.length(line)
    return trim_space(F.when(ascii_only, line).otherwise(F.regexp_replace(line, rules.EMOJI, "")))


def is_label(line: Column, bare: Column | None = None) -> Column:
    """Short noun phrase without link, ordinal, narration or closing punctuation.

    ``bare`` is a column that holds the line without emoji; given one, that isn't worked out for each test.
    """
    bare = _without_emoji(line) if bare is None else bare
    has_cjk = bare.rlike(rules.CJK_LETTER)
    short = F.when(has_cjk, utf16_length(bare) <= 8).otherwise(
        (F.size(F.split(bare, r"(?U)\s+")) <= 3) & (utf16_length(bare) <= 24)
    )
    return (
        # A label has at most 24 characters, which is the cheapest test.
        (bare != "") & (F.length(bare) <= 24) & ~line.rlike(rules.POST_LINK) & ~line.rlike(rules.ORDINAL)
        & ~bare.rlike(rules.LABEL_END) & ~bare.rlike(rules.NARRATION) & short
    )


def _label_text(text: Column) -> Column:
    stripped = F.regexp_replace(F.regexp_replace(text, rules.ORDINAL, ""), rules.SEP_AFTER_NAME, "")
    return clean_label(stripped)


def _lines(posts: DataFrame, id_col: str, text: str) -> DataFrame:
    return posts.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("n", "line"))


def extract_resources(posts: DataFrame, id_col: str = "post_id", text: str = "text", max_note: int | None = None) -> DataFrame:
    """``post, pos, url, name, note, section`` rows in the order the author listed them."""
    c = F.col
    post = Window.partitionBy(id_col).orderBy("n")
    below = post.rowsBetween(1, Window.unboundedFollowing)
    above = post.rowsBetween(Window.unboundedPreceding, 0)
    # Posts without a link list nothing.
    lines = _lines(posts.filter(c(text).contains("http")), id_col, text).withColumns(
        {"blank": _blank(c("line")), "linked": c("line").contains("http") & c("line").rlike(rules.POST_LINK), "plain": _without_emoji(c("line"))}
    )
    lines = lines.withColumns({"bare": c("linked") & is_bare_link(c("line")), "label": is_label(c("line"), c("plain"))}).drop("plain")
    info = F.struct("line", "blank", "linked", "label")
    lines = lines.withColumns(
        {
            "next_bare": F.first(F.when(~c("blank"), c("bare")), ignorenulls=True).over(below),
            "up1": F.lag(info, 1).over(post),
            "up2": F.lag(info, 2).over(post),
            "down": F.lead(info, 1).over(post),
        }
    )
    heading = ~c("linked") & ~c("blank") & c("label") & ~is_true(c("next_bare"))
    # A heading that cleans to nothing clears the section, hence the wrapping struct.
    section = F.last(
        F.when(heading, F.struct(urls.blank_to_null(clean_label(c("line"))).alias("s"))), ignorenulls=True
    ).over(above)
    lines = lines.withColumn("section", section["s"]).filter("linked")

    nearest = lambda a, b: F.when(a.isNotNull() & ~a["blank"], a).otherwise(F.when(b.isNotNull() & ~b["blank"], b))
    up = nearest(c("up1"), c("up2"))
    down = c("down")
    lines = lines.withColumns(
        {
            "name_above": F.when(c("bare") & up.isNotNull() & ~up["linked"], _label_text(trim_space(up["line"]))),
            "note_below": F.when(
                down.isNotNull() & ~down["blank"] & ~down["linked"] & ~is_label(trim_space(down["line"]))
                & ~trim_space(down["line"]).rlike(rules.ORDINAL),
                clean_label(down["line"]),
            ),
        }
    )
    found = lines.select(
        id_col, "n", "line", "section", "name_above", "note_below",
        F.posexplode(F.regexp_extract_all(c("line"), F.lit(rules.POST_LINK), F.lit(0))).alias("k", "raw"),
    )
    found = urls.canonicalise(found, "raw").filter(~c("u_url").rlike(UNEXPANDED))
    # The text around a link is taken at its first occurrence in the line.
    found = found.withColumns(
        {
            "before": F.expr("substring(line, 1, instr(line, raw) - 1)"),
            "after": F.expr("substring(line, instr(line, raw) + length(raw))"),
        }
    )
    inline = _label_text(c("before"))
    found = found.withColumns(
        {
            "name": F.coalesce(urls.blank_to_null(inline), c("name_above"), F.lit("")),
            "note": F.coalesce(
                urls.blank_to_null(clean_label(F.regexp_replace("after", rules.SEP_BEFORE_NOTE, ""))), c("note_below"), F.lit("")
            ),
        }
    )
    prose = (utf16_length(c("name")) > 40) | c("name").rlike(rules.SENTENCE_MARK)
    found = found.withColumns(
        {
            "note": F.when(prose & (c("note") == ""), c("name")).otherwise(c("note")),
            "name": F.when(prose, "").otherwise(c("name")),
        }
    )
    pos = F.struct(c("n"), c("k"))
    found = found.select(
        id_col, pos.alias("pos"), c("u_url").alias("url"), urls.blank_to_null(c("name")).alias("name"),
        urls.blank_to_null(shortened(c("note"), max_note)).alias("note"), "section",
    )
    # A heading over a single link is a misread name; this comes before duplicates are dropped.
    covered = F.count("*").over(Window.partitionBy(id_col, "section"))
    found = found.withColumn("section", F.when(covered >= 2, c("section")))
    richness = (
        F.when(c("name").isNotNull(), 2).otherwise(0) + F.when(c("note").isNotNull(), 1).otherwise(0)
        + F.when(c("section").isNotNull(), 1).otherwise(0)
    )
    best = F.max_by(F.struct("name", "note", "section"), F.struct(richness.alias("r"), (-c("pos.n")).alias("a"), (-c("pos.k")).alias("b")))
    rich = found.groupBy(id_col, "url").agg(best.alias("b"), F.min("pos").alias("pos"))
    return rich.select(id_col, "pos", "url", "b.name", "b.note", "b.section")


def post_context(posts: DataFrame, id_col: str = "post_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """The prose above the first link of each post (row-local: the text is cut at that link's line)."""
    c = F.col
    lines = F.split(F.coalesce(c(text), F.lit("")), r"\r?\n")
    linked = F.transform(lines, lambda l: l.rlike(rules.POST_LINK))
    upto = F.array_position(linked, True)
    lead = F.when(upto > 0, F.slice(lines, F.lit(1), (upto - 1).cast("int"))).otherwise(lines)
    kept = F.filter(F.transform(lead, trim_space), lambda l: l != "")
    return posts.select(id_col, urls.blank_to_null(shortened(F.array_join(kept, " "), limit)).alias("context"))


def leads_in(posts: DataFrame, id_col: str = "post_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """Names in numbered lines that hold no link, for a person to resolve; those over ``longest`` UTF-16 units are left out if it is given."""
    c = F.col
    listed = _lines(posts, id_col, text).filter(c("line").rlike(rules.ORDINAL) & ~c("line").rlike(rules.POST_LINK))
    body = trim_space(F.regexp_replace("line", rules.ORDINAL, ""))
    named = listed.withColumn("name", clean_label(F.split(body, rules.LEAD_STOP, 2)[0]))
    named = named.filter(c("name") != "")
    if longest is not None:
        named = named.filter(utf16_length(c("name")) <= longest)
    return named.groupBy(id_col, "name").agg(F.min("n").alias("pos"))


def post_sightings(posts: DataFrame, seen_at: str = "seen_at") -> DataFrame:
    """Sightings of every resource a post lists, with the post as source."""
    from ..sources import schemas

    c = F.col
    fields = schemas.struct(schemas.SOURCE).fields
    known = {
        "type": F.lit("x"), "post": c("p.url"), "post_id": c("post_id"), "author": c("p.author"), "context": c("context"),
        "channel": c("p.channel"), "at": c("p.created_at"),
        "engagement": F.struct(c("p.likes").alias("likes"), c("p.retweets").alias("retweets"), c("p.views").alias("views")),
    }
    source = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    meta = posts.select("post_id", seen_at, F.struct("url", "author", "channel", "created_at", "likes", "retweets", "views").alias("p"))
    found = extract_resources(posts).join(meta, "post_id").join(post_context(posts), "post_id")
    return found.select(
        F.xxhash64("post_id", "pos").alias("sighting_id"), "url", "name", "note", "section",
        F.array().cast("array<string>").alias("tags"), source.alias("source"), c(seen_at).alias("seen_at"),
    )
