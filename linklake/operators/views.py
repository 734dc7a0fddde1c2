"""Published views: the browsable list, the wall of cards and issue bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened
from ..session import cut_lineage
from .library import Library
from .skew import is_true

# Marks shown behind the name of a resource, and the label of the rest.
STATUS_MARK = {"alive": "", "blocked": " ⚠︎", "unknown": " ?", "dead": " ✗"}
REST = "Other"


def section_of(head: DataFrame) -> DataFrame:
    """Add ``section``: first public section, local section, tag, repository topic, else the rest."""
    topic = F.try_element_at(F.col("github.topics"), F.lit(1))
    return head.withColumn(
        "section", F.coalesce("first_section", "first_local_section", "first_tag", topic, F.lit(REST))
    )


def grouped_sections(head: DataFrame, min_group: int = 2) -> DataFrame:
    """Fold sections with fewer than ``min_group`` rows into the rest and number the groups.

    Group sizes are aggregated and joined back, so a section with most rows is not one window, and
    groups are numbered by a range-partitioned sort.
    ``group_order`` puts the largest first and the rest last.
    """
    c = F.col
    rows = section_of(head)
    sizes = rows.groupBy("section").agg(F.count("*").alias("n"))
    named = sizes.withColumn("group", F.when((c("n") < min_group), F.lit(REST)).otherwise(c("section")))
    totals = named.groupBy("group").agg(F.sum("n").alias("group_size"))
    place = F.struct((c("group") == REST).alias("rest"), (-c("group_size")).alias("size"), c("group").alias("name"))
    numbered = global_rank(totals.withColumn("_place", place), "_place", None, "group_order").drop("_place")
    numbered = numbered.withColumn("group_order", c("group_order").cast("int"))
    # Written down, so that the join below is one of two plain tables, whose hot section Spark splits.
    lookup = cut_lineage(named.select("section", "group").join(numbered, "group"))
    return rows.join(lookup, "section")


def _escape(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([|\[\]])", r"\\$1"), r"\n+", " "))


def list_lines(head: DataFrame, min_group: int = 2, longest: int | None = None) -> DataFrame:
    """``group_order, group, mentions, stars, key, line``: Markdown lines, to be written in that order."""
    c = F.col
    some = lambda *n: F.coalesce(*[F.when(c(x) != "", c(x)) for x in n])
    rows = grouped_sections(head, min_group)
    stars = F.coalesce("github.stars", F.lit(0))
    mark = F.lit("")
    for status, text in STATUS_MARK.items():
        mark = F.when(c("liveness.status") == status, text).otherwise(mark)
    desc = shortened(_escape(some("description", "first_claim")), longest)
    meta = F.concat_ws(
        " · ", F.when(stars > 0, F.concat(F.lit("★"), F.format_number(stars, 0))),
        F.when(c("mentions") > 1, F.concat(c("mentions").cast("string"), F.lit(" sources"))),
    )
    line = F.concat(
        F.lit("- **["), _escape(some("title", "first_name", "key")), F.lit("]("), c("url"), F.lit(")**"), mark,
        F.when(desc != "", F.concat(F.lit(" — "), desc)).otherwise(""),
        F.when(meta != "", F.concat(F.lit(" <sub>"), meta, F.lit("</sub>"))).otherwise(""),
    )
    return rows.select("group_order", "group", "group_size", "mentions", stars.alias("stars"), "key", line.alias("line"))


def render_list(head: DataFrame, title: str, min_group: int = 2) -> DataFrame:
    """The whole list as ordered ``value`` lines: heading, contents, sections and rows."""
    c = F.col
    rows = list_lines(head, min_group)
    groups = rows.groupBy("group_order", "group").agg(F.max("group_size").alias("n"))
    place = lambda part, group, m, s, key, text: F.struct(
        part.cast("int").alias("part"), group.cast("int").alias("g"), m.cast("int").alias("h"),
        (-s[0]).cast("bigint").alias("m"), (-s[1]).cast("bigint").alias("s"), key.alias("k"), text.alias("value"),
    )
    zero = (F.lit(0), F.lit(0))
    heads = groups.select(
        F.explode(
            F.array(
                place(F.lit(1), c("group_order"), F.lit(0), zero, F.lit(""), F.format_string("- [%s](#%s) (%d)", _escape(c("group")), F.regexp_replace(F.lower("group"), r"[^\w一-鿿]+", "-"), c("n"))),
                place(F.lit(2), c("group_order"), F.lit(0), zero, F.lit(""), F.concat(F.lit("## "), _escape(c("group")))),
            )
        ).alias("x")
    )
    body = rows.select(place(F.lit(2), c("group_order"), F.lit(1), (c("mentions"), c("stars")), c("key"), c("line")).alias("x"))
    top = rows.agg(F.count("*").alias("n")).select(
        F.explode(
            F.array(
                place(F.lit(0), F.lit(0), F.lit(0), zero, F.lit(""), F.lit("# " + title)),
                place(F.lit(0), F.lit(1), F.lit(0), zero, F.lit(""), F.concat(c("n").cast("string"), F.lit(" entries. Each stands once, with the result of its latest fetch."))),
                place(F.lit(0), F.lit(2), F.lit(0), zero, F.lit(""), F.lit("| ⚠︎ | answers, but turns machines away |")),
                place(F.lit(0), F.lit(3), F.lit(0), zero, F.lit(""), F.lit("| ? | the latest fetch settled nothing |")),
            )
        ).alias("x")
    )
    lines = top.unionByName(heads).unionByName(body)
    return lines.orderBy("x.part", "x.g", "x.h", "x.m", "x.s", "x.k").select("x.value")


def wall_sites(library: Library, head: DataFrame, curation: DataFrame, categories: DataFrame, shots: DataFrame, tags: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Site and repository cards, and what is missing for them.

    ``curation(key, cat, zh, en, name)``, ``categories(cat, label, pos)`` and ``shots(key, w, h)`` are
    small editorial tables; joins let Spark choose the side to broadcast by its size.
    """
    c = F.col
    some = lambda *n: F.coalesce(*[F.when(c(x) != "", c(x)) for x in n])
    notes = curation.select("key", *[c(x).alias("c_" + x) for x in ("cat", "zh", "en", "name")], F.lit(True).alias("curated"))
    rows = head.join(notes, "key", "left").withColumns(
        {
            "owner": F.regexp_extract("key", r"^github\.com/([^/]+)/([^/]+)$", 1),
            "repo": F.regexp_extract("key", r"^github\.com/([^/]+)/([^/]+)$", 2),
            "cat": F.coalesce(F.when(c("c_cat") != "", c("c_cat")), F.lit("design")),
        }
    )
    is_repo = c("owner") != ""
    shot = shots.select("key", c("w").alias("shot_w"), c("h").alias("shot_h"), F.lit(True).alias("shot"))
    rows = rows.join(shot, "key", "left")
    labels = categories.groupBy("cat").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))
    order = Window.partitionBy("key").orderBy("pos")
    own = library.facts.filter("kind = 'tag'").withColumn("r", F.row_number().over(order))
    if tags is not None:
        own = own.filter(c("r") <= tags)
    own = own.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("own_tags"))
    rows = rows.join(labels, "cat", "left").join(own, "key", "left")
    none = F.array().cast("array<string>")
    cards = rows.filter(is_repo | is_true(c("shot"))).select(
        F.when(is_repo, "repo").otherwise("site").alias("kind"), "key", "url", "cat",
        some("c_zh", "description", "title").alias("title"), some("c_en", "description", "title").alias("en"),
        F.array_compact(F.array(some("c_name", "site_name", "title"), some("title"))).alias("names"),
        F.concat(F.coalesce("labels", none), F.coalesce("own_tags", none)).alias("tags"),
        F.concat_ws(" ", some("description"), some("c_en")).alias("description"),
        F.when(is_repo, F.concat_ws("/", "owner", "repo")).otherwise(
            F.regexp_replace(F.regexp_extract("url", r"^https://([^/:?#]+)", 1), r"^www\.", "")
        ).alias("by"),
        "mentions", c("first_seen").alias("at"), c("github.stars").alias("stars"),
        F.when(is_repo, 16).otherwise(c("shot_w")).cast("int").alias("w"),
        F.when(is_repo, 10).otherwise(c("shot_h")).cast("int").alias("h"),
    )
    missing = rows.select(
        F.explode(
            F.array_compact(
                F.array(F.when(c("curated").isNull(), c("key")), F.when(~is_repo & c("shot").isNull(), F.concat(F.lit("shot:"), c("key"))))
            )
        ).alias("missing")
    )
    return cards, missing


def wall_videos(videos: DataFrame, media: DataFrame, english: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Video cards with complete media, and what is missing. Hidden ones never reach the wall."""
    c = F.col
    needed = ("clip", "still", "full")
    shown = videos.filter(~is_true(c("hide")))
    have = media.filter(c("part").isin(*needed)).groupBy("id").agg(
        F.count_distinct("part").alias("parts"), F.max(F.when(c("part") == "still", c("w"))).alias("w"),
        F.max(F.when(c("part") == "still", c("h"))).alias("h"),
    )
    rows = shown.join(have, "id", "left").join(english.select("id", c("en").alias("line")), "id", "left")
    complete = is_true(c("parts") == len(needed))
    cards = rows.filter(complete).select(
        F.lit("video").alias("kind"), c("id").alias("key"), "url", "cat", c("zh").alias("title"),
        F.coalesce(F.when(c("line") != "", c("line")), c("zh")).alias("en"), F.array_compact(F.array("author", "name")).alias("names"),
        c("line").alias("description"), F.concat(F.lit("@"), c("author")).alias("by"), "at", "likes", "w", "h",
    )
    missing = rows.select(
        F.when(~complete, F.concat(F.lit("video:"), c("id"))).when(c("line").isNull(), F.concat(F.lit("en:"), c("id"))).alias("missing")
    ).filter("missing IS NOT NULL")
    return cards, missing


def wall_order(items: DataFrame, featured: DataFrame | None = None, key: str = "key") -> DataFrame:
    """``wall_pos``: featured first as given, then three newest videos and one site, repeating.

    ``items`` has ``key, kind, at, mentions``; ``featured`` has ``key, pos``. The n-th video sits at
    slot n + (n-1)/3 and the n-th site at slot 4n; when one side runs out the other closes up.
    Ranks come from a range-partitioned sort, so no side is numbered in one task.
    """
    c = F.col
    rows = items
    if featured is not None:
        rows = rows.join(featured.select("key", c("pos").alias("_featured")), "key", "left")
    else:
        rows = rows.withColumn("_featured", F.lit(None).cast("int"))
    video = c("kind") == "video"
    order = F.struct(
        F.when(c("_featured").isNotNull(), 0).when(video, 1).otherwise(2).alias("part"),
        F.coalesce("_featured", F.lit(0)).alias("f"),
        F.when(video, -F.unix_micros("at")).otherwise(-c("mentions")).alias("a"),
        (c("kind") == "repo").alias("b"), c(key).alias("k"),
    )
    ranked = global_rank(rows.withColumn("_o", order), "_o", "_o.part")
    n = c("_rank")
    slot = F.when(c("_o.part") == 0, n - 1_000_000_000_000).when(c("_o.part") == 1, n + F.floor((n - 1) / 3)).otherwise(4 * n)
    placed = ranked.withColumn("_slot", F.struct(slot.cast("bigint").alias("s"), c("_o.part").alias("p"), c("_o.k").alias("k")))
    return global_rank(placed.drop("_rank"), "_slot", None, "wall_pos").drop("_o", "_slot", "_featured")


def global_rank(df: DataFrame, order: str, part: str | None, name: str = "_rank") -> DataFrame:
    """Row number over a total order, per value of ``part``, without a single-task window.

    Rows are range-partitioned and sorted; each partition numbers its rows and the counts of
    earlier partitions are added. Only (partition, part) counts meet in one place. The partition
    number is checkpointed, because sampling the ranges again could draw other borders.
    """
    c = F.col
    group = F.lit(0) if part is None else c(part)
    ranged = df.withColumn("_g", group).repartitionByRange(c("_g"), c(order)).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    inside = Window.partitionBy("_pid", "_g").orderBy(order)
    local = ranged.withColumn("_n", F.row_number().over(inside))
    counts = ranged.groupBy("_g", "_pid").agg(F.count("*").alias("_c"), F.min(order).alias("_first"))
    before = Window.partitionBy("_g").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, ["_g", "_pid"]).withColumn(name, c("_n") + c("_off")).drop("_g", "_pid", "_n", "_off")


def category_counts(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Non-empty categories in their given order with their number of cards."""
    counts = items.groupBy("cat").agg(F.count("*").alias("n"))
    return categories.select("cat", "cat_pos").distinct().join(counts, "cat").orderBy("cat_pos")


def issue_bodies(checked: DataFrame, longest: int | None = None) -> DataFrame:
    """``submission_id, title, body`` of accepted submissions, ready to be filed by a person."""
    c = F.col
    pipe = lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))
    iso = F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    code = F.when(c("code").isNotNull() & (c("code") != 0), F.concat(F.lit(" (HTTP "), c("code").cast("string"), F.lit(")"))).otherwise("")
    repo = F.concat(
        F.lit("| GitHub | ★"), c("github.stars").cast("string"),
        F.coalesce(F.concat(F.lit(" · "), c("github.language")), F.lit("")), F.coalesce(F.concat(F.lit(" · "), c("github.license")), F.lit("")),
        F.when(c("github.archived"), " · **archived**").otherwise(""), F.lit(" |"),
    )
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("**URL:** "), c("url")), F.concat(F.lit("**Key:** `"), c("key"), F.lit("`")), F.lit(""),
            F.lit("### Result of the fetch"), F.lit(""), F.lit("| | |"), F.lit("|---|---|"),
            F.concat(F.lit("| Liveness | `"), F.coalesce("status", F.lit("unchecked")), F.lit("`"), code, F.coalesce(F.concat(F.lit(" — checked "), iso), F.lit("")), F.lit(" |")),
            F.concat(F.lit("| Title | "), F.coalesce(pipe(c("title")), F.lit("_not found_")), F.lit(" |")),
            F.concat(F.lit("| Description | "), F.coalesce(pipe(shortened(c("description"), longest)), F.lit("_none_")), F.lit(" |")),
            F.when(c("github.stars").isNotNull(), repo),
            F.when(F.size("flags") > 0, F.concat(F.lit("| Flags | "), F.array_join(F.transform("flags", lambda f: F.concat(F.lit("`"), f, F.lit("`"))), ", "), F.lit(" |"))),
            F.when(c("from_post").isNotNull(), F.concat(F.lit("| Source post | "), c("from_post"), F.lit(" |"))),
            F.lit(""),
            F.when(c("note") != "", F.concat(F.lit("### Reason given\n\n"), c("note"), F.lit("\n"))),
            F.when(c("duplicate"), F.concat(F.lit("> Known as `"), c("key"), F.lit("` ("), c("known_mentions").cast("string"), F.lit(" mention(s) so far).\n> Filing it adds one more, and mentions decide the order.\n"))),
            F.when(F.size("warnings") > 0, F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("> "), w)), "\n")),
        )
    )
    return checked.filter("accepted").select(
        "submission_id", F.concat(F.lit("Add: "), F.coalesce("title", "key")).alias("title"), F.array_join(lines, "\n").alias("body")
    )
