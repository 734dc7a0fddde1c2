"""Browser bookmark trees: nested folders flattened to rows, one tree level per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# Fixed value: microseconds between 1601-01-01 and 1970-01-01.
EPOCH_OFFSET = 11_644_473_600_000_000


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """``profile, tree``: one row per bookmark file, the tree as VARIANT."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("profile"), F.try_parse_json("value").alias("tree"))


def _added(raw: Column) -> Column:
    micros = raw.try_cast("bigint")
    return F.when(micros > 0, F.timestamp_micros(micros - EPOCH_OFFSET))


def _children(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array or object held in a VARIANT column."""
    df.createOrReplaceTempView("_linklake_nodes")
    return df.sparkSession.sql(
        f"SELECT n.*, v.pos AS _pos, v.key AS _key, v.value AS _node FROM _linklake_nodes n, LATERAL variant_explode(n.{column}) v"
    )


def flatten(trees: DataFrame) -> DataFrame:
    """``profile, folder, folder_name, title, url, added`` rows of every bookmark.

    ``folder`` is the path below the root. Each step explodes one level of folders, and the loop
    ends when a level holds no folder.
    """
    c = F.col
    get = lambda p: F.try_variant_get("_node", p, "string")
    roots = trees.select("profile", F.try_variant_get("tree", "$.roots", "variant").alias("kids")).filter("kids IS NOT NULL")
    level = _children(roots, "kids").select(
        "profile", F.array(F.coalesce(get("$.name"), F.lit(""))).alias("trail"),
        F.try_variant_get("_node", "$.children", "variant").alias("kids"), F.array("_pos").alias("place"),
    ).filter("kids IS NOT NULL")
    # The root node is itself a folder, so its name stands twice at the head of the trail.
    level = level.withColumn("trail", F.concat("trail", "trail"))
    found = None
    while True:
        nodes = _children(level, "kids").select(
            "profile", "trail", F.concat("place", F.array("_pos")).alias("place"), get("$.type").alias("type"),
            F.coalesce(get("$.name"), F.lit("")).alias("name"), get("$.url").alias("url"), get("$.date_added").alias("added"),
            F.try_variant_get("_node", "$.children", "variant").alias("kids"),
        )
        urls = nodes.filter("type = 'url' AND url <> ''").select(
            "profile", F.array_join(F.slice("trail", F.lit(2), F.size("trail")), "/").alias("folder"),
            F.element_at("trail", -1).alias("folder_name"), c("name").alias("title"), "url", _added(c("added")).alias("added"), "place",
        )
        found = urls if found is None else found.unionByName(urls)
        level = nodes.filter("type = 'folder' AND kids IS NOT NULL").select(
            "profile", F.concat("trail", F.array("name")).alias("trail"), "kids", "place"
        )
        if level.isEmpty():
            return found


def list_folders(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.groupBy("profile", "folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "profile", "folder")


def _wanted(folder: str | None) -> str:
    want = (folder or "").strip().lower()
    if not want:
        raise ValueError("a folder name is required; a whole bookmark tree is never read")
    return want


def read_folder(bookmarks: DataFrame, folder: str, recursive: bool = True) -> DataFrame:
    """Bookmarks of one named folder: by leaf, full path or path ending, and its descendants."""
    want = _wanted(folder)
    full, leaf = F.lower("folder"), F.lower("folder_name")
    hit = (leaf == want) | (full == want) | full.endswith("/" + want)
    if recursive:
        hit = hit | full.startswith(want + "/") | full.contains("/" + want + "/")
    rows = bookmarks.filter(hit)
    if rows.isEmpty():
        known = [r.folder for r in bookmarks.filter("folder <> ''").select("folder").distinct().orderBy("folder").limit(20).collect()]  # for the message alone
        raise ValueError(f"no bookmark folder matched {folder!r}; available: {', '.join(known)}")
    return rows


def find_folder(bookmarks: DataFrame, folder: str) -> tuple[str, str, int]:
    """(profile, folder, n) of the largest match; a name found in several profiles is an error."""
    want = _wanted(folder)
    full = F.lower("folder")
    leaf = F.substring_index(full, "/", -1)
    hits = list_folders(bookmarks).filter((leaf == want) | (full == want) | full.endswith("/" + want))
    profiles = [r.profile for r in hits.select("profile").distinct().orderBy("profile").limit(2).collect()]
    if not profiles:
        raise ValueError(f"no bookmark folder named {folder!r} in any profile")
    if len(profiles) > 1:
        raise ValueError(f"{folder!r} exists in more than one profile: {', '.join(profiles)}")
    best = hits.first()
    return best.profile, best.folder, best.n


def bookmark_sightings(bookmarks: DataFrame, seen_at: str, tag: str | None = None) -> DataFrame:
    """Sightings of bookmarks: title as name, folder name as section."""
    c = F.col
    at = F.date_format("added", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    known = {"type": F.lit("chrome"), "folder": c("folder"), "at": at, "title": c("title")}
    fields = schemas.struct(schemas.SOURCE).fields
    source = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    tags = F.array(F.lit(tag)) if tag else F.array().cast("array<string>")
    return bookmarks.select(
        F.xxhash64("profile", "place").alias("sighting_id"), "url", c("title").alias("name"), F.lit(None).cast("string").alias("note"),
        c("folder_name").alias("section"), tags.alias("tags"), source.alias("source"), F.lit(seen_at).cast("timestamp").alias("seen_at"),
    )
