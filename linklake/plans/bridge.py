"""Views that give the general test tables the shape of link data.

Each view is one SQL text that runs unchanged in Spark and in the checking engine. All rows of
the tables take part; modulo expressions only vary what a row becomes, never whether it counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas

TABLES = ("pages", "conversations", "events", "documents", "part", "benchmark", "labels", "customer", "supplier", "orders")

SIGHTINGS = """
SELECT v.sighting_id, v.page_id, v.url,
 CASE WHEN v.page_id % 4 < 2 THEN 'x' WHEN v.page_id % 4 = 2 THEN 'chrome' ELSE 'manual' END AS src_type,
 CASE WHEN v.page_id % 4 < 2 THEN concat('author', CAST(v.page_id % 17 AS STRING)) END AS src_author,
 CASE WHEN v.page_id % 4 < 2 THEN CAST(v.page_id AS STRING) END AS src_post_id,
 CASE WHEN v.page_id % 4 = 2 THEN concat('folder', CAST(v.page_id % 5 AS STRING)) END AS src_folder,
 CASE WHEN v.page_id % 4 = 3 THEN concat('person', CAST(v.page_id % 3 AS STRING)) END AS src_by,
 concat('name', CAST(v.page_id % 9 AS STRING)) AS name,
 concat('section', CAST(v.page_id % 6 AS STRING)) AS section,
 concat('tag', CAST(v.page_id % 7 AS STRING)) AS tag,
 CASE WHEN v.page_id % 12 = 7 THEN 'watch free movies' ELSE concat('note', CAST(v.page_id % 8 AS STRING)) END AS note,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * v.sighting_id AS seen_at
FROM (
 SELECT 4 * page_id AS sighting_id, page_id, url FROM pages
 UNION ALL
 SELECT 4 * page_id + 1 AS sighting_id, page_id,
  CASE CAST(floor(page_id / 4) AS BIGINT) % 4
   WHEN 0 THEN replace(url, '://', '://www.')
   WHEN 1 THEN concat(split_part(split_part(url, '#', 1), '?', 1), '/login')
   WHEN 2 THEN replace(url, '://', '://console.')
   ELSE concat(split_part(split_part(url, '#', 1), '?', 1), '?token=abc&b=2&a=1') END AS url
 FROM pages
 UNION ALL
 SELECT 4 * page_id + 2 AS sighting_id, page_id,
  replace(url, split_part(split_part(url, '://', 2), '/', 1), CASE WHEN page_id % 2 = 0 THEN 'github.com' ELSE 'www.gitlab.com' END) AS url
 FROM pages
) v
"""

MESSAGES = """
SELECT c.conv_id * 1000 + c.turn AS msg_id, CAST(c.conv_id AS STRING) AS session,
 concat('/home/project', CAST(c.conv_id % 5 AS STRING)) AS cwd,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (c.conv_id * 60 + c.turn) AS tm,
 concat(CASE WHEN b.text IS NULL THEN '' ELSE concat(b.text, ' ') END, c.text,
  CASE WHEN p.url IS NULL THEN '' ELSE concat(' ', p.url, ' and https://x.com/someone/status/', CAST(1000000000 + p.page_id AS STRING), '?s=20.') END,
  CASE WHEN c.conv_id % 7 = 0 THEN ' 上次给过你那个 repo' ELSE '' END) AS text
FROM conversations c
LEFT JOIN pages p ON p.page_id = CAST(floor((c.conv_id + c.turn) / 3) AS BIGINT) AND (c.conv_id + c.turn) % 3 <> 1
LEFT JOIN conversations b ON b.conv_id = c.conv_id - 5 AND b.turn = 0 AND c.conv_id % 4 = 1
WHERE c.role = 'user'
"""

FETCH_LOG = """
SELECT a.page_id, a.url, a.html,
 CASE a.page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 500 WHEN 4 THEN NULL ELSE 200 END AS code,
 CASE WHEN a.page_id % 10 = 4 THEN CASE a.page_id % 3 WHEN 0 THEN 'ENOTFOUND' WHEN 1 THEN 'ECONNREFUSED' ELSE 'timeout' END END AS error,
 CASE WHEN a.page_id % 3 = 1 AND b.url IS NOT NULL THEN b.url ELSE a.url END AS final_url,
 TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' HOUR * a.page_id AS checked_at
FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1
"""

SITE_LOG = """
SELECT event_id, ts AS tm,
 CASE WHEN user_id % 10 = 0 THEN 'bot' ELSE 'browser' END AS c,
 CASE event_type
  WHEN 'view' THEN concat('e=s&n=', CAST(event_id % 7 AS STRING), '&m=', CAST(event_id % 3 AS STRING), '&o=', CAST(event_id % 2 AS STRING), '&w=lg&l=en-US')
  WHEN 'signup' THEN 'e=s&w=sm&l=zh-CN'
  WHEN 'click' THEN concat('e=open&k=key', CAST(user_id % 20 AS STRING), '&r=', CAST(event_id % 10 AS STRING))
  WHEN 'error' THEN concat('e=miss&q=term%20', CAST(event_id % 30 AS STRING))
  ELSE 'e=view&s=old' END AS a
FROM events
"""

KEYSTROKES = """
SELECT e.event_id, CAST(e.user_id AS STRING) AS visit, e.ts,
 CASE WHEN e.event_id % 11 = 0 OR p.p_name IS NULL THEN '' ELSE substring(p.p_name, 1, CAST(1 + e.event_id % 8 AS INT)) END AS q,
 e.event_id % 4 AS results
FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id + CAST(extract(day FROM e.ts) AS BIGINT)
"""

POSTS = """
SELECT CAST(doc_id AS STRING) AS post_id, source AS author, lang,
 replace(replace(replace(text,
  concat('e.', chr(10)), concat('e: https://e.example.org/', lang, chr(10))),
  concat('s.', chr(10)), concat('s', chr(10), 'https://s.example.org/', source, chr(10), 'short blurb.', chr(10), chr(10), 'Tools list', chr(10))),
  concat('n.', chr(10)), concat('n.', chr(10), '1. Alpha: https://n.example.net/', lang, ' - a first note', chr(10),
   '2. Beta tool (free)', chr(10), '3、 Gamma: https://www.n.example.net/b?utm_source=z — more; see http://t.co/abc', chr(10))) AS text
FROM documents
"""

VIEWS = {
    "sightings": SIGHTINGS, "messages": MESSAGES, "fetch_log": FETCH_LOG, "site_log": SITE_LOG,
    "keystrokes": KEYSTROKES, "posts": POSTS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as a stream, be it one file or a folder of files.

    The path is a pattern that fits the table alone: Spark's file source takes a plain path for a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the base tables of a data directory."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for base in TABLES:
        if re.search(rf"(FROM|JOIN) {base}\b", VIEWS[name]):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def source_struct(**known: Column) -> Column:
    fields = schemas.struct(schemas.SOURCE).fields
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sightings view in the shape the library folds."""
    c = F.col
    v = view(spark, sf_dir, "sightings")
    source = source_struct(
        type=c("src_type"), post_id=c("src_post_id"), author=c("src_author"), folder=c("src_folder"), by=c("src_by"),
        at=F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return v.select(
        "sighting_id", "url", "name", "note", "section", F.array("tag").alias("tags"), source.alias("source"), "seen_at"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "messages").select("msg_id", "text", F.col("tm").alias("at"), "session", "cwd")


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log keyed by the resource each page belongs to."""
    from ..functions import urls

    c = F.col
    rows = urls.with_resource_key(urls.canonicalise(view(spark, sf_dir, "fetch_log")))
    return rows.select(
        "key", "url", c("code").cast("int").alias("code"), "error", c("html").alias("body"),
        F.lit(False).alias("mitigated"), "final_url", F.lit(None).cast("bigint").alias("ms"), "checked_at", "page_id",
    )
