"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

ENGAGEMENT = "struct<likes:bigint,retweets:bigint,views:bigint>"
SOURCE = (
    "struct<type:string,post:string,post_id:string,author:string,folder:string,title:string,context:string,"
    f"`by`:string,path:string,channel:string,resolved_by_hand:boolean,at:string,engagement:{ENGAGEMENT}>"
)
LIVENESS = "struct<status:string,code:int,note:string,checked_at:timestamp,final_url:string,ms:bigint>"
GITHUB = (
    "struct<stars:bigint,language:string,topics:array<string>,archived:boolean,pushed_at:timestamp,license:string>"
)
POSITION = "struct<grp:int,at:timestamp,id:bigint,idx:int>"
RANK = "struct<depth:int,has_query:boolean,has_hash:boolean,len:int>"

SIGHTINGS = (
    f"sighting_id bigint, url string, name string, note string, section string, tags array<string>, "
    f"source {SOURCE}, seen_at timestamp"
)
FACTS = (
    f"key string, kind string, value string, `from` string, source {SOURCE}, rank {RANK}, "
    f"pos {POSITION}, last_at timestamp"
)
STATE = (
    f"key string, title string, description string, site_name string, lang string, image string, "
    f"liveness {LIVENESS}, github {GITHUB}, updated_at timestamp"
)
DOCUMENT = (
    "key string, url string, aliases array<string>, title string, description string, site_name string, "
    "lang string, image string, names array<string>, sections array<string>, local_sections array<string>, "
    "tags array<string>, flags array<string>, claims array<struct<text:string,`from`:string>>, "
    f"sources array<{SOURCE}>, liveness {LIVENESS}, github {GITHUB}, mentions bigint, first_seen timestamp, "
    "last_seen timestamp, updated_at timestamp"
)
MESSAGES = "msg_id bigint, text string, at timestamp, session string, cwd string, queued boolean"
POST_SNAPSHOTS = (
    "post_id string, channel string, text string, author string, created_at string, likes bigint, "
    "retweets bigint, views bigint, url string, truncated boolean, unexpanded int, "
    "article struct<title:string,preview:string>, media array<string>"
)
FETCH_LOG = (
    "key string, url string, code int, error string, body string, mitigated boolean, final_url string, "
    "ms bigint, checked_at timestamp"
)
SITE_EVENT_LINE = "at string, c string, a string, _bad string"

AGENT_LOG_1 = (
    "type string, sessionId string, timestamp string, cwd string, isMeta boolean, isSidechain boolean, "
    "toolUseResult variant, message struct<role:string,content:variant>, "
    "attachment struct<type:string,prompt:variant,commandMode:string,origin:struct<kind:string>>"
)
AGENT_LOG_2 = (
    "timestamp string, payload struct<id:string,cwd:string,originator:string,type:string,role:string,"
    "content:array<struct<text:string>>>"
)

STATUS_ORDER = ["alive", "blocked", "unknown", "dead"]


def struct(ddl: str) -> T.StructType:
    return T.DataType.fromDDL(ddl)
