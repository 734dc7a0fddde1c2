"""What a person typed to coding agents, read from the agents' session logs (two formats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import trim_space
from . import schemas


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, value`` of every log line below ``path``; sub-agent folders are left out.

    ``pos`` orders the lines of one file: first by the block of the file a line was read from,
    then by its number within that block.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("pos"),
        "value",
    )
    return lines.filter(~F.col("file").contains("/subagents/"))


def _texts(content: Column) -> Column:
    """A message body is a string or an array of parts, of which the text parts count."""
    parts = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    from_parts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    kind = F.schema_of_variant(content)
    plain = F.try_variant_get(content, "$", "string")
    return F.when(kind == "STRING", F.array(plain)).when(kind.startswith("ARRAY"), from_parts)


def parse_log_1(lines: DataFrame) -> DataFrame:
    """``text, at, session, cwd, queued, file, pos``: typed messages and those queued mid-turn.

    ``lines`` has ``file, pos, value``. A cheap substring test comes before JSON parsing.
    """
    c = F.col
    likely = lines.filter(c("value").contains('"type":"user"') | c("value").contains('"queued_command"'))
    parsed = likely.withColumn("o", F.from_json("value", schemas.AGENT_LOG_1)).filter("o IS NOT NULL")
    parsed = parsed.filter(~F.coalesce("o.isMeta", F.lit(False)) & ~F.coalesce("o.isSidechain", F.lit(False)))
    typed = (c("o.type") == "user") & c("o.toolUseResult").isNull()
    queued = (
        (c("o.type") == "attachment") & (c("o.attachment.type") == "queued_command")
        & (c("o.attachment.origin.kind") == "human") & (c("o.attachment.commandMode") == "prompt")
    )
    body = F.when(typed, _texts(c("o.message.content"))).when(queued, _texts(c("o.attachment.prompt")))
    rows = parsed.filter(typed | queued).select(
        "file", "pos", c("o.timestamp").alias("at"), c("o.sessionId").alias("session"), c("o.cwd").alias("cwd"),
        (c("o.type") == "attachment").alias("queued"), F.posexplode(body).alias("part", "text"),
    )
    return rows.filter(~c("text").rlike(rules.INJECTED_TEXT_1)).withColumn("at", F.try_to_timestamp("at"))


def first_per_session(rows: DataFrame) -> DataFrame:
    """A text that drains from the queue later arrives twice in one log; the first one counts."""
    c = F.col
    rest = [x for x in rows.columns if x not in ("file", "session", "text")]
    first = rows.groupBy("file", "session", trim_space(c("text")).alias("_t")).agg(
        F.min_by(F.struct("text", *rest), F.struct("pos", "part")).alias("r")
    )
    return first.select("file", "session", "r.*")


def messages_1(lines: DataFrame) -> DataFrame:
    return first_per_session(parse_log_1(lines)).select(
        "text", "at", "session", "cwd", "queued", F.xxhash64("file", "pos", "part").alias("msg_id")
    )


def messages_2(lines: DataFrame) -> DataFrame:
    """Messages of interactive sessions: the header of each file says who drove it and where."""
    c = F.col
    likely = lines.filter(c("value").contains('"originator"') | c("value").contains('"role":"user"'))
    parsed = likely.withColumn("o", F.from_json("value", schemas.AGENT_LOG_2)).filter("o.payload IS NOT NULL")
    firsts = lines.groupBy("file").agg(F.min("pos").alias("pos"))
    headers = parsed.join(firsts, ["file", "pos"]).filter(c("o.payload.originator").isin(rules.INTERACTIVE_ORIGINATORS))
    headers = headers.select("file", c("pos").alias("head"), c("o.payload.id").alias("session"), c("o.payload.cwd").alias("cwd"))
    body = parsed.filter((c("o.payload.type") == "message") & (c("o.payload.role") == "user"))
    rows = body.join(headers, "file").filter("pos > head").select(
        "file", "pos", F.try_to_timestamp("o.timestamp").alias("at"), "session", "cwd",
        F.posexplode("o.payload.content").alias("part", "x"),
    )
    rows = rows.withColumn("text", F.coalesce("x.text", F.lit(""))).filter(~c("text").rlike(rules.INJECTED_TEXT_2))
    return rows.select(
        "text", "at", "session", "cwd", F.lit(False).alias("queued"), F.xxhash64("file", "pos", "part").alias("msg_id")
    )


def read_messages(spark: SparkSession, log_1: str | None = None, log_2: str | None = None) -> DataFrame:
    """Messages of both kinds of log as one table."""
    sides = []
    if log_1:
        sides.append(messages_1(read_lines(spark, log_1)))
    if log_2:
        sides.append(messages_2(read_lines(spark, log_2)))
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out
