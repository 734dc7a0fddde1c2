"""Liveness verdicts from a fetch log, repository facts, refresh selection and submissions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import risk, urls
from ..functions.html import with_page_metadata
from ..functions.privacy import with_privacy
from ..sources import schemas
from .skew import is_true

REPO_KEY = r"^github\.com/"


def with_liveness(log: DataFrame, looked_at: int | None = None, error_most: int | None = None) -> DataFrame:
    """Add ``status`` and ``note`` to rows of (code, error, body, mitigated).

    ``looked_at`` bounds the characters of the body searched for a challenge page, ``error_most`` those
    of an error that are noted; by default both are whole.
    """
    c = F.col
    code, err = c("code"), c("error")
    cut = lambda x, most: x if most is None else F.left(x, F.lit(most))
    blocked = is_true(cut(c("body"), looked_at).rlike(rules.CHALLENGE_PAGE)) | is_true(c("mitigated"))
    ok = code.between(200, 299)
    refusal = code.isin(403, 429, 503)
    status = (
        F.when(err.isNotNull() & err.rlike(rules.ERR_TIMEOUT), "unknown")
        .when(err.isNotNull() & err.rlike(rules.ERR_DNS), "dead")
        .when(err.isNotNull() & err.rlike(rules.ERR_REFUSED), "dead")
        .when(err.isNotNull() & err.rlike(rules.ERR_TLS), "blocked")
        .when(err.isNotNull(), "unknown")
        .when(ok, F.when(blocked, "blocked").otherwise("alive"))
        .when(refusal, "blocked")
        .when(code.isin(404, 410), "dead")
        .otherwise("unknown")
    )
    note = (
        F.when(err.isNotNull() & err.rlike(rules.ERR_TIMEOUT), "timeout")
        .when(err.isNotNull() & err.rlike(rules.ERR_DNS), "dns-failure")
        .when(err.isNotNull() & err.rlike(rules.ERR_REFUSED), "unreachable")
        .when(err.isNotNull() & err.rlike(rules.ERR_TLS), "tls-error")
        .when(err.isNotNull(), cut(err, error_most))
        .when(refusal, F.when(blocked, "bot-challenge").otherwise(F.concat(F.lit("http "), code.cast("string"))))
        .when(code >= 500, F.concat(F.lit("server error "), code.cast("string")))
    )
    return log.withColumns({"status": status, "note": note})


def verdicts(fetch_log: DataFrame) -> DataFrame:
    """Fetch rows to verdict rows. Metadata is read only from pages that are not dead."""
    c = F.col
    out = with_liveness(fetch_log)
    readable = c("error").isNull() & (c("status") != "dead")
    out = with_page_metadata(out.withColumn("_html", F.when(readable, c("body"))), "_html")
    return out.select(
        "key", "status", "code", "note", "checked_at", "final_url", "ms", "page_title", "og_title", "description",
        "site_name", "lang", "image", F.lit(None).cast(schemas.GITHUB).alias("github"),
    )


def repo_verdicts(repo_api: DataFrame) -> DataFrame:
    """Rows of (key, code, body JSON, checked_at) of a repository API to verdict rows.

    404 and 451 are dead. Any other failure gives no row, so the page fetch of that key is used.
    """
    c = F.col
    parsed = repo_api.withColumn(
        "j",
        F.from_json(
            "body",
            "full_name string, description string, stargazers_count bigint, language string, topics array<string>, "
            "archived boolean, pushed_at timestamp, license struct<spdx_id:string>",
        ),
    ).filter(c("code").isin(404, 451) | (c("code").between(200, 299) & c("j").isNotNull()))
    ok = c("code").between(200, 299)
    text = lambda x: F.when(ok, x)
    return parsed.select(
        "key",
        F.when(ok, "alive").otherwise("dead").alias("status"),
        F.lit(None).cast("int").alias("code"),
        F.when(c("code") == 404, "repo not found").when(c("code") == 451, "taken down (451)").alias("note"),
        "checked_at",
        F.lit(None).cast("string").alias("final_url"),
        F.lit(None).cast("bigint").alias("ms"),
        text(c("j.full_name")).alias("page_title"),
        F.lit(None).cast("string").alias("og_title"),
        text(c("j.description")).alias("description"),
        *[F.lit(None).cast("string").alias(x) for x in ("site_name", "lang", "image")],
        F.when(
            ok,
            F.struct(
                c("j.stargazers_count").alias("stars"), c("j.language").alias("language"),
                F.coalesce(c("j.topics"), F.array().cast("array<string>")).alias("topics"),
                c("j.archived").alias("archived"), c("j.pushed_at").alias("pushed_at"),
                c("j.license.spdx_id").alias("license"),
            ),
        ).cast(schemas.GITHUB).alias("github"),
    )


def combine_verdicts(pages: DataFrame, repos: DataFrame) -> DataFrame:
    """Repository answers win over page fetches of the same key; keys without one keep the page."""
    return repos.unionByName(pages.join(repos.select("key").distinct(), "key", "left_anti"))


def refresh_due(head: DataFrame, as_of: datetime, max_age_days: int = 7) -> DataFrame:
    """Resources whose last check is older than ``max_age_days``; private ones are never fetched."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days))
    stale = F.col("liveness.checked_at").isNull() | (F.col("liveness.checked_at") < cutoff)
    return head.filter(~F.array_contains("flags", "private") & stale).select(
        "key", "url", F.when(F.col("key").rlike(REPO_KEY), "repo").otherwise("web").alias("fetcher"),
        F.col("liveness.checked_at").alias("checked_at"),
    )


def status_counts(rows: DataFrame, status: str = "liveness.status") -> DataFrame:
    return rows.filter(F.col(status).isNotNull()).groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def check_submissions(submissions: DataFrame, head: DataFrame, page_verdicts: DataFrame) -> DataFrame:
    """Verdict per submitted (submission_id, url, note, from_post): refusal reason or a checked entry."""
    c = F.col
    parts = with_privacy(urls.canonicalise(submissions.withColumnRenamed("url", "raw_url"), "raw_url", keep_bad=True))
    parts = urls.with_resource_key(parts)
    parts = parts.select(
        *[x for x in submissions.columns if x != "url"], "raw_url", c("u_url").alias("url"), "key", "reasons",
        "is_private", "public_ancestor",
    )
    known = head.select("key", F.lit(True).alias("known"), c("mentions").alias("known_mentions"), c("url").alias("known_url"))
    fetched = page_verdicts.groupBy("key").agg(
        F.max_by(
            F.struct("status", "code", F.col("note").alias("fetch_note"), "checked_at", "page_title", "og_title", "description", "github"),
            F.struct("checked_at", "status", "code", "final_url"),  # a total order for fetches at one time
        ).alias("v")
    )
    out = parts.join(known, "key", "left").join(fetched, "key", "left")
    title = F.coalesce("v.og_title", "v.page_title")
    reason = (
        F.when(c("url").isNull(), "not-a-url")
        .when(c("is_private"), "private")
        .when(is_true(c("v.status") == "dead"), "dead")
    )
    hay = F.concat_ws(" ", "key", "url", title, "v.description", "note")
    flags = F.array_distinct(
        F.concat(
            risk.url_flags(c("url")),
            F.when(risk.names_shadow_library(c("key")), F.array(F.lit("legal_risk"), F.lit("shadow_library"))).otherwise(F.array().cast("array<string>")),
            F.when(risk.has_risk_words(hay), F.array(F.lit("legal_risk"))).otherwise(F.array().cast("array<string>")),
        )
    )
    out = out.withColumns({"reason": reason, "title": title, "flags": F.when(reason.isNull(), F.array_sort(flags))})
    accepted = c("reason").isNull()
    warnings = F.array_compact(
        F.array(
            F.when(is_true(c("v.status") == "blocked"), "blocked: metadata could not be read"),
            F.when(F.array_contains("flags", "legal_risk"), "legal_risk: a maintainer will decide"),
            F.when(c("title").isNull(), "no title could be read"),
        )
    )
    return out.select(
        *[x for x in submissions.columns if x != "url"], "raw_url", "url", "key", accepted.alias("accepted"), "reason",
        c("public_ancestor").alias("suggested_url"), c("reasons").alias("screen_reasons"),
        "title", c("v.description").alias("description"), "flags",
        c("v.status").alias("status"), c("v.code").alias("code"), c("v.fetch_note").alias("fetch_note"),
        c("v.checked_at").alias("checked_at"), c("v.github").alias("github"),
        F.coalesce("known", F.lit(False)).alias("duplicate"), "known_mentions", "known_url",
        F.when(accepted, warnings).alias("warnings"),
    )


def submission_sightings(checked: DataFrame, as_of: datetime) -> DataFrame:
    """Accepted submissions as sightings with a ``submission`` source."""
    c = F.col
    at = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    source = F.struct(
        F.lit("submission").alias("type"), c("from_post").alias("post"), c("submitter").alias("by"), at.alias("at")
    )
    fields = schemas.struct(schemas.SOURCE).fields
    filled = F.struct(*[
        (source[f.name] if f.name in ("type", "post", "by", "at") else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ])
    return checked.filter("accepted").select(
        c("submission_id").alias("sighting_id"), "url", c("title").alias("name"), "note",
        F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("tags"),
        filled.alias("source"), F.lit(as_of).cast("timestamp").alias("seen_at"),
    )
