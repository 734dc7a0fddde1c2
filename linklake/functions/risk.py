"""Publishing-risk predicates. Each looks at one value; rows of a key are combined by aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def names_shadow_library(text: Column) -> Column:
    hit = F.lit(False)
    for name in rules.SHADOW_NAMES:
        hit = hit | F.contains(text, F.lit(name))
    return hit


def has_risk_words(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.RISK_WORDS), F.lit(False))


def is_media_section(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.MEDIA_SECTION), F.lit(False))


def has_free_framing(text: Column) -> Column:
    return F.coalesce(text.rlike(rules.FREE_FRAMING), F.lit(False))


def is_share_host(url: Column) -> Column:
    return F.coalesce(url.rlike(rules.SHARE_HOST), F.lit(False))


def url_flags(url: Column) -> Column:
    """Flags that follow from an address alone."""
    return F.array_distinct(
        F.flatten(
            F.array(
                F.when(names_shadow_library(url), F.array(F.lit("legal_risk"), F.lit("shadow_library"))).otherwise(_none()),
                F.when(has_risk_words(url), F.array(F.lit("legal_risk"))).otherwise(_none()),
                F.when(is_share_host(url), F.array(F.lit("ephemeral"), F.lit("legal_risk"))).otherwise(_none()),
            )
        )
    )


def _none() -> Column:
    return F.array().cast("array<string>")
