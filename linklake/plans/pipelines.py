"""End-to-end jobs: post and bookmark import, refresh, export, backfill."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import liveness, memory, publish, redirects, views
from ..operators.library import Library, apply_fetches, entries, upsert, upsert_report
from ..session import cut_lineage
from ..sources import bookmarks as bm
from ..sources import library_io


def import_bookmarks(library: Library, bookmarks: DataFrame, folder: str, seen_at: str, tag: str | None = None) -> tuple[Library, DataFrame]:
    """One named folder into the library, with counts of bookmarks read, added, merged and skipped."""
    rows = bm.read_folder(bookmarks, folder)
    sightings = bm.bookmark_sightings(rows, seen_at, tag)
    report = upsert_report(library, sightings)
    read = rows.agg(F.count("*").alias("read"))
    # A bookmark is new when it is the first of a new key; further ones of that key merge into it.
    counts = report.agg(
        F.count_if("created").alias("added"), F.coalesce(F.sum("sightings"), F.lit(0)).alias("used")
    )
    stats = read.join(F.broadcast(counts), F.lit(True)).select(
        "read", "added", (F.col("used") - F.col("added")).alias("merged"), (F.col("read") - F.col("used")).alias("skipped")
    )
    return upsert(library, sightings), stats


def refresh(library: Library, fetch_log: DataFrame, repo_api: DataFrame | None = None) -> tuple[Library, DataFrame]:
    """Apply fetched pages and repository answers, then fold renames. Returns the moves made."""
    found = liveness.verdicts(fetch_log)
    if repo_api is not None:
        found = liveness.combine_verdicts(found, liveness.repo_verdicts(repo_api))
    checked = apply_fetches(library, found).kept()
    head = cut_lineage(entries(checked))
    moves = cut_lineage(redirects.plan_moves(head))
    return redirects.merge_redirects(checked, moves, head), moves


def export_index(library: Library, path: str, generated_at: datetime, title: str, allow_risk: bool = False) -> dict:
    """Gate, sanitise and write the three views. The counts of held rows come with the result."""
    shipped = publish.published_library(library, allow_risk).kept()
    lines = views.render_list(entries(shipped), title)
    out = library_io.export(shipped, lines, path, generated_at)
    held = publish.held_counts(entries(library), allow_risk)
    return {**out, "held": {r.why: r.n for r in held.collect()}}


def backfill(messages: DataFrame, book: memory.LinkBook | None = None, ignore: DataFrame | None = None):
    """All history into the link book, and the vocabulary learned from it."""
    picked = memory.pick_links(messages, ignore)
    return memory.capture(book, picked), *memory.learn_vocab(messages)
