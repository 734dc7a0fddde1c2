import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from linklake.operators import liveness, publish, redirects, search, views
from linklake.operators.library import Library, apply_fetches, entries, from_documents, to_documents, upsert, upsert_report
from linklake.session import cut_lineage
from linklake.sources import library_io, schemas

T0 = dt.datetime(2026, 1, 1)
SOURCE_FIELDS = [p.split(":")[0].strip("`") for p in schemas.SOURCE[7:-1].split("struct<")[0].split(",")]


def sighting(i, url, name=None, note=None, section=None, tags=None, **source):
    src = tuple(source.get(n) for n in SOURCE_FIELDS) if source else None
    return (i, url, name, note, section, tags, src, T0 + dt.timedelta(minutes=i))


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.SIGHTINGS)


def docs(lib):
    return {r.key: r for r in to_documents(lib)[0].collect()}


def fetch(spark, *rows):
    return spark.createDataFrame(
        [(k, f"https://{k}/", code, err, body, None, final, 1, T0) for k, code, err, body, final in rows], schemas.FETCH_LOG)


ROWS = [
    sighting(1, "https://www.lanternkit.dev/", "Lantern Kit", type="x", author="a", post_id="1"),
    sighting(2, "https://lanternkit.dev", "LanternKit", type="chrome", folder="design"),
    sighting(3, "https://a.com/", section="陶艺 手作资料", tags=["design"], type="chrome", folder="Other Bookmarks/陶艺 手作资料"),
    sighting(4, "https://a.com/", section="木工", type="x", post_id="1"),
    sighting(5, "https://tally.example.com/login", "E", type="chrome", folder="work"),
    sighting(6, "https://reelbarn.tv/", "Reelbarn", "watch free movies", "Evenings", type="x", context="Three sites for a rainy weekend."),
    sighting(7, "https://libgen.example.net/", type="manual", by="me"),
    sighting(8, "https://b.com/?token=1", type="manual"),
    sighting(9, "https://b.com/ok", type="x", author="z"),
]


def test_fold(spark):
    got = docs(upsert(None, frame(spark, ROWS)).kept())
    assert got["lanternkit.dev"].mentions == 2 and got["lanternkit.dev"].names == ["Lantern Kit", "LanternKit"]
    assert got["a.com"].local_sections == ["陶艺 手作资料"] and got["a.com"].sections == ["木工"] and got["a.com"].tags == ["design"]
    assert got["tally.example.com"].url == "https://tally.example.com/" and got["tally.example.com"].flags == ["demoted"]
    assert got["reelbarn.tv"].flags == ["legal_risk"]
    assert got["libgen.example.net"].flags == ["legal_risk", "shadow_library"]
    # A root address with a secret has nowhere to walk up to, so the resource is private as a whole.
    assert got["b.com"].flags == ["private"]


def test_two_batches_equal_one(spark):
    one = docs(upsert(None, frame(spark, ROWS)).kept())
    two = docs(upsert(upsert(None, frame(spark, ROWS[:4])).kept(), frame(spark, ROWS[4:])).kept())
    assert one == two
    report = {r.key: r.created for r in upsert_report(upsert(None, frame(spark, ROWS[:3])).kept(), frame(spark, ROWS[3:5])).collect()}
    assert report == {"a.com": False, "tally.example.com": True}


def test_flag_of_a_replaced_address_stays(spark):
    rows = [sighting(1, "https://s.com/libgen/x/y", type="x", author="a"), sighting(2, "https://s.com/", type="x", author="b"),
            sighting(3, "https://t.com/", type="x", author="a"), sighting(4, "https://t.com/libgen/deep", type="x", author="b")]
    got = docs(upsert(None, frame(spark, rows)).kept())
    assert got["s.com"].url == "https://s.com/" and got["s.com"].flags == ["legal_risk", "shadow_library"]
    # The second site's risky address was never its best one.
    assert got["t.com"].flags == []


def test_publish_gate_and_sanitising(spark):
    lib = upsert(None, frame(spark, ROWS)).kept()
    why = {r.key: r.why for r in publish.publish_gate(entries(lib)).collect()}
    assert why == {"lanternkit.dev": None, "a.com": None, "tally.example.com": "demoted-without-public-source", "reelbarn.tv": "legal_risk",
                   "libgen.example.net": "legal_risk", "b.com": "private"}
    vouched = upsert(lib, frame(spark, [sighting(20, "https://tally.example.com/", type="x", author="q")]))
    assert {r.key: r.why for r in publish.publish_gate(entries(vouched)).collect()}["tally.example.com"] is None
    shipped = publish.published_library(lib)
    text = " ".join(r.v for r in shipped.facts.select(F.to_json(F.struct("*")).alias("v")).collect())
    assert "陶艺" not in text and "design\"" in text and "folder" not in text
    rows = {r.type: r for r in shipped.facts.filter("kind = 'source' AND key = 'lanternkit.dev'").select("source.*").collect()}
    assert rows["bookmark"].at is None and rows["x"].author == "a"
    held = {r.why: r.n for r in publish.held_counts(entries(lib)).collect()}
    assert held == {"demoted-without-public-source": 1, "legal_risk": 2, "private": 1}


def test_source_dates_are_cut_to_the_month(spark):
    lib = upsert(None, frame(spark, [sighting(1, "https://a.com", type="chrome", folder="f", at="2026-06-10T15:09:09.989Z"),
                                     sighting(2, "https://a.com", type="x", author="s", at="2026-08-22T01:06:00.000Z")]))
    got = {r.type: r.at for r in publish.published_library(lib).facts.filter("kind = 'source'").select("source.*").collect()}
    assert got == {"bookmark": "2026-06", "x": "2026-08-22T01:06:00.000Z"}


def test_rename_folds_and_catch_all_does_not(spark):
    rows = [sighting(1, "https://moodwall.site/", "Moodwall", type="chrome", folder="d"), sighting(2, "https://fresh.gallery/", "Fresh", type="x", post_id="9"),
            *[sighting(10 + i, f"https://{h}.com/", type="x", post_id=h) for i, h in enumerate("abc")]]
    log = fetch(spark, ("moodwall.site", 200, None, "<title>G</title>", "https://fresh.gallery/?ref=moodwall"),
                *[(f"{h}.com", 200, None, None, "https://hub.com/") for h in "abc"])
    lib = apply_fetches(upsert(None, frame(spark, rows)).kept(), liveness.verdicts(log)).kept()
    head = cut_lineage(entries(lib))
    moves = cut_lineage(redirects.plan_moves(head))
    merged = redirects.merge_redirects(lib, moves, head).kept()
    got = docs(merged)
    assert set(got) == {"fresh.gallery", "a.com", "b.com", "c.com"}
    assert got["fresh.gallery"].aliases == ["moodwall.site"] and got["fresh.gallery"].names == ["Fresh", "Moodwall"]
    assert got["fresh.gallery"].mentions == 2 and got["fresh.gallery"].first_seen == T0 + dt.timedelta(minutes=1)
    wanted = spark.createDataFrame([("moodwall.site",), ("a.com",), ("none.com",)], "name string")
    assert {(r.name, r.key) for r in search.get_by_key(merged, entries(merged), wanted).collect()} == {("moodwall.site", "fresh.gallery"), ("a.com", "a.com")}


@pytest.mark.parametrize("edges, want", [
    ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e")}),
    ([("c", "b"), ("b", "a"), ("a", "c"), ("0", "c")], {("c", "a"), ("b", "a"), ("0", "a")}),
])
def test_chains_and_cycles(spark, edges, want):
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {tuple(r) for r in redirects.terminal_targets(df).collect()} == want


def test_liveness(spark):
    cases = [(200, None, "ok", "alive"), (200, None, "Just a moment...", "blocked"), (403, None, None, "blocked"), (404, None, None, "dead"), (410, None, None, "dead"),
             (503, None, None, "blocked"), (500, None, None, "unknown"), (301, None, None, "unknown"), (None, "TypeError fetch failed ENOTFOUND", None, "dead"),
             (None, "aborted by timeout", None, "unknown"), (None, "ECONNRESET", None, "dead"), (None, "bad certificate", None, "blocked"), (None, "odd", None, "unknown")]
    log = fetch(spark, *[(f"k{i}", c, e, b, None) for i, (c, e, b, _) in enumerate(cases)])
    got = {r.key: r.status for r in liveness.with_liveness(log).collect()}
    assert got == {f"k{i}": s for i, (_, _, _, s) in enumerate(cases)}


def test_repo_answers_win_over_pages(spark):
    api = spark.createDataFrame(
        [("github.com/a/b", 200, '{"full_name":"a/b","stargazers_count":5,"topics":["x"],"archived":false,"license":{"spdx_id":"MIT"}}', T0),
         ("github.com/a/c", 451, None, T0), ("github.com/a/d", 500, None, T0)], "key string, code int, body string, checked_at timestamp")
    pages = liveness.verdicts(fetch(spark, *[(f"github.com/a/{x}", 200, None, "<title>page</title>", None) for x in "bcd"]))
    got = {r.key: (r.status, r.page_title, r.github and r.github.license) for r in liveness.combine_verdicts(pages, liveness.repo_verdicts(api)).collect()}
    assert got == {"github.com/a/b": ("alive", "a/b", "MIT"), "github.com/a/c": ("dead", None, None), "github.com/a/d": ("alive", "page", None)}


def test_refresh_due(spark):
    lib = upsert(None, frame(spark, ROWS)).kept()
    lib = apply_fetches(lib, liveness.verdicts(fetch(spark, ("a.com", 200, None, None, None))))
    due = {r.key for r in liveness.refresh_due(entries(lib), T0 + dt.timedelta(days=3)).collect()}
    assert "a.com" not in due and "b.com" not in due and "lanternkit.dev" in due
    assert "a.com" in {r.key for r in liveness.refresh_due(entries(lib), T0 + dt.timedelta(days=8)).collect()}


def test_submissions(spark):
    head = cut_lineage(entries(upsert(None, frame(spark, ROWS[:4])).kept()))
    verdicts = liveness.verdicts(fetch(spark, ("a.com", 200, None, "<title>A</title>", None), ("dead.com", 404, None, None, None), ("new.com", 403, None, None, None)))
    rows = [(1, "https://a.com/x"), (2, "nope"), (3, "https://c.com/login"), (4, "https://dead.com"), (5, "https://new.com")]
    sub = spark.createDataFrame([(i, u, "note", None, "me") for i, u in rows], "submission_id bigint, url string, note string, from_post string, submitter string")
    checked = cut_lineage(liveness.check_submissions(sub, head, verdicts))
    got = {r.submission_id: r for r in checked.collect()}
    assert [got[i].reason for i in (1, 2, 3, 4, 5)] == [None, "not-a-url", "private", "dead", None]
    assert got[1].duplicate and got[1].known_mentions == 2 and got[3].suggested_url == "https://c.com/"
    assert len(got[5].warnings) == 2 and got[1].warnings == []
    new = docs(upsert(None, liveness.submission_sightings(checked, T0)))
    assert new["a.com"].sources[0].type == "submission" and new["a.com"].sources[0].by == "me"
    bodies = {r.submission_id: r.body for r in views.issue_bodies(checked).collect()}
    assert set(bodies) == {1, 5} and "Known as `a.com`" in bodies[1] and "_not found_" in bodies[5]


def test_documents_round_trip_through_files(spark, tmp_path):
    lib = upsert(None, frame(spark, ROWS)).kept()
    first = to_documents(lib)[0]
    path = str(tmp_path / "lib.jsonl")
    assert library_io.write_documents(first, path) == 6
    assert library_io.write_documents(first, path) == 6
    (tmp_path / "lib.jsonl" / "extra.json").write_text("\nnot json\n")
    good, bad = library_io.read_documents(spark, str(tmp_path / "missing"), path)
    assert bad.count() == 1
    want, got = docs(lib), docs(from_documents(good))
    assert {k: (r.names, r.sections, r.tags, r.mentions, r.flags, r.url) for k, r in want.items()} == {
        k: (r.names, r.sections, r.tags, r.mentions, r.flags, r.url) for k, r in got.items()}
    assert library_io.read_documents(spark, str(tmp_path / "nowhere"))[0].count() == 0


def test_large_resources_stay_whole_as_facts(spark):
    lib = upsert(None, frame(spark, ROWS)).kept()
    small, large = to_documents(lib, max_facts=4)
    keys = {r.key for r in small.collect()}
    assert keys and keys.isdisjoint({r.key for r in large.collect()})
    assert large.count() + lib.facts.join(small.select("key"), "key", "left_semi").count() == lib.facts.count()


def test_list_lines_and_sections(spark):
    rows = [sighting(i, f"https://s{i}.com/", f"N[{i}]", "about | it", "Big" if i < 3 else f"only{i}", type="x", author="a") for i in range(5)]
    got = views.list_lines(entries(upsert(None, frame(spark, rows)).kept())).orderBy("group_order", "key").collect()
    assert [r.group for r in got] == ["Big"] * 3 + ["Other"] * 2
    assert got[0].line == "- **[N\\[0\\]](https://s0.com/)** — about \\| it"
    text = [r.value for r in views.render_list(entries(upsert(None, frame(spark, rows)).kept()), "Links").collect()]
    assert text[0] == "# Links" and text.index("## Big") < text.index("## Other") < len(text) - 1


def test_export(spark, tmp_path):
    lib = upsert(None, frame(spark, ROWS)).kept()
    from linklake.plans.pipelines import export_index

    out = export_index(lib, str(tmp_path / "index"), T0, "Links")
    assert out["published"] == 2 and out["held"]["legal_risk"] == 2
    packed = "".join(p.read_text() for p in sorted((tmp_path / "index/resources.json").glob("part-*")))
    entries_ = json.loads(packed)["entries"]
    assert json.loads(packed)["count"] == len(entries_) == 2 and "陶艺" not in packed
    assert [-e["mentions"] for e in entries_] == sorted(-e["mentions"] for e in entries_)


def test_wall_order_matches_the_rule(spark):
    for n_videos, n_sites in ((7, 1), (2, 5), (0, 3), (4, 0), (9, 4)):
        items = [("video", f"v{i}", T0 - dt.timedelta(days=i), None) for i in range(n_videos)] + [("site", f"s{i}", None, 10 - i) for i in range(n_sites)]
        want, v, s = [], [x[1] for x in items if x[0] == "video"], [x[1] for x in items if x[0] == "site"]
        while v or s:
            want += v[:3] + s[:1]
            v, s = v[3:], s[1:]
        df = spark.createDataFrame(items, "kind string, key string, at timestamp, mentions bigint")
        assert [r.key for r in views.wall_order(df).orderBy("wall_pos").collect()] == want


def test_empty_library(spark):
    assert entries(Library.empty(spark)).count() == 0


def test_written_tables_are_dropped(spark):
    from linklake import session

    kept = list(session._written)
    session._written[:] = []
    cut = cut_lineage(spark.range(3))
    path = session._written[0]
    assert cut.count() == 3 and library_io.exists(spark, path)
    assert session.drop_written(spark) == 1 and not library_io.exists(spark, path)
    session._written[:] = kept
