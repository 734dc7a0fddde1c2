import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from linklake.sources import agent_logs, bookmarks, events, posts
from linklake.streaming import analytics as live
from linklake.streaming import capture as landing

URL = "https://x.com/marsh_lab/status/1840027731150012416 写得清楚，留着参考"


def _row(**o):
    return json.dumps({"sessionId": "s1", "timestamp": "2026-09-26T16:57:52Z", "cwd": "/p", **o}, separators=(",", ":"), ensure_ascii=False)


def _queued(prompt, kind="human", mode="prompt"):
    return _row(type="attachment", attachment={"type": "queued_command", "prompt": prompt, "commandMode": mode, "origin": {"kind": kind}})


LOG = [
    _row(type="user", message={"role": "user", "content": "早上好"}), _queued(URL), _queued("<task-notification>done</task-notification>", mode="task-notification"),
    _queued("sent by a peer", kind="peer"), _queued([{"type": "text", "text": "[Image #1] 左上角那块"}, {"type": "image"}]),
    _row(type="user", message={"role": "user", "content": URL}), _row(type="user", toolUseResult={"x": 1}, message={"role": "user", "content": "tool"}), "{broken \"type\":\"user\"",
]


def test_agent_log_1_and_live_capture(spark, tmp_path):
    (tmp_path / "logs" / "subagents").mkdir(parents=True)
    (tmp_path / "logs" / "s1.jsonl").write_text("\n".join(LOG))
    (tmp_path / "logs" / "subagents" / "s9.jsonl").write_text(LOG[0])
    got = agent_logs.read_messages(spark, str(tmp_path / "logs")).collect()
    assert sorted((r.text, r.queued) for r in got) == sorted([("早上好", False), (URL, True), ("[Image #1] 左上角那块", True)])

    out, cp = str(tmp_path / "picks"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds nothing new
        q = landing.capture_queued(landing.landed_lines(spark, str(tmp_path / "logs")), out, cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
    book = landing.read_book(spark, out)
    assert [(r.key, r.text) for r in book.said.collect()] == [("x.com/status/1840027731150012416", "写得清楚，留着参考")]


def test_agent_log_2(spark, tmp_path):
    head = lambda who: json.dumps({"payload": {"id": "c1", "cwd": "/q", "originator": who}})
    body = [json.dumps({"timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "message", "role": r, "content": [{"text": t} for t in ts]}}, separators=(",", ":"))
            for r, ts in (("user", ["hello", "<environment_context> x"]), ("assistant", ["no"]))]
    (tmp_path / "a.jsonl").write_text("\n".join([head("codex-tui"), *body]))
    (tmp_path / "b.jsonl").write_text("\n".join([head("exec"), *body]))
    got = agent_logs.read_messages(spark, None, str(tmp_path)).collect()
    assert [(r.text, r.session, r.cwd) for r in got] == [("hello", "c1", "/q")]


def test_bookmarks(spark, tmp_path):
    url = lambda n: {"type": "url", "name": n, "url": f"https://{n}.com/", "date_added": "13300000000000000"}
    tree = {"roots": {"bar": {"type": "folder", "name": "Bar", "children": [url("a"), {"type": "folder", "name": "Design", "children": [url("b"), {"type": "folder", "name": "Deep", "children": [url("c")]}]}]}, "version": 1}}
    (tmp_path / "Bookmarks").write_text(json.dumps(tree))
    rows = bookmarks.flatten(bookmarks.read_trees(spark, str(tmp_path / "Bookmarks"))).drop("place").cache()
    assert {(r.folder, r.folder_name, r.title) for r in rows.collect()} == {("Bar", "Bar", "a"), ("Bar/Design", "Design", "b"), ("Bar/Design/Deep", "Deep", "c")}
    assert rows.first().added.year == 2022
    assert {r.title for r in bookmarks.read_folder(rows, "design").collect()} == {"b", "c"}
    assert {r.title for r in bookmarks.read_folder(rows, "DESIGN", recursive=False).collect()} == {"b"}
    assert bookmarks.find_folder(rows, "deep")[1:] == ("Bar/Design/Deep", 1)
    for bad in ("", "nothing"):
        with pytest.raises(ValueError):
            bookmarks.read_folder(rows, bad)
    twice = rows.unionByName(rows.withColumn("profile", F.lit("other")))
    with pytest.raises(ValueError, match="more than one profile"):
        bookmarks.find_folder(twice, "deep")


def test_best_snapshot(spark):
    cases = {"1": [("fxtwitter", "whole https://m.com", False), ("syndication", "some longer text https://m.com https://n.com", False)],
             "2": [("fxtwitter", "x https://t.co/a", False), ("syndication", "x", False)],
             "3": [("fxtwitter", "x https://t.co/a", False), ("syndication", "longer text here with https://t.co/b", True)],
             "4": [("fxtwitter", "longer than the other", True), ("syndication", "short", True)], "5": [("syndication", "only", True)],
             "6": [("mirror", "from elsewhere", False)], "7": [("mirror", "whole https://m.com", False), ("syndication", "cut", True)]}
    rows = [(i, ch, t, tr) for i, xs in cases.items() for ch, t, tr in xs]
    df = spark.createDataFrame(rows, "post_id string, channel string, text string, truncated boolean")
    got = {r.post_id: r.channel for r in posts.best_snapshot(posts.with_completeness(df)).collect()}
    assert got == {"1": "fxtwitter", "2": "syndication", "3": "syndication", "4": "fxtwitter", "5": "syndication", "6": "mirror", "7": "mirror"}


def test_event_files_and_live_rates(spark, tmp_path):
    line = lambda h, a: json.dumps({"at": f"2026-01-01T{h:02d}:10:00Z", "c": "browser", "a": a}) + "\n"
    (tmp_path / "events.log").write_text(line(1, "e=s&n=4&m=1") + line(1, "e=miss&q=x") + "junk\n")
    with gzip.open(tmp_path / "events.log.1.gz", "wt") as f:
        f.write(line(0, "e=s&n=2&m=2") + line(9, "e=s&n=1"))
    rows = events.read_event_log(spark, str(tmp_path / "events.log*"))
    assert rows.count() == 5 and rows.filter("bad").count() == 1
    rows.filter("NOT bad").drop("bad").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, c string, a string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "rates")
    q = live.hourly_rates(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window_start.hour: (r.searches, r.misses, r.gaps) for r in spark.read.parquet(out).collect()}
    assert got == {0: (2, 2, 0), 1: (4, 1, 1)}  # the ninth hour is still open


def test_live_chains(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("v", 0, "oak", 9), ("v", 1, "oakwood", 0), ("v", 2, "birch", 0), ("w", 600, "x", 1)]
    spark.createDataFrame([(v, t0 + dt.timedelta(minutes=m), i, q, n) for i, (v, m, q, n) in enumerate(rows)], "visit string, ts timestamp, event_id int, q string, results int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("visit string, ts timestamp, event_id int, q string, results int").parquet(str(tmp_path / "in"))
    q = live.visit_chains(stream).writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert [tuple(r) for r in spark.sql("SELECT * FROM chains WHERE visit = 'v'").collect()] == [("v", 2, 2)]
