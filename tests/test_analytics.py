import datetime as dt
import json
import random

from pyspark.sql import functions as F

from linklake.operators import analytics
from linklake.operators.skew import last_before, salted_join, with_neighbours

T0 = dt.datetime(2026, 1, 1)


def _loop(queries):
    searches = misses = 0
    last = None
    for q, n in queries:
        if not q:
            last = None
        elif last and (q.startswith(last[0]) or last[0].startswith(q)):
            misses += (n == 0) - (last[1] == 0)
            last = (q, n)
        else:
            searches, misses, last = searches + 1, misses + (n == 0), (q, n)
    return searches, misses


def test_chains_equal_the_counter(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for v in range(60):
        seq = [(rnd.choice(["", "s", "sh", "sha", "shad", "g", "go", "x"]), rnd.randrange(3)) for _ in range(rnd.randrange(1, 25))]
        want[str(v)] = _loop(seq)
        rows += [(str(v), T0 + dt.timedelta(minutes=17 * i), i, q, n) for i, (q, n) in enumerate(seq)]
    df = spark.createDataFrame(rows, "visit string, ts timestamp, event_id int, q string, results int")
    assert {r.visit: (r.searches, r.misses) for r in analytics.search_chains(df).collect()} == want


def test_event_log(spark):
    line = lambda t, a, c="browser": json.dumps({"at": f"2026-01-01T00:00:0{t}Z", "c": c, "a": a})
    lines = [line(1, "e=s&n=1", "bot"), line(2, "e=s&n=6&m=4&o=1&w=lg&l=en-US"), line(3, "e=view&s=old"), "not json", "", line(4, "e=miss&q=godot%20shaders+x"), line(5, "e=s&w=sm")]
    events = analytics.parse_events(analytics.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    r = analytics.report(events).first()
    assert (r.visits, r.searches, r.misses, r.open_count, r.gaps, r.malformed, r.searching_visits, r.copies) == (2, 6, 4, 1, 1, 2, 1, 0)
    assert abs(r.miss_rate - 4 / 6) < 1e-12
    assert [tuple(x) for x in analytics.tally(events, "miss", "q").collect()] == [("godot shaders x", 1)]
    empty = analytics.report(events.filter("kind = 'miss'")).first()
    assert empty.searches == 0 and empty.miss_rate is None


def test_skew_helpers_match_plain_operators(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else "k%d" % rnd.randrange(4), T0 + dt.timedelta(minutes=rnd.randrange(10000)), i, "v%d" % i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at timestamp, i int, v string")
    got = {(r.i, r.prev_v, r.next_v) for r in with_neighbours(df, "g", "at", ["at", "i"], "v").collect()}
    by = {}
    for g, at, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(g, []).append((i, v))
    want = {(i, s[n - 1][1] if n else None, s[n + 1][1] if n + 1 < len(s) else None) for s in by.values() for n, (i, _) in enumerate(s)}
    assert got == want

    values = df.filter("i % 3 = 0").select("g", "at", F.struct("v").alias("val"))
    asof = {r.i: r.val and r.val.v for r in last_before(df.select("g", "at", "i"), values, "g", "at", "val").collect()}
    for g, at, i, _ in rows:
        before = [r for r in rows if r[2] % 3 == 0 and r[0] == g and r[1] < at]
        latest = max((r[1] for r in before), default=None)
        assert asof[i] in ({r[3] for r in before if r[1] == latest} or {None})

    side = spark.createDataFrame([("hot", 1), ("k1", 2)], "g string, x int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(df, side, ["g"], how).collect())) == sorted(map(str, df.join(side, ["g"], how).collect()))


def test_rows_without_time_or_group_keep_their_neighbours(spark):
    hour = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [("v", hour(1), 1, "a"), ("v", hour(3), 2, "b"), ("v", None, 3, "c"), (None, hour(2), 4, "d"), (None, None, 5, "e")]
    df = spark.createDataFrame(rows, "visit string, ts timestamp, event_id int, q string")
    got = {r.q: (r.prev_q, r.next_q) for r in with_neighbours(df, "visit", "ts", ["ts", "event_id"], "q").collect()}
    assert got == {"c": (None, "a"), "a": ("c", "b"), "b": ("a", None), "e": (None, "d"), "d": ("e", None)}
    known = spark.createDataFrame([("v", hour(2), "x"), (None, hour(1), "y")], "visit string, ts timestamp, w string").selectExpr("visit", "ts", "struct(w) AS s")
    seen = {r.q: r.s and r.s.w for r in last_before(df, known, "visit", "ts", "s").collect()}
    assert seen == {"a": None, "b": "x", "c": None, "d": "y", "e": None}
