import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from linklake.llm import url_markov as U

ROWS = [
    "http://a.org/x", "https://WWW.Example.org/es/1", "http://m.example.org/en/12?x", "http://example.org/en/2", "http://b.com/fr/1", "http://B.com/de/9#t",
    "http://org/", "http://x.org", "http://forg/", "nothing", "", None, "http://", "http://h?x://y/z", "a://b://c/d", "http://é.com/fr/ü\nx", "http://a.org/x",
    "http://" + "long" * 5000 + ".net/q",
]


def brute_parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute_rule(host, path):
    found = [(len(r), r, v) for v, r in U.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(found)[1:] if found else (None, None)


def fold(url):
    text = (url or "").translate(str.maketrans(U.FOLD_FROM, U.FOLD_TO))
    return [U.ALPHABET.find(c) + 1 for c in text]


def brute_chance(urls):
    """Witten-Bell chances of the order-3 model of some URLs."""
    count = defaultdict(Counter)
    for u in urls:
        codes = [0] * 3 + fold(u)
        for i in range(3, len(codes)):
            for k in range(4):
                count[tuple(codes[i - k : i])][codes[i]] += 1

    def chance(past, code):
        p = 1 / 32
        for k in range(4):
            seen = count.get(tuple(past[3 - k :]))
            if seen:
                p = (seen[code] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    return chance


def brute_score(url, yes, no):
    codes = [0] * 3 + fold(url)
    terms = [math.log(yes(codes[i - 3 : i], codes[i]) / no(codes[i - 3 : i], codes[i])) for i in range(3, len(codes))]
    return sum(terms) / len(terms) if terms else 0.0


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(ROWS)] + [(None, None, 1, "h")], "page_id long, url string, host int, path string")
    got = {r.page_id: r for r in U.judged(pages).collect()}
    assert len(got) == len(ROWS) + 1
    for i, u in [*enumerate(ROWS), (None, None)]:
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")


def test_scores_match_brute_force(spark, data):
    import zlib

    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    urls = {r.page_id: r.url for r in pages.collect()}
    ruled = {i: brute_rule(*brute_parts(u))[1] for i, u in urls.items()}
    part = {i: zlib.crc32(u.encode()) % 5 for i, u in urls.items()}
    yes, no = (brute_chance([u for i, u in urls.items() if ruled[i] == v and part[i]]) for v in ("allow", "block"))
    got = U.judged(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r.score == pytest.approx(brute_score(urls[r.page_id], yes, no), abs=1e-4)
    free = [(r.score, r.verdict) for r in got if r.rule is None]
    assert max([s for s, v in free if v == "block"], default=-9) <= min([s for s, v in free if v == "allow"], default=9)


def test_threshold(spark):
    rows = [(x / 10 + 0.001, x >= 2) for x in range(-5, 9)] * 3 + [(0.9, False)]
    found = U.threshold(spark.createDataFrame(rows, "score double, accepted boolean")).first()
    assert found.least == pytest.approx(0.2)
    for some in ([], [(0.5, True)]):
        assert U.threshold(spark.createDataFrame(some, "score double, accepted boolean")).first().least == 0


def test_no_pages(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_plan_is_native(spark, data):
    plan = U.judged(spark.read.parquet(f"{data}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|BroadcastNestedLoop|Cartesian", plan)


def test_characters_are_told_apart(spark):
    ruled = ["http://a.example.org/en/1%d" % i for i in range(30)] + ["http://a.example.org/en/2%d" % i for i in range(30)]
    free = ["http://b.net/en/1x", "http://b.net/en/2x", "http://b.net/EN/2x", "http://b.net/日本", "http://b.net/日月", "http://b.net/%41", "http://b.net/_:1", "http://b.net/😀"]
    pages = spark.createDataFrame(list(enumerate([*ruled, *free])), "page_id long, url string")
    got = {r.page_id: r for r in U.judged(pages).collect()}
    one, two, upper = (got[len(ruled) + k].score for k in range(3))
    assert len(got) == len(ruled) + len(free) and one < two and upper != two
    rows = pages.select(U.symbols("url").alias("codes"), F.lit(True).alias("accepted"))
    grams = {"".join(r.gram) for r in U.ratios(rows).collect()}
    assert grams == {u[max(0, i - 3) : i + 1] for u in [*ruled, *free] for i in range(len(u))}
