import math
import random

from pyspark.sql import functions as F

from linklake.functions import text
from linklake.operators import search

c = F.col


def _fields(spark, rows):
    return spark.createDataFrame(rows, "doc string, field string, text string")


def _queries(spark, *qs):
    return spark.createDataFrame([(q, q) for q in qs], "query_id string, query string")


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([(1, "设计灵感 Shaders beautiful-ui Three.js 库 动画")], "id int, t string")
    got = [r.token for r in text.explode_tokens(df, "t").collect()]
    assert got == ["设计", "计灵", "灵感", "设计灵感", "shaders", "shader", "beautiful-ui", "beautiful", "three.js", "three", "库", "库", "动画", "动画"]
    words = ["libraries", "classes", "boxes", "cats", "glass", "running", "edited", "sing", "abc", "a+s"]
    stems = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.stem(F.col("w"))).collect()]
    assert stems == ["library", "class", "box", "cat", "glass", "runn", "edit", "sing", "abc", "a+s"]


def test_plural_and_synonym_reach_other_wordings(spark):
    fields = _fields(spark, [
        ("canvas.dev", "title", "Fast canvas shaders for the browser"), ("canvas.dev", "key", "canvas.dev"),
        ("gallery.art", "title", "Prize gallery"), ("gallery.art", "description", "web design inspiration of the year"), ("gallery.art", "key", "gallery.art")])
    index = search.build_index(fields)
    best = {r.query_id: r.doc for r in search.top_k(search.score(index, search.expand_queries(_queries(spark, "shader", "设计灵感"))), 1).collect()}
    assert best == {"shader": "canvas.dev", "设计灵感": "gallery.art"}


def _mixed_fields(seed=3, docs=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    for d in range(docs):
        for field in ("title", "description", "tags"):
            yield (f"d{d:03}", field, " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(1, 25))))


def test_pruned_search_equals_scoring_everything(spark):
    index = search.build_index(_fields(spark, list(_mixed_fields())))
    rng = random.Random(5)
    asked = [" ".join(f"w{min(70, int(rng.expovariate(0.05)))}" for _ in range(rng.randint(1, 12))) for _ in range(40)]
    terms = search.expand_queries(_queries(spark, *set(asked)))
    terms = terms.withColumn("weight", F.when(F.xxhash64("query_id", "term") % 4 == 0, 0.5).otherwise(c("weight")))
    priors = spark.createDataFrame([(f"d{d:03}", 0.1 + d % 7 / 3) for d in range(400) if d % 5], "doc string, prior double")
    whole = search.score(index, terms)
    for k, prior in ((3, None), (10, None), (3, priors), (500, priors)):
        full = whole if prior is None else whole.join(prior, "doc").withColumn("score", c("score") * c("prior"))
        rows = lambda df: {(r.query_id, r.doc, r.rank, round(r.score, 6)) for r in search.top_k(df.withColumn("score", F.round("score", 6)), k).collect()}
        expected = rows(full)
        assert rows(search.best_scores(index, terms, k, prior)) == expected and expected


def test_pruned_search_scores_few_documents(spark):
    fields = [(f"d{i:05}", "title", "common words here" + (" needle" if i < 12 else "")) for i in range(4000)]
    index = search.build_index(_fields(spark, fields))
    scored = search.best_scores(index, search.expand_queries(_queries(spark, "needle common"), expand=False), 10)
    assert scored.count() < 200  # scoring everything gives 4,000 rows
    assert {r.doc for r in search.top_k(scored, 10).collect()} == {f"d{i:05}" for i in range(10)}


def test_search_without_matches_or_documents(spark):
    index = search.build_index(_fields(spark, [("a", "title", "word")]))
    terms = search.expand_queries(_queries(spark, "nothing", ""))
    assert search.best_scores(index, terms, 5).collect() == []
    empty = search.build_index(_fields(spark, []))
    assert search.best_scores(empty, search.expand_queries(_queries(spark, "word")), 5).collect() == []


def test_scores_equal_a_plain_loop(spark, tmp_path):
    docs = {"d1": [("title", "widget factory tools"), ("tags", "widget")], "d2": [("title", "factory"), ("description", "a widget widget in the factory")], "d3": [("url", "other thing")]}
    rows = [(d, f, t) for d, fs in docs.items() for f, t in fs]
    index = search.build_index(_fields(spark, rows))
    search.write_index(index, str(tmp_path / "ix"))
    index = search.read_index(spark, str(tmp_path / "ix"))
    got = {r.doc: r.score for r in search.score(index, search.expand_queries(_queries(spark, "widget factory"), expand=False)).collect()}

    weight = {"title": 3.0, "tags": 2.0, "description": 1.2, "url": 0.6}
    stemmed = {"tools": ["tool"], "thing": []}
    toks = {d: [(f, x) for f, t in fs for w in t.split() for x in [w, *stemmed.get(w, [])]] for d, fs in docs.items()}
    avg = sum(len(t) for t in toks.values()) / 3
    want = {}
    for d, t in toks.items():
        total, hit = 0.0, 0
        for q in ("widget", "factory"):
            df = sum(any(x == q for _, x in u) for u in toks.values())
            tf = sum(weight[f] for f, x in t if x == q)
            if tf:
                hit += 1
                total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.4 + 0.6 * len(t) / avg))
        if hit:
            want[d] = total * (0.55 + 0.45 * hit / 2)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_dead_entries_sink_but_stay(spark):
    head = spark.createDataFrame(
        [("dead.com", 1, ("dead",), [], None), ("live.com", 1, ("alive",), [], None), ("p.com", 1, ("alive",), ["private"], None)],
        "key string, mentions bigint, liveness struct<status:string>, flags array<string>, github struct<stars:bigint,archived:boolean>")
    index = search.build_index(_fields(spark, [(k, "title", "widget factory") for k in ("dead.com", "live.com", "p.com")]))
    scored = search.score(index, search.expand_queries(_queries(spark, "widget factory"))).join(search.prior(search.allowed(head)), "doc")
    got = search.top_k(scored.withColumn("score", F.col("score") * F.col("prior"))).orderBy("rank").collect()
    assert [r.doc for r in got] == ["live.com", "dead.com"]
    assert abs(got[0].score / got[1].score - 1.1 / 0.15) < 1e-9


def _tied(spark):
    """Documents of equal, nearly equal and different scores, with null ids, and queries that are copies, empty, null or bilingual."""
    rows = list(_mixed_fields(seed=9, docs=150)) + [(f"t{i:03}", "title", "w1 w2 same 设计") for i in range(60)]
    rows += [(None, "title", "w1 same"), ("n1", "title", None), ("n2", "title", "")]
    asked = [(f"q{i}", t) for i, t in enumerate(["w1 w2", "same", "w2 w1", "same", "设计灵感 w5", "", "absent", "w1 absent", "shaders w3 w4 w7 w9"])]
    asked = spark.createDataFrame([*asked, ("q1", "same w2"), (None, "w1")], "query_id string, query string")
    return search.build_index(_fields(spark, rows)), search.expand_queries(asked)


def test_search_by_many_tiles_and_blocks_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 300)
    monkeypatch.setattr(search, "TERMS", 4)
    index, terms = _tied(spark)
    whole = search.score(index, terms)
    for k, digits in ((5, 6), (5, 12), (70, 6)):
        rows = lambda df: {(r.query_id, r.doc, r.rank, round(r.score, 6)) for r in search.top_k(df.withColumn("score", F.round("score", digits)), k).collect()}
        assert rows(search.best_scores(index, terms, k)) == rows(whole)


def test_search_writes_no_pairs_of_queries_and_documents(spark, tmp_path, monkeypatch):
    fields = [(f"d{i:05}", "title", f"common words here {i}") for i in range(3000)]
    index = search.build_index(_fields(spark, fields))
    terms = search.expand_queries(_queries(spark, *[f"common words absent{i}" for i in range(400)]))
    most, cut = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: (made := cut(df), most.append(made.count()))[0])
    best = search.top_k(search.best_scores(index, terms, 3), 3)
    assert {(r.doc, r["rank"]) for r in best.collect()} == {(f"d{i:05}", i + 1) for i in range(3)} and best.count() == 1200
    assert max(most) < 20_000  # of 1,200,000 pairs
