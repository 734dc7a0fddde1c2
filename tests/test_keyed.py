import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linklake.operators.memory import LinkBook
from linklake.operators.recall import link_terms, rare_link_terms
from linklake.streaming import keyed
from linklake.streaming.word_table import WordTable

DAY = datetime(2024, 3, 1)
CANDIDATES = "msg_id bigint, session string, key string, rank int, at timestamp"


def _run(spark, stream, out):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_link_is_shown_once_per_session(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda m: DAY + timedelta(minutes=m)
    first = [(1, "s", k, i + 1, at(1)) for i, k in enumerate("abcd")] + [(2, "s", "a", 1, at(2)), (2, "s", "d", 2, at(2))]
    first += [(3, None, "a", 1, at(3)), (4, None, "a", 1, at(4)), (9, "t", "a", 1, at(9))]
    later = [(5, "s", "d", 1, at(5)), (5, "s", "e", 2, at(5)), (6, "t", "b", 1, at(10)), *first[:4]]  # message 1 comes again
    for rows in (first, later):
        spark.createDataFrame(rows, CANDIDATES).write.mode("append").parquet(folder)
        _run(spark, keyed.shown_once(spark.readStream.schema(CANDIDATES).parquet(folder)), out)
    got = sorted((r.msg_id, r.key, r.rank) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "d", 1), (3, "a", 1), (4, "a", 1), (5, "e", 1), (6, "b", 1), (9, "a", 1)]


def test_staleness_is_the_same_however_fetches_land(spark, tmp_path):
    schema = "key string, checked_at timestamp"
    day = lambda n: DAY + timedelta(days=n)
    fetched = [("a", day(0)), ("a", day(3)), ("a", day(20)), ("b", day(1)), ("b", day(8)), ("c", day(19)), (None, day(2)), ("d", None)]
    expected = {("a", day(3)), ("a", day(20)), ("b", day(8)), ("c", day(19))}
    for n, cuts in enumerate(([99], [2, 10, 99])):
        folder, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        low = -99
        for cut in [*cuts, 999]:
            rows = [r for r in fetched if low <= (0 if r[1] is None else (r[1] - DAY).days) < cut] if cut < 999 else [("end", day(60))]
            low = cut
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            stale = keyed.stale_resources(spark.readStream.schema(schema).parquet(folder))
            _run(spark, stale, out)
        got = spark.read.parquet(out).collect()
        assert sorted((r.key, r.checked_at) for r in got) == sorted(expected)
        assert all(r.due_at == r.checked_at + timedelta(days=7) for r in got)


def test_word_table_equals_the_book_after_any_landings(spark, tmp_path):
    rng = random.Random(2)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(4) for j in range(3)]
    said = [(f"k{rng.randint(0, 14)}", " ".join(rng.sample(words, 3)) + " x" * rng.choice([0, 60]), DAY + timedelta(hours=rng.randint(0, 90)), "s", "p", i) for i in range(60)]
    notes = [(f"k{rng.randint(0, 17)}", rng.choice(words), DAY + timedelta(hours=rng.randint(0, 90))) for _ in range(12)]
    empty = LinkBook.empty(spark)
    book = LinkBook(
        spark.createDataFrame([(f"k{i}", "u", DAY, words[i % 12] if i % 2 else None, None) for i in range(18)], "key string, url string, first_seen timestamp, title string, text string").withColumn("topics", F.lit(None).cast("array<string>")),
        spark.createDataFrame(said, empty.said.schema), spark.createDataFrame(notes, empty.notes.schema))
    table = WordTable(spark, str(tmp_path / "words"))
    parts = 4
    for n in range(parts):
        mine = lambda df: df.filter(F.pmod(F.xxhash64(*df.columns[:3]), F.lit(parts)) == n)
        landing = LinkBook(mine(book.links), mine(book.said), mine(book.notes))
        table.land(landing, n)
        if n == 1:
            table.compact()
            table.land(landing, n)  # run again
    rows = lambda df: sorted(map(str, df.select("term", "key", "own_at", "body_at", "title_at", "common_from").collect()))
    expected = rows(rare_link_terms(link_terms(book)))
    assert rows(table.rare_terms()) == expected and len(expected) > 40
    table.compact()
    assert rows(table.rare_terms()) == expected
