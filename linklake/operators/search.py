"""Batch keyword search: an inverted index and BM25 over weighted fields, with exact top-k search by tiles.

The index keeps the weighed counts of terms in documents; what depends on a document's length or a term's rarity alone stands
in a table of documents and one of terms, so that the postings meet neither before a search has chosen among them.
A top-k search deals the postings of the asked terms into tiles of documents, and the distinct queries into blocks, each of
a bounded size and one row. Every tile meets every block; a pair is scored in memory, and only what can be among the best of a
query leaves it. So what is written grows with the index and the queries, not with the pairs of a query and a document
that share a word. Results are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import rules
from ..functions.text import explode_tokens
from ..session import cut_lineage
from .library import Library
from .skew import salted_join

FACT_FIELDS = {"name": "names", "tag": "tags", "section": "sections", "claim": "claims"}


#: About so many postings stand in a tile, and so many terms of queries in a block.
TILE = 500_000
TERMS = 100_000
#: Scores are compared after rounding to six digits, and sums differ in their last ones.
SLACK = 2e-6
#: A row holds a tile or a block, so few go to Python at once.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


@dataclass
class Index:
    """``postings(doc, term, tf)``, ``docs(doc, norm)`` and ``terms(term, df, idf)``.

    A term adds its idf and weight times ``impact`` of tf and norm to a score; ``norm`` is BM25's allowance for the length.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame

    @property
    def term_stats(self) -> DataFrame:
        return self.terms.select("term", "df")


def impact(tf: Column | np.ndarray, norm: Column | np.ndarray) -> Column | np.ndarray:
    return tf * (rules.BM25_K1 + 1) / (tf + norm)


def library_fields(library: Library, head: DataFrame) -> DataFrame:
    """Long form ``doc, field, text`` of a library; nothing is nested or concatenated."""
    c = F.col
    from_facts = library.facts.filter(c("kind").isin(list(FACT_FIELDS))).select(
        c("key").alias("doc"),
        F.create_map(*[F.lit(x) for kv in FACT_FIELDS.items() for x in kv])[c("kind")].alias("field"),
        c("value").alias("text"),
    )
    scalar = F.array(
        *[
            F.struct(F.lit(f).alias("field"), c(f).alias("text"))
            for f in ("key", "url", "title", "site_name", "description")
        ]
    )
    from_head = head.select(c("key").alias("doc"), F.explode(scalar).alias("f")).select("doc", "f.field", "f.text")
    return from_facts.unionByName(from_head.filter("text <> ''"))


def field_weight(field: Column) -> Column:
    out = F.lit(0.0)
    for name, w in rules.FIELD_WEIGHTS.items():
        out = F.when(field == name, F.lit(w)).otherwise(out)
    return out


def count_terms(fields: DataFrame) -> DataFrame:
    """``doc, term, tf, cnt``: weighed and plain counts, combined on the map side."""
    return explode_tokens(fields, "text", "term").groupBy("doc", "term").agg(
        F.sum(field_weight(F.col("field"))).alias("tf"), F.count("*").alias("cnt")
    )


def build_index(fields: DataFrame, n_docs: DataFrame | None = None) -> Index:
    """Index of ``doc, field, text``; its tables are written down once.

    ``n_docs`` (one row, column ``n``) counts documents without any token as well; by default
    only documents with text are counted.
    """
    c = F.col
    counts = cut_lineage(count_terms(fields))
    lengths = cut_lineage(counts.groupBy("doc").agg(F.sum("cnt").alias("len")))
    totals = lengths.agg(F.count("*").alias("n"), F.sum("len").alias("total")).first()
    n = totals.n if n_docs is None else n_docs.first().n
    n, average = F.lit(float(n)), F.lit((totals.total or 0) / max(n, 1))
    stats = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - c("df") + 0.5) / (c("df") + 0.5))
    k1, b = F.lit(rules.BM25_K1), F.lit(rules.BM25_B)
    docs = lengths.filter("doc IS NOT NULL").select("doc", (k1 * (1 - b + b * (c("len") / average))).alias("norm"))
    return Index(counts.filter("doc IS NOT NULL").select("doc", "term", "tf"), docs, cut_lineage(stats.withColumn("idf", idf).filter("idf > 0")))


def write_index(index: Index, path: str) -> None:
    """Persist the index once; postings lie in the order of terms, so a scan for a few terms prunes."""
    index.postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path + "/postings")
    index.docs.repartitionByRange("doc").write.mode("overwrite").parquet(path + "/docs")
    index.terms.repartitionByRange("term").write.mode("overwrite").parquet(path + "/terms")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "docs", "terms")])


def synonyms(spark: SparkSession) -> DataFrame:
    """``word, equiv`` of the fixed bilingual list, both directions within each group."""
    pairs = sorted({(a, b) for g in rules.EQUIVALENT_WORDS for a in g for b in g if a != b})
    return spark.createDataFrame(pairs, "word string, equiv string")


def expand_queries(queries: DataFrame, expand: bool = True, query: str = "query") -> DataFrame:
    """``query_id, term, weight``: typed terms at 1, terms of synonyms at a lower weight.

    Synonyms are looked up for one- and two-word latin phrases and CJK runs of the raw query, and
    for every typed term. A typed term is never overridden.
    """
    c = F.col
    q = queries.select("query_id", c(query).alias("text"))
    typed = explode_tokens(q, "text", "term").distinct().withColumn("weight", F.lit(1.0))
    if not expand:
        return typed
    raw = q.select(
        "query_id",
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+(?: [a-z]+)?|[一-鿿]+"), F.lit(0))).alias("word"),
    )
    looked_up = raw.unionByName(typed.select("query_id", c("term").alias("word"))).distinct()
    added = looked_up.join(F.broadcast(synonyms(queries.sparkSession)), "word").select("query_id", c("equiv").alias("text"))
    added = explode_tokens(added, "text", "term").withColumn("weight", F.lit(rules.SYNONYM_WEIGHT))
    return typed.unionByName(added).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def _asked(query_terms: DataFrame) -> DataFrame:
    """``query_id, n_typed, n_terms``."""
    return query_terms.groupBy("query_id").agg(F.count_if(F.col("weight") == 1.0).alias("n_typed"), F.count("*").alias("n_terms"))


def score(index: Index, query_terms: DataFrame) -> DataFrame:
    """``query_id, doc, score`` before priors, of every document that shares a term with a query.

    The postings join is salted: a frequent term is split over tasks, and the sum per (query, doc) combines on the map side.
    """
    c = F.col
    postings = index.postings.join(index.docs, "doc").select("doc", "term", impact(c("tf"), c("norm")).alias("impact"))
    hits = salted_join(postings, query_terms.join(index.terms, "term"), ["term"], spread=["doc"])
    sums = hits.groupBy("query_id", "doc").agg(
        F.sum(c("weight") * (c("idf") * c("impact"))).alias("raw"), F.count_if(c("weight") == 1.0).alias("typed_hit"), F.count("*").alias("hit")
    )
    cover = F.coalesce(F.try_divide(F.nullif(c("typed_hit"), F.lit(0)), c("n_typed")), c("hit") / c("n_terms"))
    met = salted_join(sums, _asked(query_terms), ["query_id"], spread=["doc"])
    return met.select("query_id", "doc", (c("raw") * (0.55 + 0.45 * cover)).alias("score"))


def best_scores(index: Index, query_terms: DataFrame, k: int, priors: DataFrame | None = None) -> DataFrame:
    """``query_id, doc, score``: scores times priors of the documents that are among a query's ``k`` best, by the score as
    it is or rounded to six digits.

    ``priors`` (doc, prior; a row per document) also says which documents count; all do without it.
    """
    c = F.col
    for name, value in BATCHES.items():
        query_terms.sparkSession.conf.set(name, value)
    query_terms = query_terms.filter("query_id IS NOT NULL").groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    query_terms = cut_lineage(query_terms)
    terms = cut_lineage(query_terms.select("term").distinct().join(index.terms, "term"))

    # queries of the same terms are worked on once
    lists = query_terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    same = lists.groupBy("terms").agg(F.min("query_id").alias("same"))
    lists = cut_lineage(lists.join(same, "terms").select("query_id", "same", "terms"))

    postings = index.postings.join(terms.select("term", "idf"), "term")
    docs = index.docs.withColumn("prior", F.lit(1.0)) if priors is None else index.docs.join(priors.filter("prior IS NOT NULL"), "doc")
    docs = docs.select("doc", "norm", c("prior").cast("double").alias("prior"))
    most = max(terms.agg(F.sum("df")).first()[0] or 0, index.docs.count())
    tiles = _tiles(postings.select("doc", "term", "idf", "tf"), docs, most // TILE + 1)
    alone = lists.filter("query_id = same").select("query_id", F.inline("terms"))
    blocks = _blocks(alone, alone.count() // TERMS + 1)

    schema = T.StructType([query_terms.schema["query_id"], index.postings.schema["doc"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                asked, doc, scored = _scored(one, k)
                made = [one["queries"].values.take(pa.array(asked)), one["docs"].values.take(pa.array(doc)), pa.array(scored)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    found = tiles.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(run, schema)
    orders = {"nth": c("score"), "nth_rounded": F.round("score", 6)}
    nth = {x: F.row_number().over(Window.partitionBy("query_id").orderBy(s.desc(), "doc")) for x, s in orders.items()}
    found = found.withColumns(nth).filter((c("nth") <= k) | (c("nth_rounded") <= k))
    found = cut_lineage(found.select(c("query_id").alias("same"), "doc", "score"))
    return lists.select("query_id", "same").join(found, "same").select("query_id", "doc", "score")


def _dealt(rows: DataFrame, key: str, n: int) -> GroupedData:
    """The rows in ``n`` groups by a hash of the key."""
    return rows.withColumn("group", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).groupBy("group")


def _tiles(postings: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """One row for each of ``n`` groups of documents, as ``_tile`` lays it out."""
    schema = T.StructType([T.StructField("docs", T.ArrayType(docs.schema["doc"].dataType)), T.StructField("words", WORDS)])
    schema = T.StructType(schema.fields + [T.StructField(x, T.BinaryType()) for x in ("first", "at", "impact", "prior")])
    arrow = to_arrow_schema(schema)

    def run(postings: pa.Table, docs: pa.Table) -> pa.Table:
        return _row(_tile(postings, docs), arrow)

    return cut_lineage(_dealt(postings, "doc", n).cogroup(_dealt(docs, "doc", n)).applyInArrow(run, schema))


def _blocks(asked: DataFrame, n: int) -> DataFrame:
    """One row for each of ``n`` groups of queries, as ``_block`` lays it out."""
    schema = T.StructType([T.StructField("queries", T.ArrayType(asked.schema["query_id"].dataType)), T.StructField("asked_words", WORDS)])
    schema = T.StructType(schema.fields + [T.StructField(x, T.BinaryType()) for x in ("start", "word", "weight")])
    arrow = to_arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        return _row(_block(group), arrow)

    return cut_lineage(_dealt(asked, "query_id", n).applyInArrow(run, schema))


WORDS = T.ArrayType(T.StringType())


def _row(made: dict, schema: pa.Schema) -> pa.Table:
    """One row; numbers lie side by side in bytes."""
    return pa.Table.from_arrays([_one(made[f.name], f.type) for f in schema], schema=schema)


def _one(value: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    if isinstance(value, np.ndarray):
        return pa.array([value.tobytes()], kind)
    return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value).cast(kind)


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order, and the place of each row's value among them."""
    values = pc.unique(column)
    values = values.take(pc.sort_indices(values))
    return values, pc.index_in(column, values).to_numpy()


def _tile(postings: pa.Table, docs: pa.Table) -> dict:
    """Postings by term: those of ``words[i]`` start at ``first[i]``; ``at`` are places among ``docs``, which are in order."""
    docs = docs.filter(pc.is_in(docs["doc"], pc.unique(postings["doc"]))).combine_chunks().sort_by("doc")
    postings = postings.filter(pc.is_in(postings["doc"], docs["doc"]))
    ids = pa.concat_arrays(docs["doc"].chunks) if docs.num_rows else pa.array([], docs["doc"].type)
    at = pc.index_in(postings["doc"], ids).to_numpy()
    words, word = _numbered(postings["term"])
    order = np.lexsort((at, word))
    first = np.searchsorted(word[order], np.arange(len(words) + 1)).astype(np.int64)
    shares = postings["idf"].to_numpy() * impact(postings["tf"].to_numpy(), docs["norm"].to_numpy()[at])
    return {"docs": ids, "words": words, "first": first, "at": at[order].astype(np.int32), "impact": shares[order], "prior": docs["prior"].to_numpy()}


def _block(group: pa.Table) -> dict:
    """Terms by query: those of ``queries[i]`` start at ``start[i]``; ``word`` are places among ``asked_words``."""
    queries, query = _numbered(group["query_id"])
    words, word = _numbered(group["term"])
    order = np.lexsort((word, query))
    start = np.searchsorted(query[order], np.arange(len(queries) + 1))
    return {"queries": queries, "asked_words": words, "start": start.astype(np.int64), "word": word[order].astype(np.int32), "weight": group["weight"].to_numpy()[order]}


def _scored(pair: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and documents with their scores: all that can be among the ``k`` best of a query, and few others.

    Equal scores keep their first ``k`` documents, others all that rounding could bring level with the k-th.
    """
    numbers = lambda name, kind: np.frombuffer(pair[name].as_buffer(), kind)
    first, at, impact, prior = numbers("first", np.int64), numbers("at", np.int32), numbers("impact", np.float64), numbers("prior", np.float64)
    start, word, weight = numbers("start", np.int64), numbers("word", np.int32), numbers("weight", np.float64)
    known = pc.fill_null(pc.index_in(pair["asked_words"].values, pair["words"].values), -1).to_numpy()[word]
    raw, hit, typed_hit = np.zeros(len(prior)), np.zeros(len(prior), np.int32), np.zeros(len(prior), np.int32)
    asked, docs, scores = [], [], []
    for q in range(len(start) - 1):
        own = slice(start[q], start[q + 1])
        here, weights = known[own], weight[own]
        used = np.flatnonzero(here >= 0)
        if not len(used):
            continue
        typed = weights == 1.0
        raw[:], hit[:], typed_hit[:] = 0, 0, 0
        for i in used:
            places = slice(first[here[i]], first[here[i] + 1])
            raw[at[places]] += weights[i] * impact[places]
            (typed_hit if typed[i] else hit)[at[places]] += 1
        np.add(hit, typed_hit, out=hit)
        found = np.flatnonzero(hit)
        cover = np.where(typed_hit[found] > 0, typed_hit[found] / max(1, typed.sum()), hit[found] / len(weights))
        score = raw[found] * (0.55 + 0.45 * cover) * prior[found]
        if len(score) > k:
            best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - SLACK)
            best = best[np.argsort(-score[best], kind="stable")]
            new = np.append(True, score[best][1:] != score[best][:-1])
            nth = np.arange(len(best)) - np.maximum.accumulate(np.where(new, np.arange(len(best)), 0))
            best = best[nth < k]
            found, score = found[best], score[best]
        asked.append(np.full(len(found), q))
        docs.append(found)
        scores.append(score)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *asked]), np.concatenate([none, *docs]), np.concatenate([np.zeros(0), *scores])


def prior(head: DataFrame) -> DataFrame:
    """``doc, prior``: bounded quality signals that cannot outvote relevance."""
    c = F.col
    m = F.greatest(F.coalesce("mentions", F.lit(1)), F.lit(1))
    stars = F.coalesce("github.stars", F.lit(0))
    p = 1 + F.least(F.log2(m), F.lit(3.0)) * 0.18
    p = p * F.when(stars > 0, 1 + F.least(F.log10(stars + 1) / 5, F.lit(0.35))).otherwise(1.0)
    p = p * F.when(c("liveness.status") == "dead", 0.15).when(c("liveness.status") == "unknown", 0.75).when(
        c("liveness.status") == "blocked", 0.9
    ).when(c("liveness.status") == "alive", 1.1).otherwise(1.0)
    p = p * F.when(c("github.archived"), 0.8).otherwise(1.0)
    p = p * F.when(F.array_contains("flags", "legal_risk"), 0.9).otherwise(1.0)
    return head.select(c("key").alias("doc"), p.alias("prior"))


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` per query; Spark limits rows per query before the shuffle as well as after."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def allowed(head: DataFrame, include_private: bool = False, include_risky: bool = False, only_alive: bool = False) -> DataFrame:
    """Resources a caller may see. Applied after scoring, so statistics stay those of all documents."""
    keep = head
    if not include_private:
        keep = keep.filter(~F.array_contains("flags", "private"))
    if not include_risky:
        keep = keep.filter(~F.array_contains("flags", "legal_risk"))
    if only_alive:
        keep = keep.filter("liveness.status = 'alive'")
    return keep


def search_library(
    library: Library, head: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, **filters
) -> DataFrame:
    """``query_id, rank, doc, score`` over a library with priors and visibility filters."""
    index = index or build_index(library_fields(library, head), head.agg(F.count("*").alias("n")))
    return top_k(best_scores(index, expand_queries(queries), k, prior(allowed(head, **filters))), k)


def get_by_key(library: Library, head: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resources by key, else by an alias; private ones are never served. ``wanted`` has ``name``."""
    c = F.col
    alias = library.facts.filter("kind = 'alias'").groupBy(c("value").alias("name")).agg(F.min("key").alias("via"))
    direct = head.select(c("key").alias("name"), c("key").alias("own"))
    found = wanted.join(direct, "name", "left").join(alias, "name", "left")
    found = found.select("name", F.coalesce("own", "via").alias("key")).filter("key IS NOT NULL")
    return found.join(head.filter(~F.array_contains("flags", "private")), "key")


def browse(library: Library, head: DataFrame, section: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
    """Public resources by section substring and/or tag, most corroborated and starred first."""
    rows = allowed(head)
    if section:
        keys = library.facts.filter((F.col("kind") == "section") & F.col("value").contains(section)).select("key").distinct()
        rows = rows.join(keys, "key", "left_semi")
    if tag:
        keys = library.facts.filter((F.col("kind") == "tag") & (F.col("value") == tag)).select("key").distinct()
        rows = rows.join(keys, "key", "left_semi")
    return rows.orderBy(F.desc("mentions"), F.desc(F.coalesce("github.stars", F.lit(0))), "key").limit(limit)


def brief(library: Library, head: DataFrame, tags: int | None = None, claims: int | None = None) -> DataFrame:
    """Short view of each resource: name and description with fallbacks, all or the first ``tags`` and ``claims``."""
    c = F.col

    def firsts(kind, n=None):
        rows = library.facts.filter(c("kind") == kind)
        if n is not None:
            order = Window.partitionBy("key").orderBy("pos")
            rows = rows.withColumn("r", F.row_number().over(order)).filter(c("r") <= n)
        return rows.groupBy("key").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(kind)
        )

    out = head.join(firsts("section"), "key", "left").join(firsts("tag", tags), "key", "left").join(firsts("claim", claims), "key", "left")
    some = lambda *n: F.coalesce(*[F.when(c(x) != "", c(x)) for x in n])
    return out.select(
        "key", some("title", "first_name", "key").alias("name"), "url",
        some("description", "first_claim").alias("description"),
        c("section").alias("sections"), c("tag").alias("tags"),
        F.coalesce("liveness.status", F.lit("unchecked")).alias("status"), c("liveness.checked_at").alias("checked_at"),
        c("mentions").alias("sources"), c("github.stars").alias("stars"),
        F.when(F.size("flags") > 0, c("flags")).alias("flags"), c("claim").alias("claimed"),
    )


