import corpus_pipeline
from linklake.llm import compression, gru_toxicity, packing, simhash
from linklake.llm.common import cut_lineage
from linklake.llm.queries import QUERIES

from .helpers import awkward, no_docs
from .test_packing import check_sequences
from .test_simhash import brute_components, brute_print

STAGE = dict(corpus_pipeline.STAGES)


def test_stages_take_awkward_rows(spark, data):
    for docs in (awkward(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = cut_lineage(stage(spark, docs, data))
            assert after.columns == docs.columns, name
            docs = after
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
        check_sequences(rows, packing.LENGTH)


def test_stages_do_what_their_operators_say(spark, data):
    import zstandard

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id for r in STAGE["quality rules"](spark, docs, data).collect()}
    squeeze = zstandard.ZstdCompressor(level=3).compress
    assert first == {i for i, t in texts.items() if compression.assess(t, compression.LIMITS, squeeze)[6]}
    second = {r.doc_id for r in STAGE["toxicity"](spark, docs, data).collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("toxic = 0").collect()}
    assert len(toxic & second) >= 0.95 * len(toxic & set(texts))
    third = {r.doc_id for r in STAGE["SimHash near-duplicates"](spark, docs, data).collect()}
    assert third == set(brute_components([(i, brute_print(t)) for i, t in texts.items()]))


def test_run_packs_what_the_stages_keep(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, data))
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    check_sequences(rows, packing.LENGTH)


def test_every_operator_has_its_query(spark, data):
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
    assert gru_toxicity.STRIDE < gru_toxicity.WINDOW and simhash.RADIUS == 4
    for name in ("op2_compression_bands", "op3_trie_bpe", "op6_token_counts"):
        assert QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
