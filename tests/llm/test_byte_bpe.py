import hashlib
import json
import random
from array import array
from itertools import accumulate

import public_tokenizers
import pytest
import tiktoken
import xxhash

from linklake.llm import byte_bpe

from .helpers import awkward, awkward_rows, no_docs
from .test_tokens import odd_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), array("I", ids).tobytes(), library.decode_bytes(ids)


def hard_texts():
    rng = random.Random(8)
    texts = odd_texts(150)
    texts += ["".join(rng.choice(" \n\t'sdtrem.,abANanÉ1 9中ж") for _ in range(120)) for _ in range(300)]
    texts += ["".join(rng.choice(w) for _ in range(200)) for w in ("an", "aba", "na ", "hello", "=-", "0123", "的一是") for _ in range(5)]
    texts += ["x" * 70_000, "ab" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(20_000)), "中文" * 2000, " " * 5000, "\n" * 999]
    texts += [" a", "a ", "a  b", "a \n b", "\x1c \x1d a", " ", "<|endoftext|>", "it's I'LL we've"]
    return texts


def test_encoding_matches_the_library(spark, library):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in byte_bpe.encoded(docs, RANKS, PATTERN, ["doc_id"], most=20_000).collect():
        assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == expected(library, texts[r.doc_id])


def test_every_character_is_cut_as_in_the_library(library):
    own = byte_bpe.cutter(RANKS, PATTERN)
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for mark in ("a{}b", " {}", "{} 1"):
        text = "\n".join(mark.format(c) for c in letters)
        cut = [w for s in own.stretches(text) for w in own.words(s)]
        ids = [i for w in cut for i in library.encode_ordinary(w)]
        assert "".join(cut) == text and ids == library.encode_ordinary(text)


def test_digests_of_awkward_rows(spark, library):
    made = []
    for i, text, *_ in awkward_rows():
        n, ids, decoded = expected(library, text)
        made.append((i, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    got = [tuple(r) for r in byte_bpe.digests(awkward(spark), RANKS, PATTERN, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(made, key=str)
    assert byte_bpe.digests(no_docs(spark), RANKS, PATTERN, ["doc_id"]).collect() == []


def test_kept_columns_may_clash(spark):
    rows = spark.createDataFrame([("t", "The end", 1, "w")], "text string, ids string, docs int, words string")
    row = byte_bpe.digests(rows, RANKS, PATTERN, ["docs", "words", "ids"], text="ids").first()
    assert (row.docs, row.words, row.ids, row.n_tokens) == (1, "w", "The end", 2)


def test_unreachable_tokens_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    assert byte_bpe.unreachable(ranks) == {b"abcd"}


def test_the_rank_map_gives_nothing_for_other_pairs():
    """A pair that isn't in its bucket may not be found where a pair and the token it makes, or two entries, meet."""
    ranks, found = byte_bpe.read_ranks(RANKS), json.loads(byte_bpe.literal(RANKS))
    alone = byte_bpe.touchy(ranks)
    letters = {rank: byte_bpe.letter(rank, rank in alone) for rank in ranks.values()}
    made = {letters[a] + letters[b]: letters[c] for a, b, c in byte_bpe.splits(ranks)}
    known = set(letters.values())
    for at, bucket in enumerate(found["merges"]):
        for pair in map("".join, zip(bucket, bucket[1:], strict=False)):
            if known.issuperset(pair) and xxhash.xxh64_intdigest(pair.encode(), 42) % byte_bpe.BUCKETS == at:
                assert made[pair]
    assert [*found["first"]] == [made.get(a + b, byte_bpe.NONE) for a in found["bytes"] for b in found["bytes"]]


def test_both_folds_match_the_library(spark, library, monkeypatch):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for most in (2, 1 << 20):
        monkeypatch.setattr(byte_bpe, "SHORT", most)
        some = docs.filter("length(text) < 1000")
        for r in byte_bpe.encoded(some, RANKS, PATTERN, ["doc_id"]).collect():
            assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == expected(library, texts[r.doc_id])


def test_a_block_holds_numbers_only(library):
    """What a block holds of a stretch is one entry and four bytes a word and a text's place, and plain letters are cut as by the pattern."""
    own = byte_bpe.cutter(RANKS, PATTERN)
    texts = [*hard_texts(), None, "Ärger über ºª straße ǆ the end", " déjà vu"]
    block = byte_bpe.Block(own)
    block.add(texts)
    assert isinstance(block.places, array) and isinstance(block.counts, array) and sum(block.counts) == len(block.places)
    words, ends = list(block.words), [0, *accumulate(block.counts)]
    for text, places in zip(texts, block.texts, strict=True):
        made = [words[p] for i in places for p in block.places[ends[i] : ends[i + 1]]]
        assert b"".join(made) == (text or "").encode()
        assert made == [p for w in own.words(text or "") for p in own.parts(w.encode())]


def test_letters_are_cut_by_the_pattern_unless_it_takes_them_whole():
    assert byte_bpe.Cutter(RANKS, PATTERN).plain(" word")
    for other in (r"\p{L}| ?\p{L}+|\s+", r"[a-z]| ?\p{L}+|\s", r".", PATTERN.replace(r" ?\p{L}+", r"\p{L}+")):
        assert byte_bpe.Cutter(RANKS, other).plain(" word") is None


def test_stretches_of_one_word_are_that_word(spark):
    """Only stretches of several words are joined for themselves; words come by their letters and the pairs of their bytes."""
    texts = ["the end, the end", "of the, end.\n", "", None, "né"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    block = byte_bpe.blocks(docs, RANKS, PATTERN, ["doc_id"], "text", 1 << 20).first()
    letters = {x: b for b, x in enumerate(json.loads(byte_bpe.literal(RANKS))["bytes"])}
    words = [bytes(letters[x] for x in w.state) for w in block.words]
    assert [w.pairs for w in block.words] == [[a * 256 + b for a, b in zip(w, w[1:], strict=False)] for w in words]
    assert [[words[p] for p in s] for s in block.stretches] == [[b" end", b","], [b" the", b","], [b" end", b".", b"\n"]]
    known = [*words, *[b"".join(words[p] for p in s) for s in block.stretches]]
    assert [b"".join(known[p] for p in d.places) for d in block.docs] == [(x or "").encode() for x in texts]


def test_letters_and_marks_are_cut_by_the_pattern():
    own = byte_bpe.Cutter(RANKS, PATTERN)
    for text in (" end.", "it's", " it's", "end'", " a'!?", "x_y", "x_", " né~`", "a\x7f", "É<|>", " the."):
        found = own.plain(text)
        assert found is None or [x for x in found.groups() if x] == own.words(text)
    assert own.plain(" end.").groups() == (" end", ".") and own.plain("x_y") is None
    for other in (PATTERN.replace("'s", "'!"), PATTERN.replace(r" ?\p{N}+|", "")):
        assert byte_bpe.Cutter(RANKS, other).plain(" end.") is None and byte_bpe.Cutter(RANKS, other).plain(" end")


def test_spaces_are_cut_first_unless_white_space_stands_before_one():
    own = byte_bpe.Cutter(RANKS, PATTERN)
    for text in ("a b\nc", "a\0 b", "a\tb c", "é b\x1cc d"):
        assert own.stretches(text) == [x if i == 0 else " " + x for i, x in enumerate(text.split(" "))]
    for text in (" a", "a ", "a  b", "a\n b", "a\t b", "a\x1c b", "a\u2003 b\n", " ", "\n c"):
        assert own.stretches(text) == [text]
