import hashlib
import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from linklake.llm import token_count, trie_bpe

from .helpers import awkward, awkward_rows, no_docs

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n):
    rng = random.Random(3)
    spans = [(32, 126), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x5FF), (0x1E00, 0x2FFF), (0x4E00, 0x4EFF), (0x1F600, 0x1F640)]
    return ["".join(chr(rng.randint(*rng.choice(spans))) if rng.random() < 0.8 else " " for _ in range(80)) for _ in range(n)]


def test_trie_encoding_matches_the_library():
    lib = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(5)
    texts = odd_texts(400) + [" ".join("".join(rng.choice("abthingerß'") for _ in range(rng.randint(1, 14))) for _ in range(200)) for _ in range(50)]
    for text, (ids, decoded) in zip(texts, trie_bpe.encode_texts(texts, WORD_BPE), strict=True):
        expected = lib.encode(text, add_special_tokens=False).ids
        assert array("I", ids).tolist() == expected
        assert decoded.decode() == lib.decode(expected, skip_special_tokens=False)


def test_pairs_agree_with_plain_merging():
    held = trie_bpe.merges(WORD_BPE)
    rng = random.Random(6)
    plain = [t for t, name in held.names.items() if not name.endswith("</w>") and "<" not in name]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(list(held.made))
        name = held.names[b]
        letters = (*name[:-5], name[-5:]) if name.endswith("</w>") else tuple(name)
        assert held.may_follow(a, b) == (held.merged((*held.names[a], *letters)) == [a, b])


def test_shared_prefixes_need_no_second_look():
    held = trie_bpe.Merges(WORD_BPE)
    words = ["interest", "interested", "interesting", "intern", "i"]
    found = held.encode(words)
    assert all(found[w] == held.merged((*w[:-1], w[-1] + "</w>")) for w in words)


def test_digests_of_awkward_rows(spark):
    lib = Tokenizer.from_file(WORD_BPE)
    expected = []
    for i, text, *_ in awkward_rows():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in trie_bpe.digests(awkward(spark), WORD_BPE, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert trie_bpe.digests(no_docs(spark), WORD_BPE, ["doc_id"]).collect() == []


def test_ids_and_decoded_text(spark):
    row = trie_bpe.encoded(spark.createDataFrame([(1, "The end.")], "doc_id long, text string"), WORD_BPE, ["doc_id"]).first()
    assert row.n_tokens == 3 and row.decoded == "the</w> end</w> .</w>"


def test_counts_match_the_unigram_model(spark):
    lib = Tokenizer(models.Unigram(token_count.vocabulary(PIECES), 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    texts = [*odd_texts(300), "", " ", "  ", "a", " a", "a  b ", "▁x▁▁y", "<s>hello</s> <0x41>", *(t or "" for _, t, *_ in awkward_rows())]
    assert token_count.count_texts(texts, PIECES) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = awkward(spark).select("doc_id", token_count.token_counts("text", PIECES).alias("n_tokens"))
    expected = [(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward_rows()]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(expected, key=str)
    assert no_docs(spark).select(token_count.token_counts("text", PIECES)).collect() == []


def test_ties_follow_the_library():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bab", -2.5), ("c", -1.5)]
    lib, own, rng = Tokenizer(models.Unigram(pieces, 0, False)), token_count.Counter(pieces), random.Random(7)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        assert own.count(word) == len(lib.encode(word).ids)


def test_memory_between_batches_holds_short_pieces_only():
    held = trie_bpe.coder(WORD_BPE)
    texts = ["👍 " + "word " * 500 + str(i) for i in range(20)] + ["x" * 5000]
    lib = Tokenizer.from_file(WORD_BPE)
    for text, (ids, _) in zip(texts, trie_bpe.encode_texts(texts, WORD_BPE), strict=True):
        assert array("I", ids).tolist() == lib.encode(text, add_special_tokens=False).ids
    held.learn([[]])
    assert max(map(len, held.known), default=0) <= 64
