import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations, permutations

import public_tokenizers
from tokenizers import Tokenizer

from linklake.llm import packing
from linklake.llm.words import Recalled

from .helpers import awkward, awkward_rows, no_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected_pieces(rows, length):
    lib = Tokenizer.from_file(PATH)
    out = Counter()
    for i, text, *_ in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            out[i, k, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    return out


def check_sequences(rows, length):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append(r)
    for some in held.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(held)


def test_pieces_match_the_library(spark):
    for length in (4096, 64):
        rows = packing.pack_documents(awkward(spark), PATH, ["doc_id"], length=length).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(awkward_rows(), length)
        check_sequences(rows, length)


def test_ids_are_kept_on_demand(spark):
    rows = packing.pieces(awkward(spark), PATH, ["doc_id"], with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_no_documents(spark):
    assert packing.pack_documents(no_docs(spark), PATH, ["doc_id"]).collect() == []


def test_many_groups_leave_one_underfull_bin(spark):
    rng = random.Random(4)
    lengths = [min(4096, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(items, group=500).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(lengths))
    assert check_sequences(rows, 4096) <= -(-sum(lengths) // 4096) + 12


def test_search_empties_bins():
    # best fit leaves three bins where two suffice: 5+5, 4+3+3 need the exchange of two for one
    lengths, size = [5, 4, 3, 3, 5], 10
    bins = [[0, 1], [4, 2], [3]]
    found = packing.local_search([list(b) for b in bins], lengths, size)
    assert len(found) == 2
    assert sorted(k for b in found for k in b) == list(range(5))


def test_search_never_lowers_squared_fill():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randint(1, 60) for _ in range(60)]
        start = packing.best_fit(lengths, 100)
        rng.shuffle(start)
        found = packing.local_search([list(b) for b in start], lengths, 100)
        square = lambda bins: sum(sum(lengths[k] for k in b) ** 2 for b in bins)
        assert square(found) >= square(start) and len(found) <= len(start)
        assert sorted(k for b in found for k in b) == list(range(60))
        assert all(sum(lengths[k] for k in b) <= 100 for b in found)


def long_lengths(n):
    rng, lengths = random.Random(1), []
    while len(lengths) < n:
        x = int(900 + rng.expovariate(1 / 780))
        if x <= 4000:
            lengths.append(x)
    return lengths


def test_long_documents_are_searched_to_the_end():
    # best fit needs 2,498 sequences and a search cut after 30,000 looks hardly fewer; the lower bound is 2,378
    lengths = long_lengths(6000)
    found = packing.packed(lengths)
    assert sorted(k for b in found for k in b) == list(range(6000))
    assert all(sum(lengths[k] for k in b) <= 4096 for b in found)
    assert len(found) <= 2420


def test_no_exchange_is_left_that_gains():
    def sums(held, lengths):
        return {sum(lengths[k] for k in some) for n in (0, 1, 2) for some in combinations(held, n)}

    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randint(20, 70) for _ in range(80)]
        found = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        if len(found) == -(-sum(lengths) // 100):
            continue
        fills = [sum(lengths[k] for k in b) for b in found]
        for e, b in permutations(range(len(found)), 2):
            if fills[b] >= fills[e]:
                assert not any(0 < t - y <= 100 - fills[b] for t in sums(found[e], lengths) for y in sums(found[b], lengths))


def test_groups_stay_bounded_where_no_bin_fills_up(spark, monkeypatch):
    """Pieces of just over half a sequence never share one: every one is a bin, and no task sees more than a group."""
    items = spark.createDataFrame([(i % 7, 2100) for i in range(9000)], "doc_id long, length long")
    jobs = []
    keep = packing._packer
    monkeypatch.setattr(packing, "_packer", lambda turn, last, size, schema: jobs.append(last) or keep(turn, last, size, schema))
    made = packing.pack(items, group=500)
    assert made.count() == 9000 and made.select("sequence_id").distinct().count() == 9000
    assert jobs == [False]  # one round, and not a last group of everything


def test_columns_of_the_same_names(spark):
    items = spark.createDataFrame([(1, 5, 9, 9, "f")], "doc_id long, length long, sequence_id long, offset long, full string")
    (row,) = packing.pack(items).collect()
    assert (row.doc_id, row.length, row.offset, row.full) == (1, 5, 0, "f")


def test_pieces_are_worked_out_once_while_they_keep_coming():
    """Frequent pieces outlast any number of rare ones, a word serves all pieces that hold it, and what is kept is bounded."""
    held = Recalled(PATH, packing.id_bytes(PATH).encode, most=50)
    worked_out, encode = Counter(), held.encode
    held.encode = lambda p: worked_out.update([p]) or encode(p)
    lib = Tokenizer.from_file(PATH)
    for k in range(200):
        text = "common words stay " + " ".join(f"rare{k}x{j}" for j in range(20))
        assert held.joined(text) == array("I", lib.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(held) + len(held.old) <= 2 * (50 + 23)
    assert worked_out["common"] == worked_out["words"] == 1 and worked_out["rare3x3"] == 1


def test_long_pieces_are_forgotten_by_their_size():
    held = Recalled(PATH, lambda p: b"v", most=1000, long=5000)
    for k in range(50):
        held.joined("é中" + "x" * 900 + str(k))
        assert sum(len(p) for p in held if len(p) > 64) <= 5000 + 1000
    assert not any(len(p) > 64 for p in held.old)


def test_words_of_pieces_in_letters_and_marks():
    lib = Tokenizer.from_file(PATH)
    pieces = [a + b for a in ("The", "end", "it's", "I'LL", "x", "ÜBER", "naïve", "a1", "_", "") for b in (".", ",", ";", ":", "!", "?", ")", "'", "...", "_", "1.", "")]
    for p in filter(None, pieces):
        assert packing.id_bytes(PATH)[p] == array("I", lib.encode(p, add_special_tokens=False).ids).tobytes(), p
    odd = ["<|", "<|endoftext|>", "a<|endoftext|>b.", "<|startoftext|>.", "<|>"]
    for t in odd:
        assert packing.id_bytes(PATH).joined(t) == array("I", lib.encode(t, add_special_tokens=False).ids).tobytes()
