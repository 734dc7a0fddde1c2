import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import pytest

from linklake.llm import warc

PAGES = "page_id long, url string, html string, refers_to string, digest string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "r", "d", "p") for i, u, h in rows], PAGES).repartition(3)


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        holder = max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(data) >= 1000 and holder is not None and i != holder
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", holder if again else None))
    return Counter(out)


def test_round_trip(spark):
    rng, big = random.Random(1), "é" * 600
    rows = [(i, f"http://a.example/{i}?q=1#x y", "".join(rng.choice("<>abc \n") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "http://n.example/", "no id"), (102, "x", big), (103, "y", big), (104, "z\r\nEvil: 1", big), (None, "w", big)]
    rows += [(105, "t", big), (105, "t", big), (106, "u", "s" * 999), (107, "u", "s" * 999), (108, "v", "long " * 200_000), (None, "k", "q" * 2000), (None, "k", "q" * 2000)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_payloads_come_back(spark, tmp_path):
    rows = [(i, "http://a/", f"page {i} " * i) for i in range(20)]
    archives = warc.write_archives(warc.with_revisits(pages(spark, rows)), str(tmp_path), archive=500)
    listed = archives.collect()
    assert sum(a.n_records for a in listed) == 20 and len(listed) > 3
    got = warc.read_archives(archives, str(tmp_path), with_payload=True).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in got) == [(i, h) for i, _, h in rows]


def _archive(n):
    return b"".join(warc.record(i, "http://a/", f"<p>{i}</p>".encode() * 400, None if i % 3 else 7) for i in range(n))


def test_members_are_plain_gzip_and_chunks_do_not_matter(monkeypatch):
    data = _archive(6)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 6
    whole = list(warc.records(io.BytesIO(data).read, True))
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(warc, "CHUNK", size)
        assert list(warc.records(io.BytesIO(data).read, True)) == whole
    assert [r.page_id for r in whole] == list(range(6)) and whole[0].payload is None and whole[0].refers_to == 7


def test_damage_is_noticed():
    good = gzip.decompress(warc.record(1, "http://a/", b"payload " * 50))
    for bad in (good.replace(b"payload payload", b"payload paiload"), good[:-4], good.replace(b"Content-Length: 400", b"Content-Length: 399"), b"HTTP" + good):
        with pytest.raises(warc.BrokenArchive):
            list(warc.records(io.BytesIO(gzip.compress(bad)).read))
    with pytest.raises(warc.BrokenArchive):
        list(warc.records(io.BytesIO(_archive(2)[:-10]).read))
