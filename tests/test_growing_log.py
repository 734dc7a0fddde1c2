import io
import os

from linklake.sources import growing_log
from linklake.sources.growing_log import Gain


def test_splits_give_every_line_once():
    data = b"".join(b"x" * (i % 9) + b"%d\n" % i for i in range(300))
    whole = [(at, line) for at, line in growing_log.lines_between(io.BytesIO(data), Gain("f", 0, 0, len(data), len(data)))]
    assert b"".join(line + b"\n" for _, line in whole) == data and all(data[at : at + len(line)] == line for at, line in whole)
    begin = whole[7][0]
    for size in (1, 2, 5, 64, 1000):
        for piece in (1, 7, 4096):
            parts = [Gain("f", begin, a, min(a + size, len(data)), len(data)) for a in range(begin, len(data), size)]
            got = [x for p in parts[: 60] for x in growing_log.lines_between(io.BytesIO(data), p, piece)]
            until = parts[: 60][-1].stop
            assert got == [x for x in whole if begin <= x[0] < until]


def test_end_of_the_last_complete_line():
    for data, end in ((b"", 0), (b"abc", 0), (b"a\n", 2), (b"a\nbcdefgh", 2), (b"\n\n", 2)):
        for piece in (1, 3, 100):
            assert growing_log.last_line_end(io.BytesIO(data), len(data), piece) == end


def test_only_complete_new_lines_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    os.makedirs(folder / "deep" / "subagents")
    a, b = folder / "a.jsonl", folder / "deep" / "b.jsonl"
    (folder / "deep" / "subagents" / "c.jsonl").write_text("no\n")
    (folder / "d.txt").write_text("no\n")

    def run():
        lines = growing_log.growing_lines(spark, str(folder), splitBytes="4")
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").start()
        query.processAllAvailable()
        query.stop()
        return sorted((os.path.basename(r.file), r.pos, r.value) for r in spark.read.parquet(out).collect())

    a.write_text("one\ntwo\nthr")
    b.write_text("half")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with a.open("a") as f:
        f.write("ee\nfour")
    b.write_text("half done\n")
    expected = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("b.jsonl", 0, "half done")]
    assert run() == expected
    a.write_text("new\n")  # shorter: another file under the same name
    assert run() == sorted([*expected, ("a.jsonl", 0, "new")])
    assert run() == sorted([*expected, ("a.jsonl", 0, "new")])
