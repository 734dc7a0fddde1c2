"""A streaming source for logs that are still being written.

``growing_log`` is a Spark data source in Python: its offset is the byte after the last complete line of every file below a folder.
A trigger reads what files gained since the one before: only complete lines, a line still being written is left for
later, and a file that has become shorter is read from its start, as it is not the file the offset was taken from.
The driver looks at file sizes and at the end of files that changed; lines are read by tasks, large gains in splits.
Offsets live in the query's checkpoint, so a restarted query goes on where it was.

Paths are opened by pyarrow: local and mounted folders, or any store that it has a file system for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos bigint, value string"
SPLIT = 64 << 20
PIECE = 1 << 20


def _open(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Gain(InputPartition):
    """Lines of ``file`` that start at bytes from ``start`` up to ``stop``; ``begin`` starts a line, ``end`` ends one."""

    file: str
    begin: int
    start: int
    stop: int
    end: int


def last_line_end(handle, size: int, piece: int = PIECE) -> int:
    """The byte after the last newline, 0 if there is none; read backwards, so that no more than the last line is read."""
    at = size
    while at > 0:
        start = max(0, at - piece)
        handle.seek(start)
        found = handle.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def lines_between(handle, gain: Gain, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in a split; a line that crosses its end belongs to it whole."""
    at = gain.start
    rest = b""
    if gain.start > gain.begin:  # the line under way belongs to the split before, unless one starts here
        at = gain.start - 1
    handle.seek(at)
    skip = gain.start > gain.begin
    read = at
    while at < gain.stop:
        cut = rest.find(b"\n")
        while cut < 0:
            more = handle.read(min(piece, gain.end - read))
            if not more:
                return
            read += len(more)
            searched = len(rest)
            rest += more
            cut = rest.find(b"\n", searched)
        begin = 0
        while cut >= 0 and at < gain.stop:
            if skip:
                skip = False
            else:
                yield at, rest[begin:cut]
            at += cut + 1 - begin
            begin = cut + 1
            cut = rest.find(b"\n", begin)
        rest = rest[begin:]


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.without, self.split = options.get("without", "/subagents/"), int(options.get("splitBytes", SPLIT))
        self.ends: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = _open(self.path)
        out, ends = {}, {}
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix) or self.without in info.path:
                continue
            known = self.ends.get(info.path)
            if known is None or known[:2] != (info.size, info.mtime_ns):
                with store.open_input_file(info.path) as handle:
                    known = (info.size, info.mtime_ns, last_line_end(handle, info.size))
            ends[info.path] = known
            if known[2]:
                out[info.path] = known[2]
        self.ends = ends
        return out

    def partitions(self, start: dict, end: dict) -> list[Gain]:
        out = []
        for file, upto in sorted(end.items()):
            begin = start.get(file, 0)
            if upto < begin:
                begin = 0
            out += [Gain(file, begin, a, min(a + self.split, upto), upto) for a in range(begin, upto, self.split)]
        return out

    def read(self, partition: Gain) -> Iterator[tuple]:
        store, _ = _open(self.path)
        with store.open_input_file(partition.file) as handle:
            for at, line in lines_between(handle, partition):
                yield partition.file, at, line.decode("utf-8", "replace")


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def growing_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of ``file, pos, value``: every complete line of the logs below ``path``; ``pos`` is the byte a line starts at."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").options(path=path, **options).load()
