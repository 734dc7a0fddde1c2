"""Packing documents into sequences of fixed length: best fit, then swap-based local search.

Documents are tokenized, those longer than a sequence are cut, and the pieces are dealt into groups of
bounded size. In a group, pieces go longest first into the fullest bin that takes them. Then a local
search works on the bins with free room: it moves one or two pieces, or exchanges one or two for one or
two, from the emptiest bin to a fuller one whenever the fuller one gains, which raises the sum of
squared fills, until no exchange gains or no fewer bins can hold the tokens. Bins that stay underfull are opened and their pieces
dealt anew among fewer groups, until a round closes few more. Groups never grow.

Defined results: a null or empty text is the end token alone. Repeated rows are packed as often as they
come. Null ids are carried along.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, map_rows
from .words import Recalled, library, words_of

LENGTH = 4096
END_ID = 1
GROUP = 20_000  # pieces a task packs at a time
DEALT, FULL, ROW = "_packing_group", "_packing_full", "_packing_row"
MARKS = frozenset(".,;:!?)")  # after letters, one of these is a word of its own
OPEN = 0.98  # bins filled less are packed again with those of other groups


# --- tokenizing and cutting --------------------------------------------------------------


@lru_cache(maxsize=2)
def id_bytes(path: str) -> Recalled:
    """Gives each piece of text its ids by the tokenizers library, as little-endian unsigned 32-bit integers."""
    model = library(path).model

    def encode(piece: str) -> bytes:
        if piece in held.special:
            return array("I", [held.special[piece]]).tobytes()
        plain = piece.isascii()
        if plain and piece.isalpha():
            words = [piece.lower()]
        elif plain and piece[-1] in MARKS and piece[:-1].isalpha():
            words = [piece[:-1].lower(), piece[-1]]
        else:
            words = words_of(piece, path)
        if plain and words != [piece]:  # words in ASCII are pieces themselves, and one word serves many pieces
            return b"".join([held[w] for w in words])
        return array("I", [t.id for w in words for t in model.tokenize(w)]).tobytes()

    held = Recalled(path, encode)
    return held


PIECE = [
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]
IDS = T.StructField("ids", T.BinaryType())


def pieces(docs: DataFrame, path: str, keep: list[str], text: str = "text", length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``length``: ``keep`` columns, piece, start, length, ids_crc32 (and the ids)."""
    end = array("I", [end_id]).tobytes()
    fields = PIECE + [IDS] * with_ids

    def run(texts: list) -> tuple[list[int], dict[str, list]]:
        held, places = id_bytes(path), []
        made: dict[str, list] = {f.name: [] for f in fields}
        for row, text in enumerate(texts):
            ids = held.joined(text) + end
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                places.append(row)
                made["piece"].append(k)
                made["start"].append(at // 4)
                made["length"].append(len(part) // 4)
                made["ids_crc32"].append(zlib.crc32(part))
                if with_ids:
                    made["ids"].append(part)
        return places, made

    return map_rows(docs, run, [text], keep, fields)


# --- packing one group -------------------------------------------------------------------


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that takes it: places of the pieces of each bin."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free room
    frees: list[int] = []  # the free rooms that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        at = bisect_left(frees, n)
        if at == len(frees):
            b, free = len(bins), size
            bins.append([])
        else:
            free = frees[at]
            b = rooms[free].pop()
            if not rooms[free]:
                del frees[at]
        bins[b].append(i)
        left = free - n
        if left:
            if not rooms[left]:
                insort(frees, left)
            rooms[left].append(b)
    return bins


def _sums(held: list[int], lengths: list[int]) -> dict[int, tuple[int, ...]]:
    """The different sums of one or two pieces of a bin, each with the places of such pieces."""
    alike: dict[int, list[int]] = {}
    for k in held:
        alike.setdefault(lengths[k], []).append(k)
    found = {n: (some[0],) for n, some in alike.items()}
    for n, some in alike.items():
        if len(some) > 1:
            found.setdefault(2 * n, (some[0], some[1]))
        for m, others in alike.items():
            if m < n:
                found.setdefault(n + m, (some[0], others[0]))
    return found


class _Sums:
    """Every sum of no, one or two pieces of every bin with free room, in flat arrays.

    ``least``: the sum; ``reach``: the sum and the bin's free room; ``fill`` and ``bin`` of its bin. The bin takes
    pieces of t tokens for these if ``least`` < t <= ``reach``. Entries of changed bins die (reach -1) until the next
    compaction.
    """

    def __init__(self, size: int) -> None:
        self.size, self.n, self.dead = size, 0, 0
        self.least, self.reach, self.fill = (np.zeros(1024, np.int16 if size < 1 << 14 else np.int64) for _ in range(3))
        self.bin = np.zeros(1024, np.int64)
        self.at: dict[int, slice] = {}

    def put(self, b: int, fill: int, sums: list[int]) -> None:
        self.drop(b)
        if fill in (0, self.size):
            return
        while self.n + len(sums) + 1 > len(self.least):
            for x in ("least", "reach", "fill", "bin"):
                setattr(self, x, np.concatenate([getattr(self, x), np.zeros_like(getattr(self, x))]))
        at = slice(self.n, self.n + len(sums) + 1)
        self.least[at] = [0, *sums]
        self.reach[at] = self.least[at] + (self.size - fill)
        self.fill[at], self.bin[at], self.at[b], self.n = fill, b, at, at.stop

    def drop(self, b: int) -> None:
        if at := self.at.pop(b, None):
            self.reach[at] = self.fill[at] = self.least[at] = -1
            self.dead += at.stop - at.start
            if self.dead > 1000 and 2 * self.dead > self.n:
                left = np.flatnonzero(self.fill[: self.n] >= 0)
                for x in ("least", "reach", "fill", "bin"):
                    getattr(self, x)[: len(left)] = getattr(self, x)[left]
                self.n, self.dead = len(left), 0
                starts = np.flatnonzero(np.r_[True, np.diff(self.bin[: self.n]) != 0]).tolist() if self.n else []
                self.at = {int(self.bin[i]): slice(i, j) for i, j in zip(starts, [*starts[1:], self.n])}

    def takers(self, e: int, fill: int, sums: list[int]) -> tuple[int, int, int] | None:
        """The exchange of pieces of ``e`` that raises squares most: sum given, bin that takes, sum given back."""
        least, reach, fills = self.least[: self.n], self.reach[: self.n], self.fill[: self.n]
        best, most = None, 0
        fuller = fills >= fill
        for t in sums:
            at = np.flatnonzero((least < t) & (reach >= t) & fuller)
            gain = t - least[at].astype(np.int64)
            worth = gain * (gain + fills[at] - fill) * (self.bin[at] != e)
            if len(at) and worth[i := int(worth.argmax())] > most:
                best, most = (t, int(self.bin[at[i]]), int(least[at[i]])), worth[i]
        return best

    def givers(self, b: int, fill: int, sums: list[int]) -> tuple[int, int, int] | None:
        """The exchange into ``b`` that raises squares most: sum given back, bin that gives, sum given."""
        least, fills, free = self.least[: self.n], self.fill[: self.n], self.size - fill
        best, most = None, 0
        emptier = (fills <= fill) & (fills >= 0)
        for t in (0, *sums):
            at = np.flatnonzero((least > t) & (least <= t + free) & emptier)
            gain = least[at].astype(np.int64) - t
            worth = gain * (gain + fill - fills[at]) * (self.bin[at] != b)
            if len(at) and worth[i := int(worth.argmax())] > most:
                best, most = (t, int(self.bin[at[i]]), int(least[at[i]])), worth[i]
        return best


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Raise the sum of squared fills by exchanges of up to two pieces for up to two, emptiest bin first.

    Ends when no exchange between any two bins gains, or with as few bins as the tokens need, below which no
    packing gets. Each bin is tried as giver, and a changed bin also as taker, against all others at once.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[k] for k in b) for b in bins]
    spare = sum(f > 0 for f in fill) - -(-sum(fill) // size)
    if spare <= 0:
        return [b for b in bins if b]
    index = _Sums(size)
    sums: dict[int, dict[int, tuple[int, ...]]] = {}

    def enter(b: int) -> None:
        sums[b] = _sums(bins[b], lengths) if 0 < fill[b] < size else {}
        index.put(b, fill[b], list(sums[b]))

    for b in range(len(bins)):
        enter(b)
    waiting = [(fill[b], b, False) for b in range(len(bins)) if sums[b]]
    heapify(waiting)
    while waiting and spare > 0:
        was, x, changed = heappop(waiting)
        if was != fill[x] or not sums[x]:  # it has changed since, and waits again
            continue
        if found := index.takers(x, fill[x], list(sums[x])):
            given, b, back = found
            e = x
        elif changed and (found := index.givers(x, fill[x], list(sums[x]))):
            back, e, given = found
            b = x
        else:
            continue
        there, home = sums[e][given], sums[b].get(back, ()) if back else ()
        bins[e] = [k for k in bins[e] if k not in there] + list(home)
        bins[b] = [k for k in bins[b] if k not in home] + list(there)
        fill[e] -= given - back
        fill[b] += given - back
        spare -= not bins[e]
        for y in (e, b):
            enter(y)
            if sums[y]:
                heappush(waiting, (fill[y], y, True))
    return [b for b in bins if b]


def packed(lengths: list[int], size: int = LENGTH) -> list[list[int]]:
    return local_search(best_fit(lengths, size), lengths, size)


# --- packing a table ---------------------------------------------------------------------


def _packer(turn: int, last: bool, size: int, schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_pylist()
        number = group[DEALT][0].as_py()
        rows, ids, offsets, full = [], [], [], []
        for b, held in enumerate(packed(lengths, size)):
            at = 0
            closed = last or sum(lengths[k] for k in held) >= OPEN * size
            for k in held:
                rows.append(k)
                ids.append((turn << 56) | (number << 24) | b)
                offsets.append(at)
                full.append(closed)
                at += lengths[k]
        made = group.drop_columns(DEALT).take(pa.array(rows, pa.int64()))
        columns = [*made.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(full, pa.bool_())]
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    return run


def pack(items: DataFrame, size: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``size``; columns of these names are replaced.

    Groups of about ``group`` rows are packed apart. What stays in underfull bins is dealt anew among fewer groups and packed
    again, as long as a round closes a tenth of the rows; then bins stay as they are. So no task ever holds more than a group.
    """
    names = [f.name for f in items.schema if f.name not in ("sequence_id", "offset")]
    number = T.StructField(ROW, T.LongType())
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(FULL, T.BooleanType())]
    out = T.StructType([items.schema[x] for x in names] + [number] + added)
    # a number of its own deals equal rows to different groups; it is written down, so that it stays the same
    rest = cut_lineage(items.select(*names, F.monotonically_increasing_id().alias(ROW)))
    done, turn, left = [], 0, rest.count()
    while True:
        groups = max(1, -(-left // group))
        dealt = rest.withColumn(DEALT, F.pmod(F.xxhash64(ROW, F.lit(turn)), F.lit(groups)).cast("int"))
        run = _packer(turn, groups == 1, size, to_arrow_schema(out))
        made = cut_lineage(dealt.groupBy(DEALT).applyInArrow(run, out))
        now = made.filter(~F.col(FULL)).count()
        over = not now or now > 0.9 * left
        done.append(made if over else made.filter(FULL))
        if over:
            break
        rest = made.filter(~F.col(FULL)).select(*names, ROW)
        left, turn = now, turn + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return whole.drop(FULL, ROW)


def pack_documents(docs: DataFrame, path: str, keep: list[str], text: str = "text", length: int = LENGTH) -> DataFrame:
    return pack(pieces(docs, path, keep, text, length), length)
