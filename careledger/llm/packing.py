"""Best-fit packing of documents into sequences by exact-complement hashing.

Which lengths share a sequence depends only on how many pieces of each length there
are: at most ``capacity`` counts, whatever the input. The driver plans on those counts:

1. Longest first, the gap that a piece leaves is looked up among the lengths that are
   still there, then among the sums of two and of three of them. A hit is taken as often
   as the counts allow, which uses up at least one length, so there are few steps.
2. What no exact combination takes goes to the fullest sequence that still has room.

The plan says which ranks of a length go where, in runs of ranks. Each piece gets its rank
from a count per task and length, and finds its sequence and offset by a binary search
in the plan. So pieces are neither collected nor gathered by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.shared import cut, documents_of
from careledger.llm.tokens import word_tokenizer

Run = tuple[int, int]  # a length, how often it stands in the sequence
#: Texts that a task holds with their ids at a time, of the batch that Spark hands it.
_SLICE = 500


class _Lengths:
    """How many pieces of each length are left, and which sums they offer."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count

    def pair(self, total: int) -> tuple[int, ...] | None:
        """Two lengths with this sum, the pair of which most can be taken."""
        small = np.arange(1, total // 2 + 1)
        if not len(small):
            return None
        each = np.minimum(self.left[small], self.left[total - small])
        if total % 2 == 0:
            each[-1] = self.left[total // 2] // 2
        best = int(each.argmax())
        return (total - 1 - best, best + 1) if each[best] > 0 else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        there = np.flatnonzero(self.left[:gap])
        sums = np.zeros(gap + 1, bool)  # the sums of two lengths, shared by all third ones
        for length in there:
            sums[there[there <= gap - length] + length] = True
        for length in map(int, there[::-1]):
            if sums[gap - length]:
                self.left[length] -= 1  # a pair must not count this one again
                two = self.pair(gap - length)
                self.left[length] += 1
                if two:
                    return (length, *two)
        return None

    def take(self, lengths: tuple[int, ...]) -> tuple[list[Run], int]:
        runs = [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]
        times = min(int(self.left[x]) // n for x, n in runs)
        for x, n in runs:
            self.left[x] -= times * n
        return runs, times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[Run], int]]:
    """What stands in the sequences, and how many sequences are alike."""
    lengths = _Lengths(counts, capacity)
    out = []
    if lengths.left[capacity]:
        out.append(lengths.take((capacity,)))
    for length in range(capacity - 1, 0, -1):
        while lengths.left[length] > 0:
            lengths.left[length] -= 1  # the piece itself cannot fill its gap
            filler = lengths.exact(capacity - length)
            lengths.left[length] += 1
            if filler is None:
                break
            out.append(lengths.take((length, *filler)))
    return out + _best_fit(lengths.left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[Run], int]]:
    """Best-fit decreasing on counts; sequences that are alike are kept as one entry."""
    room: list[list[tuple[list[Run], int]]] = [[] for _ in range(capacity + 1)]

    def fill(runs: list[Run], free: int, times: int, length: int, count: int) -> int:
        """Puts pieces into ``times`` sequences with ``free`` room; how many are left over."""
        each = free // length
        full = min(times, count // each)
        if full:
            room[free - each * length].append(([*runs, (length, each)], full))
        rest = count - full * each
        if rest and full < times:
            some = min(rest, each)
            room[free - some * length].append(([*runs, (length, some)], 1))
            rest, full = rest - some, full + 1
        if full < times and runs:
            room[free].append((runs, times - full))
        return rest

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            free = next((r for r in range(length, capacity) if room[r]), None)
            if free is None:
                each = capacity // length
                count = fill([], capacity, -(-count // each), length, count)
            else:
                runs, times = room[free].pop()
                count = fill(runs, free, times, length, count)
    return [entry for entries in room for entry in entries]


def slots(packed: list[tuple[list[Run], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, pieces in a row, offset), in order of rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for runs, times in packed:
        offset = 0
        for length, n in runs:
            first = used.get(length, 0)
            rows.append((length, first, sequence, n, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's ids and ``end_id``, cut where longer than ``capacity``.

    ``nth`` counts the pieces of a length inside a task, from 0.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in (b.slice(at, _SLICE) for b in batches for at in range(0, b.num_rows, _SLICE)):
            rows = []
            for doc_id, ids in zip(
                batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist()), strict=True
            ):
                ids += end
                for piece, start in enumerate(range(0, len(ids), wide)):
                    own = ids[start : start + wide]
                    length = len(own) // 4
                    rows.append((doc_id, piece, start // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    texts = documents_of(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(cut_up, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed one by
    one. Other columns are not read; an empty table gives no rows. The texts are
    tokenized once; the table of pieces, some 50 bytes each, is written in between.
    """
    rows = cut(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    per_task = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One row per length at most.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    key = table[:, 0] * (1 << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            nth, each = rank - table[at, 1], table[at, 3]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(table[at, 2] + nth // each),
                    pa.array(table[at, 4] + nth % each * length),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # The pieces of a length in the tasks before this one: one row per task and length.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = rows.join(firsts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("first"))
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
