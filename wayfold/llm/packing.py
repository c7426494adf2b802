"""Documents packed into training sequences of a fixed capacity.

Only the number of pieces of each length matters to a packing, and there are no more lengths than the capacity. So the plan is made from that histogram:
pieces above a third of the capacity are matched in pairs, each with the longest partner that still fits; shorter ones then go, longest first, into
the tightest gap that holds them. The plan is a bounded table of runs, and every piece finds its place in it by its length and
its rank among the pieces of that length. Ranks come from counts per task, so that no length passes through one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut
from .tokens import Encoder
from .words import give_back

PIECES = "task int, doc_id long, piece int, start long, length int, rank long, ids binary"
PLACE = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, n, sequence, each, at) that place all pieces of `histogram` (length: count).

    The pieces of a length with ranks first..first + n - 1 go to sequences from `sequence` on, `each` in every one, the first of them at `at`.
    The number of steps depends on the lengths that occur, not on the counts.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    left = {length: n for length, n in histogram.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, count) of the sequences that have it
    open_gaps: list[int] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, each: int, at: int) -> None:
        runs.append((length, used[length], n, sequence, each, at))
        used[length] += n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((sequence, n))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        k = bisect.bisect_right(large, capacity - length) - 1
        if k < 0:
            n = left[length]
            place(length, n, sequences, 1, 0)
            leave(capacity - length, sequences, n)
            used_up = {length}
        else:
            partner = large[k]
            n = left[length] // 2 if partner == length else min(left[length], left[partner])
            if n:
                place(length, n, sequences, 1, 0)
                place(partner, n, sequences, 1, length)
                leave(capacity - length - partner, sequences, n)
                left[length] -= n
                left[partner] -= n
            elif k:  # one piece of its own length is left; it goes with the next shorter one
                partner, n = large[k - 1], 1
                place(length, 1, sequences, 1, 0)
                place(partner, 1, sequences, 1, length)
                leave(capacity - length - partner, sequences, 1)
                left[length] -= 1
                left[partner] -= 1
            else:
                place(length, 1, sequences, 1, 0)
                leave(capacity - length, sequences, 1)
                left[length] -= 1
                n = 1
            used_up = {x for x in (length, partner) if not left[x]}
        sequences += n
        large = [x for x in large if x not in used_up]

    for length in sorted((x for x in histogram if histogram[x] and 3 * x <= capacity), reverse=True):
        n = histogram[length]
        while n:
            k = bisect.bisect_left(open_gaps, length)
            if k == len(open_gaps):
                each = capacity // length
                whole = n // each
                if whole:
                    place(length, whole * each, sequences, each, 0)
                    leave(capacity - each * length, sequences, whole)
                if rest := n - whole * each:
                    place(length, rest, sequences + whole, rest, 0)
                    leave(capacity - rest * length, sequences + whole, 1)
                sequences += whole + bool(rest)
                break
            gap = open_gaps[k]
            sequence, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(k)
            # The tightest gap stays the tightest while it holds more, so each sequence is filled before the next.
            each = gap // length
            whole = min(count, n // each)
            if whole:
                place(length, whole * each, sequence, each, capacity - gap)
                leave(gap - each * length, sequence, whole)
                n -= whole * each
            if whole < count:
                rest = min(n, each - 1)
                if rest:
                    place(length, rest, sequence + whole, rest, capacity - gap)
                    leave(gap - rest * length, sequence + whole, 1)
                    n -= rest
                leave(gap, sequence + whole + bool(rest), count - whole - bool(rest))
    return runs


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, block: int | None = None) -> DataFrame:
    """task, doc_id, piece, start, length, rank, ids (binary) of the pieces of every row of `docs` (doc_id, text), not yet placed.

    `rank` counts the pieces of a length in a task. What a document has beyond a whole number of `capacity` is its first piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, seen = TaskContext.get().partitionId(), Encoder(path, block), np.zeros(capacity + 1, np.int64)
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                stops = [*range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                start = 0
                for piece, stop in enumerate(stops):
                    length = stop - start
                    out.append((task, doc_id, piece, start, length, int(seen[length]), ids[start:stop].tobytes()))
                    seen[length] += 1
                    start = stop
                size += len(ids)
                if size > 1 << 19:
                    yield _rows(out)
                    out, size = [], 0
        if out:
            yield _rows(out)
        del encoder, out
        give_back()

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = ["task", "doc_id", "piece", "start", "length", "rank", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def _finder(runs: list[tuple[int, int, int, int, int, int]]):
    """A function of length and rank columns that gives the place of each piece, by bisection in the plan."""
    length, first, _, sequence, each, at = np.array(sorted(runs), np.int64).reshape(-1, 6).T
    keys = (length << 47) | first

    @pandas_udf(PLACE)
    def found(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        run = np.searchsorted(keys, (size << 47) | rank, side="right") - 1
        k = rank - first[run]
        return pd.DataFrame({"sequence_id": sequence[run] + k // each[run], "offset": at[run] + k % each[run] * size})

    return found


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` (task, rank, length and any other columns; a written table) with sequence_id and offset in place of task and rank."""
    counts = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    # At most `capacity` rows reach the driver, and the plan is bounded by them.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # One row per length and task; written, so that the join below is one of plain tables.
    bases = cut(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base")))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    # Length and rank alone go to Python; the ids stay where they are.
    places = _finder(plan(histogram, capacity))(F.col("length"), F.col("rank"))
    return ranked.withColumn("place", places).select("*", "place.*").drop("place", "rank")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, block: int | None = None) -> DataFrame:
    """Pieces of all `docs` (doc_id, text) with their places: doc_id, piece, start, length, ids, sequence_id, offset.

    A null or empty text is one piece, the end id. Repeated rows and null doc_ids are packed like any other row. An empty table gives no rows. Other columns
    are not read. `block` bounds the bytes of text a worker tokenises at a time (`tokens.BLOCK`).
    """
    return place(cut(cut_pieces(docs, path, end_id, capacity, block)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves, each of at most one capacity."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate("members", F.lit(b""), lambda a, m: F.concat(a, m["ids"]))
    return (
        packed.groupBy("sequence_id")
        .agg(members.alias("members"))
        .select("sequence_id", F.aggregate("members", F.lit(0), lambda a, m: a + m["length"]).alias("length"), joined.alias("ids"))
    )
