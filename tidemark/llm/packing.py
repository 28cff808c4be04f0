"""Packing documents into fixed windows by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_rows, column, staged
from tidemark.llm.tokens import GROUP, encoder

CAPACITY = 1024
END_ID = 0
SPARE = 4  # tokens that a window may lack


def fill(counts: list[int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each whose sum comes closest to ``capacity`` from below.

    Bitset subset-sum: bit s of ``sums`` says that s can be reached. The copies of a length are added in
    groups of 1, 2, 4 ..., and the bitset before each group is kept, so the counts are found by going
    back through the groups. Stops early once the capacity is reached exactly.
    """
    sums, goal = 1, 1 << capacity
    mask = (goal << 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left, group = min(counts[length], capacity // length), 1
        while left:
            group = min(group, left)
            steps.append((length, group, sums))
            sums |= (sums << (length * group)) & mask
            left -= group
            group *= 2
        if sums & goal:
            break
    at = sums.bit_length() - 1
    taken: dict[int, int] = {}
    for length, group, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + group
            at -= length * group
    return taken


@dataclass(frozen=True)
class Slot:
    """Place of the items ``first`` and on, in the order of their numbers, of one length.

    The windows ``window`` and on hold ``each`` such items, from ``offset`` on. ``cuts`` is for items
    that are cut: (start, length, window, offset) of each part; the next item of this kind is
    ``stride`` windows further.
    """

    first: int
    each: int
    window: int
    offset: int
    stride: int = 1
    cuts: tuple[tuple[int, int, int, int], ...] = ()


def plan(counts: list[int], capacity: int, spare: int = SPARE) -> tuple[dict[int, list[Slot]], int]:
    """Slots of every length below ``capacity`` and the number of windows, from the histogram alone.

    The largest length left is placed, and ``fill`` picks what fills the rest of its window best; that
    pattern is repeated while the counts last. Each pattern uses up a length but for a few items, so
    the plan is of bounded size, whatever the number of items. Windows that lack more than ``spare`` tokens
    are cut into parts whose lengths are powers of two, which need no padding.
    """
    left = list(counts) + [0] * (capacity + 1 - len(counts))
    used = [0] * (capacity + 1)
    slots: dict[int, list[Slot]] = {}
    windows = 0
    largest = capacity - 1
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            break
        left[largest] -= 1
        taken = fill(left[: capacity - largest + 1], capacity - largest)
        left[largest] += 1
        taken[largest] = taken.get(largest, 0) + 1
        copies = min(left[n] // each for n, each in taken.items())
        total = sum(n * each for n, each in taken.items())
        for n, each in taken.items():
            left[n] -= copies * each
        cut = total & (total - 1) and total + spare < capacity
        bounds = [0]  # places where the line of items is cut
        for bit in range(capacity.bit_length() - 1, -1, -1):
            if cut and total >> bit & 1:
                bounds.append(bounds[-1] + (1 << bit))
        at = 0
        for n in sorted(taken, reverse=True):
            if not cut:
                slots.setdefault(n, []).append(Slot(used[n], taken[n], windows, at))
                used[n] += copies * taken[n]
                at += n * taken[n]
                continue
            for _ in range(taken[n]):
                parts = []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    low, high = max(a, at), min(b, at + n)
                    if low < high:
                        parts.append((low - at, high - low, windows + i, low - a))
                slots.setdefault(n, []).append(Slot(used[n], 1, 0, 0, len(bounds) - 1, tuple(parts)))
                used[n] += copies
                at += n
        windows += copies * max(1, len(bounds) - 1)
    return slots, windows


def place(slots: list[Slot], firsts: np.ndarray, number: int, length: int) -> list[tuple[int, int, int, int]]:
    """Parts (start, length, window, offset) of item ``number`` of a length."""
    slot = slots[int(np.searchsorted(firsts, number, "right")) - 1]
    copy, nth = divmod(number - slot.first, slot.each)
    if slot.cuts:
        return [(a, n, w + copy * slot.stride, o) for a, n, w, o in slot.cuts]
    return [(0, length, slot.window + copy, slot.offset + nth * length)]


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    remember: bool = True,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of packed sequences.

    A document is its ids and ``end_id``. It is cut into full windows and a tail; tails are packed by
    minimum bin slack. ``ids`` are little-endian unsigned 32-bit integers. Sequences are numbered from
    0 without gaps, full ones first. Text NULL or empty is the end id alone. Repeated rows and rows
    with a NULL key are documents of their own. An empty table gives no rows.

    Workers remember the ids of pieces of text from task to task; with ``remember`` False they give that memory
    back after each task, for jobs in which the same workers have other things to do.

    The driver sees the histogram of the tail lengths only, at most ``capacity`` numbers, and plans
    patterns from it. Items of a length are numbered by task and place in the task, so no length,
    however frequent, meets in one task.
    """
    rows = docs.select(column(key).alias("doc_id"), column(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    key_kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        numbers = [0] * (capacity + 1)
        for batch in batches:
            owner, starts, ids, totals, places = [], [], [], [], []
            for i, value in enumerate(encode.many(batch.column("text").to_pylist(), GROUP if remember else GROUP // 4)):
                own = value + end
                total = len(own) // 4
                for start in range(0, total, capacity):
                    piece = own[4 * start : 4 * (start + capacity)]
                    n = len(piece) // 4
                    owner.append(i)
                    starts.append(start)
                    ids.append(piece)
                    totals.append(total)
                    places.append(numbers[n])
                    numbers[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()),
                    pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(totals, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(places, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "place"],
            )
        if not remember:
            encode.forget()

    with arrow_rows(docs.sparkSession, 2000):
        pieces = staged(
            rows.mapInArrow(
                cut, f"doc_id {key_kind}, start long, length long, ids binary, doc_tokens long, task int, place long"
            ),
            "pieces",
        )
    # One row for each task and length; the sums run over the tasks of one length.
    per_task = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "histogram")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = [0] * (capacity + 1)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots, _ = plan(counts[:capacity], capacity)
    full = counts[capacity]
    if full:
        slots[capacity] = [Slot(0, 1, -full, 0)]
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        firsts = {n: np.array([s.first for s in found]) for n, found in own.items()}
        for batch in batches:
            take, starts, lengths, ids, windows, offsets = [], [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("start", "length", "ids", "number"))
            for i, (start, length, value, number) in enumerate(zip(*columns, strict=True)):
                for low, n, window, offset in place(own[length], firsts[length], number, length):
                    take.append(i)
                    starts.append(start + low)
                    lengths.append(n)
                    ids.append(value[4 * low : 4 * (low + n)])
                    windows.append(full + window)
                    offsets.append(offset)
            index = pa.array(take, pa.int64())
            long = [pa.array(c, pa.int64()) for c in (starts, lengths, windows, offsets)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(index), long[0], long[1], pa.array(ids, pa.binary()),
                    batch.column("doc_tokens").take(index), long[2], long[3],
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return (
        pieces.join(offsets, ["task", "length"])
        .select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("before") + F.col("place")).alias("number"))
        .mapInArrow(
            put,
            f"doc_id {key_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
        )
    )
