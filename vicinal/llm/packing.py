"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are cut to full windows and a rest. The rests of a group are dealt to
the group's windows by largest differencing: a partial partition starts with one
rest alone in its window; again and again the two partial partitions with the
largest imbalance are merged, the fullest windows of one with the emptiest of
the other. That gives near-equal windows; when one exceeds the capacity, the
count of windows rises and the group is dealt again. A few rests of each group
are cut to small slivers first, with which differencing levels the windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Windows of a group, and the tokens that a group leaves free for levelling.
GROUP_WINDOWS, GROUP_SLACK = 40, 64
#: One rest in so many is cut to slivers, of these sizes in turn.
SLIVER_EVERY, SLIVERS = 16, (64, 32, 16, 8, 4, 2, 1, 1)


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Items of each window after largest differencing of all sizes to so many windows."""
    if windows == 1 or len(sizes) == 0:
        return [list(range(len(sizes)))] + [[] for _ in range(windows - 1)]
    left, right, heap = [], [], []
    for i, s in enumerate(sizes.tolist()):
        loads, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        loads[0], nodes[0] = s, i
        heap.append((-s, i, loads, nodes))
    heapq.heapify(heap)
    tick = made = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        loads, other = a + b[::-1], y[::-1]
        nodes = np.where(x < 0, other, x)
        meet = np.flatnonzero((x >= 0) & (other >= 0))
        left.extend(x[meet].tolist())
        right.extend(other[meet].tolist())
        nodes[meet] = made + np.arange(len(meet))
        made += len(meet)
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        tick += 1
        heapq.heappush(heap, (int(loads[-1] - loads[0]), tick, loads - loads[-1], nodes[order]))
    out = []
    for root in heap[0][3].tolist():
        items, stack = [], [root] if root >= 0 else []
        while stack:
            v = stack.pop()
            if v < len(sizes):
                items.append(v)
            else:
                stack += (left[v - len(sizes)], right[v - len(sizes)])
        out.append(sorted(items))
    return out


def level(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each window, none above the capacity, in as few windows as differencing levels them to."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if all(int(sizes[w].sum()) <= capacity for w in dealt):
            return [w for w in dealt if w]
        windows += 1


def _slivers(doc: int, start: int, size: int) -> Iterator[tuple[int, int, int]]:
    k = 0
    while size > 0:
        n = min(SLIVERS[k % len(SLIVERS)], size)
        yield doc, start, n
        start, size, k = start + n, size - n, k + 1


class _Group:
    """Rests that wait for their windows: (document, start, length) of each."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.total = capacity, [], 0
        self.full = GROUP_WINDOWS * capacity - GROUP_SLACK

    def add(self, doc: int, start: int, size: int) -> Iterator[list[list[tuple[int, int, int]]]]:
        """Takes a rest; yields the windows of each group that is full with it."""
        while size:
            n = min(size, self.full - self.total)
            self.items.append((doc, start, n))
            self.total, start, size = self.total + n, start + n, size - n
            if self.total == self.full:
                yield self.close()

    def close(self) -> list[list[tuple[int, int, int]]]:
        pieces = [p for i, x in enumerate(self.items) for p in (_slivers(*x) if i % SLIVER_EVERY == SLIVER_EVERY - 1 else [x])]
        dealt = level(np.array([p[2] for p in pieces], np.int64), self.capacity)
        self.items, self.total = [], 0
        return [[pieces[i] for i in w] for w in dealt]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most capacity tokens.

    A document's tokens are the ids of its whole text (null: empty) and end_id.
    Returns a row per piece: doc_id, start, length, ids (unsigned little-endian
    32-bit ids), doc_tokens, sequence_id, offset. Every token lies in one piece;
    pieces follow each other in a sequence without gaps. Repeated rows and ids
    are packed each for itself; an empty table gives no sequence. Sequences are
    made within a partition of docs, which need not be shuffled.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tool = encoder(tokenizer_path)
        serial = TaskContext.get().partitionId() << 33
        group, waiting = _Group(capacity), {}
        doc_ids, counts = [], []
        out = [[] for _ in names]

        def emit(number: int, start: int, size: int, ids: bytes, offset: int) -> None:
            for column, x in zip(out, (doc_ids[number], start, size, ids, counts[number], serial, offset), strict=True):
                column.append(x)

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return made

        def settle(windows: list[list[tuple[int, int, int]]]) -> None:
            nonlocal serial
            for window in windows:
                offset = 0
                for number, start, size in window:
                    first, rest = waiting[number]
                    emit(number, start, size, rest[4 * (start - first) : 4 * (start - first + size)], offset)
                    offset += size
                serial += 1

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for a, _, ids, bounds in tool.encode_column(batch.column("text")):
                for i in range(len(bounds) - 1):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    number, n = len(doc_ids), len(own) // 4
                    doc_ids.append(keys[a + i])
                    counts.append(n)
                    for start in range(0, n - capacity + 1, capacity):
                        emit(number, start, capacity, own[4 * start : 4 * (start + capacity)], 0)
                        serial += 1
                    start = n - n % capacity
                    if start < n:
                        waiting[number] = (start, own[4 * start :])
                        for windows in group.add(number, start, n - start):
                            settle(windows)
                            kept = {x[0] for x in group.items}
                            kept.add(number)
                            waiting = {k: v for k, v in waiting.items() if k in kept}
                if len(out[0]) > 5000:
                    yield flush()
        if group.items:
            settle(group.close())
        yield flush()

    return rows.mapInArrow(run, schema)
