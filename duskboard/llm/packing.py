"""Operator 2: packing of documents into training sequences, balanced by attention cost.

A document's tokens are cut into full sequences and a rest. The rests of a window go, longest first, to
the sequence with the lowest cost so far among those with room for it; the cost of a piece is linear
plus quadratic in its length. A window has exactly as much room as it has tokens: sequences of the full
length and, for what is left over, sequences of powers of two. If no sequence has room for the whole
piece, it is cut to fill the one with most room, and the remainder queues up again.

Every task packs the rows it reads, so nothing is shuffled, and a lost task packs the same rows anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from duskboard.llm.frames import id_and_text, slices
from duskboard.llm.tokens import END, REMEMBERED, worker_encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()), ("ids", pa.binary()),
])


def capacities(tokens: int, length: int) -> list[int]:
    """Sequences that hold so many tokens without padding: full ones, then descending powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: list[int], rooms: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) of every part; the rooms hold the lengths exactly."""
    left, used, costs = list(rooms), [0] * len(rooms), [0.0] * len(rooms)
    pieces = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(pieces)
    open_ = [(0.0, s) for s in range(len(rooms))]
    tight: list[tuple[int, int]] = []  # without room for the pieces so far, largest room first
    placed = []
    while pieces:
        minus, piece, start = heapq.heappop(pieces)
        n = -minus
        while tight and -tight[0][0] >= n:
            s = heapq.heappop(tight)[1]
            heapq.heappush(open_, (costs[s], s))
        while open_ and left[open_[0][1]] < n:
            s = heapq.heappop(open_)[1]
            heapq.heappush(tight, (-left[s], s))
        s = heapq.heappop(open_ or tight)[1]
        take = min(n, left[s])
        placed.append((piece, start, take, s, used[s]))
        used[s] += take
        left[s] -= take
        costs[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(pieces, (take - n, piece, start + take))
        if left[s]:
            heapq.heappush(open_, (costs[s], s))
    return placed


def pack(
    docs: DataFrame,
    vocabulary: str,
    length: int = 1024,
    window_tokens: int = 4_000_000,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    remembered: int = REMEMBERED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: its document, place in it, ids (little-endian unsigned 32-bit), sequence and offset there.

    Every document ends with id 0, so an empty or null text is the one id 0. Repeated rows are packed as often
    as they come, null ids stay null, other columns are ignored, an empty table gives no rows. A document longer
    than a sequence fills sequences of its own first. ``window_tokens`` and ``remembered``, the parts of texts whose ids a worker
    remembers, bound a task's memory; windows cost no padding, as each is filled exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, remembered)
        sequence = TaskContext.get().partitionId() << 33
        rests, waiting, out, size = [], 0, [], 0

        def cost(n: int) -> float:
            return linear * n + quadratic * n * n

        def flush() -> None:
            nonlocal sequence, rests, waiting, size
            rooms = capacities(waiting, length)
            for piece, start, n, s, offset in balance([len(r[3]) // 4 for r in rests], rooms, linear, quadratic):
                doc, at, total, ids = rests[piece]
                out.append((doc, at + start, n, total, sequence + s, offset, cost(n), ids[4 * start : 4 * (start + n)]))
            size += 4 * waiting
            sequence += len(rooms)
            rests, waiting = [], 0

        def rows(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), ARROW, strict=True)], schema=ARROW)

        for batch in slices(batches, 4 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += END
                total, start = len(ids) // 4, 0
                for start in range(0, total - length + 1, length):
                    out.append((doc, start, length, total, sequence, 0, cost(length), ids[4 * start : 4 * (start + length)]))
                    sequence += 1
                    size += 4 * length
                start = total - total % length
                if start < total:
                    rests.append((doc, start, total, ids[4 * start :]))
                    waiting += total - start
                if waiting >= window_tokens:
                    flush()
            if size > 8 << 20:
                for i in range(0, len(out), 4096):
                    yield rows(out[i : i + 4096])
                out, size = [], 0
        flush()
        for i in range(0, len(out), 4096):
            yield rows(out[i : i + 4096])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
