"""Best-fit packing of documents into sequences, after dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Pieces of one length are alike, so the
instance is a histogram of at most ``capacity`` lengths, however many documents there are; it is
the only thing the driver sees. On it the reduction fixes, for good, the bins that dominate every
other bin of their longest piece: a full piece alone; two pieces that fill the bin; a piece no
other fits with; a piece with the longest that fits, where no two fit. What is left is packed by
best fit, longest first, whole classes at a time. Ranks within a length, taken by a distributed
range sort, say which piece goes where.

Cases: null or empty text is its end id alone; equal rows are separate documents; null ids are
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tokens import crc, encoder, slices, with_end
from tillroll.operators.scale import running_total
from tillroll.plans.staging import stage

CAPACITY = 2048

#: (length, first rank, pieces, first sequence, pieces per sequence, offset)
Row = tuple[int, int, int, int, int, int]


def pieces_of(
    docs: DataFrame,
    vocabulary: str,
    end: int,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); ids themselves stay in the task."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, starts = with_end(*encoder(vocabulary).encode(batch.column(1)), end)
            rows = [
                (i, p, p * capacity, min(capacity, b - a - p * capacity))
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()))
                for p in range((b - a + capacity - 1) // capacity)
            ]
            row, piece, start, length = (np.array(c, np.int64) for c in zip(*rows))
            first = starts[row] + start
            sums = [crc(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start),
                 pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


class _Instance:
    """Pieces left per length, and the plan so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.plan: list[Row] = []
        self.sequences = 0

    def put(self, length: int, pieces: int, sequence: int, per_bin: int, offset: int) -> None:
        self.plan.append((length, self.used[length], pieces, sequence, per_bin, offset))
        self.used[length] += pieces
        self.left[length] -= pieces

    def open(self, bins: int) -> int:
        first, self.sequences = self.sequences, self.sequences + bins
        return first


def _reduce(it: _Instance) -> None:
    """Fix dominating bins, longest piece first."""
    for length in sorted(it.left, reverse=True):
        room = it.capacity - length
        while (n := it.left[length]) > 0:
            others = sorted(
                k for k, m in it.left.items() if k <= room and m > (k == length)
            )
            if not others:
                it.put(length, n, it.open(n), 1, 0)
                break
            best = others[-1]
            two = others[0] * 2 if it.left[others[0]] > 1 + (others[0] == length) else sum(others[:2])
            single = len(others) == 1 and it.left[others[0]] == 1 + (others[0] == length)
            if best != room and not single and two <= room:
                break  # several may fit: nothing is known to dominate
            if best == length:
                bins = n // 2
                it.put(length, 2 * bins, it.open(bins), 2, 0)
            else:
                bins = min(n, it.left[best])
                first = it.open(bins)
                it.put(length, bins, first, 1, 0)
                it.put(best, bins, first, 1, length)


def _best_fit(it: _Instance) -> None:
    """Best fit, longest first; bins with equal room form groups (first sequence, number)."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    for length in sorted(it.left, reverse=True):
        while (n := it.left[length]) > 0:
            room = min((r for r, g in rooms.items() if r >= length and g), default=None)
            if room is None:
                room = it.capacity
                bins = -(-n // (room // length))
                first = it.open(bins)
            else:
                first, bins = rooms[room].pop()
            each = room // length
            offset = it.capacity - room
            full = min(bins, n // each)
            if full:
                it.put(length, full * each, first, each, offset)
                rooms.setdefault(room - each * length, []).append((first, full))
            rest = min(n - full * each, each) if full < bins else 0
            if rest:
                it.put(length, rest, first + full, rest, offset)
                rooms.setdefault(room - rest * length, []).append((first + full, 1))
            over = bins - full - (1 if rest else 0)
            if over:
                rooms.setdefault(room, []).append((first + bins - over, over))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Row], int]:
    """Where the pieces of each length go, and how many sequences there are."""
    it = _Instance(counts, capacity)
    _reduce(it)
    _best_fit(it)
    return it.plan, it.sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    staged = stage(pieces, "pieces")
    # at most `capacity` rows
    counts = {r["length"]: r["count"] for r in staged.groupBy("length").count().collect()}
    plan, _ = plan_bins(counts, capacity)
    below, total = {}, 0
    for length in sorted(counts):
        below[length], total = total, total + counts[length]
    table = spark.createDataFrame(
        [(n, below[n] + first, below[n] + first + m, s, e, o) for n, first, m, s, e, o in plan],
        "len long, lo long, hi long, seq long, each long, off long",
    )
    order = [F.col(c).asc_nulls_first() for c in ("length", "doc_id", "piece", "ids_crc32")]
    ranked = running_total(staged, order, "length").withColumn("rank", F.col("rank") - 1)
    at = F.col("rank") - F.col("lo")
    # the plan follows from the histogram alone: its size is bounded by the capacity
    return ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("len")) & F.col("rank").between(F.col("lo"), F.col("hi") - 1),
    ).select(
        *pieces.columns,
        (F.col("seq") + F.floor(at / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("off") + at % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, end: int, capacity: int = CAPACITY, **names
) -> DataFrame:
    return pack(pieces_of(docs, vocabulary, end, capacity, **names), capacity)
