"""Document fingerprints by locally consistent parsing.

A text is a string of names, at first its code points. A level turns runs of one name into one
name, then tosses coins deterministically: each name is replaced, three times, by the place and
value of the lowest bit in which it differs from its left neighbour, which leaves a few colours
and no two equal neighbours. Local maxima of the colours begin phrases, and a phrase is named by a
hash of the names in it. Borders depend on a few names to either side only, so equal substrings
get equal phrases inside, wherever they stand. Levels go on until one name is left.

The fingerprint is a sketch of the set of names of all levels from the second on (and of the last
level, for the shortest texts): every name falls into one of ``SLOTS`` slots, each slot keeps 16
bits of its least name. Likeness is the share of slots that agree, among those either text fills.

Cases: null text is empty; the empty text has the empty sketch, like itself and nothing else;
equal texts have equal fingerprints; ids in ascending order, nulls first, equal ids in text order;
one row alone is its own next; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import partitions
from tillroll.llm.tokens import slices

SLOTS = 64
TOSSES = 3
FIRST_LEVEL = 2
_SLICE = 128 << 10
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _merge(names: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name every stretch that starts where ``begin`` is set, in order of its names."""
    at = np.flatnonzero(begin)
    place = np.arange(len(names), dtype=np.int64) - np.repeat(at, np.diff(np.append(at, len(names))))
    salted = _mix(names + _C * (place.astype(np.uint64) + np.uint64(1)))
    return _mix(np.add.reduceat(salted, at)), owner[at]


def _new(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where a text begins."""
    new = np.ones(len(names), bool)
    new[1:] = owner[1:] != owner[:-1]
    return new


def next_level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of all texts at once; ``owner`` ascends."""
    new = _new(names, owner)
    begin = new.copy()
    begin[1:] |= names[1:] != names[:-1]
    if not begin.all():
        at = np.flatnonzero(begin)
        length = np.diff(np.append(at, len(names))).astype(np.uint64)
        runs = names[at]
        names = np.where(length > 1, _mix(runs + _C * length), runs)
        owner, new = owner[at], new[at]
    colour = names
    for _ in range(TOSSES):
        apart = colour[1:] ^ colour[:-1]
        bit = np.bitwise_count(~apart & (apart - np.uint64(1))).astype(np.uint64)
        tossed = np.zeros(len(colour), np.uint64)
        tossed[1:] = 2 * (bit & np.uint64(63)) + ((colour[1:] >> (bit & np.uint64(63))) & np.uint64(1))
        # a first name is compared with nothing
        tossed[new] = colour[new] & np.uint64(1)
        colour = tossed
    peak = np.zeros(len(names), bool)
    if len(names) > 2:
        mid = colour[1:-1]
        peak[1:-1] = (mid > colour[:-2]) & (mid >= colour[2:]) & ~new[1:-1]
    begin = new | peak
    # a phrase of one name at the end of a text joins the phrase before it
    last = np.append(new[1:], True)
    begin &= ~(last & ~new)
    return _merge(names, owner, begin)


def sketches(texts: list[str], slots: int = SLOTS) -> np.ndarray:
    """The least name per slot of every text (texts x slots), all ones where a slot is empty."""
    table = np.full(len(texts) * slots, _EMPTY)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    names = np.frombuffer(joined, "<u4").astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), size)
    level = 0
    while len(names):  # a level at least halves what is longer than one name
        alone = _new(names, owner)
        alone &= np.append(alone[1:], True)  # the text is one name: its last level
        chosen = np.ones(len(names), bool) if level >= FIRST_LEVEL else alone
        salt = np.uint64(level * int(_A) & 0xFFFFFFFFFFFFFFFF)
        value = _mix(names[chosen] + salt)
        slot = (value % np.uint64(slots)).astype(np.int64)
        np.minimum.at(table, owner[chosen] * slots + slot, value)
        names, owner = names[~alone], owner[~alone]
        if len(names):
            names, owner = next_level(names, owner)
        level += 1
    return table.reshape(len(texts), slots)


def short(table: np.ndarray) -> np.ndarray:
    """16 bits per slot; zero says empty."""
    bits = ((table >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)).astype(">u2")
    bits[table == _EMPTY] = 0
    return bits


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: slots that agree over slots that either fills; two empty sketches are alike."""
    filled = (a != 0) | (b != 0)
    same = ((a == b) & filled).sum(axis=1)
    total = filled.sum(axis=1)
    return np.where(total == 0, 1.0, same / np.maximum(total, 1))


def edited_text(text: str, following: str) -> str:
    """The second half replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: pa.Array, texts: list[str], n: int) -> pa.RecordBatch:
    """Rows of the first ``n`` texts; text i + 1 follows text i."""
    edited = [edited_text(a, b) for a, b in zip(texts[:n], texts[1:])]
    own, other = short(sketches(texts)), short(sketches(edited))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts[:n]], pa.int64()),
         pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
         pa.array([r.tobytes().hex() for r in own[:n]], pa.string()),
         pa.array([r.tobytes().hex() for r in other], pa.string()),
         pa.array(likeness(own[:n], other)), pa.array(likeness(own[:n], own[1 : n + 1]))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"],
    )


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next one.

    Rows are range-split on id. The first row of each range (one per range, found on ids alone)
    is sent to the range before it as well, the very first to the last, so every text meets the
    next one without a join of texts.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    parts = partitions(spark)
    ids = chosen.select("doc_id")
    # range borders: one id per range
    bounds = (
        ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first"))
        .orderBy("p")
        .select("first.doc_id")
    )
    firsts = [r[0] for r in bounds.collect()]
    if not firsts:
        firsts = [None]
    top = len(firsts) - 1
    # the last range whose first id is not above the row's: first among every k-th border, then
    # among the k - 1 behind it
    k = max(1, math.isqrt(len(firsts)))
    borders = [F.lit(f).cast(kind) for f in firsts]
    coarse, table = F.array(*borders[::k]), F.array(*borders)

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda f: f.isNull() | (f <= F.col("doc_id"))))

    block = F.greatest(below(coarse) - 1, F.lit(0)) * k
    inside = F.slice(table, block + 1, F.lit(k))
    place = F.greatest(block + below(inside) - 1, F.lit(0))
    own = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place).cast("int")
    opens = F.get(table, own).eqNullSafe(F.col("doc_id"))
    before = F.when(own == 0, top).otherwise(own - 1).cast("int")
    here = F.struct(own.alias("part"), F.lit(False).alias("extra"))
    there = F.struct(before.alias("part"), F.lit(True).alias("extra"))
    places = F.when(opens, F.array(here, there)).otherwise(F.array(here))
    split = (
        chosen.withColumn("at", F.explode(places))
        .select("at.part", (F.col("at.extra") & (F.col("at.part") == top)).alias("wraps"),
                "at.extra", "doc_id", "text")
        .repartitionById(len(firsts), "part")
        .sortWithinPartitions("part", "wraps", F.col("doc_id").asc_nulls_first(),
                              F.col("text").asc_nulls_first())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every row waits for its follower; an extra row only follows
        held: tuple | None = None
        done = False
        for batch in slices(batches, 4, _SLICE):
            if done:
                continue
            extra = batch.column(2).to_pylist()
            ids = batch.column(3)
            texts = [t or "" for t in batch.column(4).to_pylist()]
            n = next((i for i, x in enumerate(extra) if x), len(texts))
            done = n < len(texts)
            ids, texts = ids.slice(0, n), texts[: n + 1]
            if held:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            if done:
                if len(ids):
                    yield _compare(ids, texts, len(ids))
                held = None
            else:
                if len(ids) > 1:
                    yield _compare(ids.slice(0, len(ids) - 1), texts, len(ids) - 1)
                held = (ids.slice(len(ids) - 1, 1), texts[-1])
        if held:
            raise RuntimeError("a range without the first row of the next")

    return split.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
