"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight
bytes: they share at least five bytes, position by position. A list per single byte would hold a
256th of all fingerprints, so lists are keyed by four positions at once: fourteen sets of four
such that any five positions contain one of them. Inside a list the shared positional bytes of a
pair are tallied, pairs below the guaranteed minimum go, the rest is verified bit by bit.

A list never emits its pairs: it emits links that join its members the way the verified pairs do,
fewer than it has members. Lists beyond ``block`` members are cut into blocks, and every two
blocks meet in a task of their own, so no task holds an unbounded list and no pair is missed.

Cases: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; equal fingerprints are one node, however many rows; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import partitions, whole_rows
from tillroll.llm.graph import components
from tillroll.llm.tokens import slices
from tillroll.plans.staging import stage

SHINGLE = 3
BITS = 3
SEED = 42
BLOCK = 4096


def _positions() -> list[tuple[int, ...]]:
    """Sets of four of eight positions; any five positions contain one of them.

    The halves, and for each way to split a half into two pairs, each of its pairs with each pair
    of the same split of the other half: of five positions four lie in a half, or three (which
    hold a pair of every split) and two.
    """
    halves = (range(4), range(4, 8))
    sets = [tuple(h) for h in halves]
    for partner in (1, 2, 3):
        splits = []
        for h in halves:
            first = (h[0], h[partner])
            splits.append((first, tuple(p for p in h if p not in first)))
        sets += [a + b for a in splits[0] for b in splits[1]]
    return sets


POSITIONS = _positions()
assert all(any(set(s) <= set(five) for s in POSITIONS) for five in combinations(range(8), 5))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        first = (end - size + 1).tolist()
        last = end[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(first, last)]
    ones = np.zeros(64, np.int64)
    array = np.array(hashes, ">u8")
    for at in range(0, len(array), 1 << 14):
        part = array[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(array)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` in struct ``doc``, and ``fp`` (the bits as a signed long)."""
    chosen = whole_rows(docs, text=F.col(text))
    kind = chosen.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bits = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(bits, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed)], names=["doc", "fp"]
            )

    return chosen.mapInArrow(run, f"doc {kind}, fp bigint")


def _postings(fps: DataFrame) -> DataFrame:
    """(list, key, fp): the fingerprint in each of its fourteen lists."""

    def key(positions: tuple[int, ...]):
        mask = sum(0xFF << (8 * (7 - p)) for p in positions)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        return F.col("fp").bitwiseAND(F.lit(signed))

    lists = [F.struct(F.lit(i).alias("list"), key(p).alias("key")) for i, p in enumerate(POSITIONS)]
    return fps.select("fp", F.explode(F.array(*lists)).alias("at")).select("at.list", "at.key", "fp")


def _bytes(fps: np.ndarray) -> np.ndarray:
    return fps.astype(">i8").view(np.uint8).reshape(-1, 8)


def links_within(fps: np.ndarray, split: int, bits: int) -> list[tuple[int, int]]:
    """Links that join ``fps`` the way all close pairs (a pair across ``split``, or any if 0) do."""
    n = len(fps)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    left, right = (range(split), fps[split:]) if split else (range(n), fps)
    columns = _bytes(right)
    unsigned = right.view(np.uint64)
    for i in left:
        after = 0 if split else i + 1
        shared = (columns[after:] == _bytes(fps[i : i + 1])).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - bits) + after
        apart = np.bitwise_count(unsigned[near] ^ fps[i : i + 1].view(np.uint64))
        for j in near[apart <= bits].tolist():
            a, b = root(i), root(j + split)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(fps[i]), int(right[j])))
    return found


def _links(postings: DataFrame, bits: int, parts: int) -> DataFrame:
    """Links of every (list, key, i, j) group; ``side`` says which block a member is from."""
    ordered = postings.repartition(parts, "list", "key", "i", "j").sortWithinPartitions(
        "list", "key", "i", "j", "side", "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        links: list[tuple[int, int]] = []

        def group(rows: np.ndarray) -> None:
            cross = rows[0, 2] != rows[0, 3]
            split = int((rows[:, 4] == 0).sum()) if cross else 0
            if len(rows) > 1 and not (cross and split in (0, len(rows))):
                links.extend(links_within(np.ascontiguousarray(rows[:, 5]), split, bits))

        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1:
                    group(rows[a:b])
            held = [rows[bounds[-1] :]] if len(rows) else []
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"]
                )
                links.clear()
        if held:
            group(held[0])
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"]
                )

    return ordered.select("list", "key", "i", "j", "side", "fp").mapInArrow(run, "a bigint, b bigint")


def close_links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp`` that differ in at most ``bits`` bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the lists hold every pair of up to three differing bits")
    spark = fps.sparkSession
    parts = partitions(spark)
    postings = _postings(fps)
    sizes = postings.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stage(
        sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "posting-sizes"
    )
    # only lists with a possible pair go on
    cut = postings.join(sizes.drop("n"), ["list", "key"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")),
    )
    met = cut.withColumn("pair", F.explode(others)).select(
        "list", "key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"),
        F.when(own == F.col("pair.i"), 0).otherwise(1).alias("side"), "fp",
    )
    return _links(met, bits, parts)


def _grouped(marked: DataFrame, bits: int) -> DataFrame:
    """Adds root (a fingerprint of the component) and component_id, its smallest id."""
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(close_links(distinct.select("fp"), bits))
    classed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        distinct["fp"].alias("of"), "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stage(classed.join(smallest, "root").select("of", "root", "component_id"), "classes")
    return marked.join(table, marked["fp"] == table["of"]).drop("of")


def _marked(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = fingerprints(narrow, "text", shingle)
    return stage(found.select(F.col("doc.doc_id").alias("doc_id"), "fp"), "fingerprints")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    bits: int = BITS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    A component none of whose rows has an id has a null component_id.
    """
    return _grouped(_marked(docs, doc_id, text, shingle), bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    bits: int = BITS,
) -> DataFrame:
    """One row of each component, that of its smallest id, with the columns it came with.

    The ids that go are matched to the documents; texts move only where that list is too large
    to broadcast. Rows that share an id, or have none, are told apart by fingerprint and text.
    """
    found = stage(_grouped(_marked(docs, doc_id, text, shingle), bits), "components")
    per_id = found.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.min("component_id").alias("component_id")
    )
    shared = per_id.filter("rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("other"))
    leaving = per_id.filter("rows > 1 OR doc_id <> component_id").select(
        F.col("doc_id").alias("other")
    )
    rows = whole_rows(docs, id=F.col(doc_id), text=F.col(text))
    single = rows.filter("id IS NOT NULL").join(
        stage(leaving, "leaving-ids"), F.col("id") == F.col("other"), "left_anti"
    )
    several = rows.join(
        stage(shared, "shared-ids"), F.col("id").eqNullSafe(F.col("other")), "left_semi"
    )
    classes = found.select(
        F.col("doc_id").alias("other"), F.col("fp").alias("other_fp"), "root", "component_id"
    ).distinct()
    first = Window.partitionBy("root").orderBy("fp", F.col("doc.text").asc_nulls_first())
    chosen = (
        fingerprints(several, "text", shingle)
        .join(classes, F.col("doc.id").eqNullSafe(F.col("other")) & (F.col("fp") == F.col("other_fp")))
        .filter(F.col("doc.id").eqNullSafe(F.col("component_id")))
        .withColumn("place", F.row_number().over(first))
        .filter("place = 1")
        .select("doc.doc")
    )
    return single.select("doc").union(chosen).select("doc.*")
