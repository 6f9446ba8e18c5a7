"""Hard negatives: other-label vectors that score just below an anchor's positives.

Candidates are dealt out by hash into blocks of about ``block`` rows; each becomes a cover tree
once (`cover_tree`), staged as one row. Anchors are a stated share of the rows; packed a few
hundred to a row they visit every tree as a stream, so a task holds one tree and one pack. Pass one
finds positives, pass two the negatives of all windows of an anchor in one descent. A block sends
back at most k rows per anchor and window, and a window function keeps the first k of all.

Cases: rows with a null label, a null vector or a null or non-finite component take no part; a
null id is no anchor, keeps its label and comes last among ties; shorter vectors count as padded
with zeros; repeated rows are rows of their own, and an anchor's positives leave out only the
anchor's own row; an empty table, no anchor, no positive or no row in a window: no result row.
Scores are exact while they fit 64 bits and an error beyond. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.cover_tree import CoverTree
from tillroll.llm.cover_tree import Window as Scores
from tillroll.plans.staging import stage

POSITIVES = 5
NEGATIVES = 5
#: a negative scores from LOW to HIGH hundredths of the positive's score
LOW, HIGH = 80, 100
SCALE = 256
BLOCK = 4096
PACK = 512

_FOUND = (
    "anchor bigint, anchor_id bigint, label bigint, positive bigint, positive_id bigint, "
    "positive_score bigint, other bigint, other_id bigint, score bigint"
)
_TYPES = [pa.int64()] * 9
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]


def usable(rows: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """(row, id, label, v) of the rows that take part, each with a number of its own."""
    chosen = rows.select(
        F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = chosen.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    return stage(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _vectors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Floored multiples as integers in doubles, one row per vector, padded with zeros."""
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    out = np.zeros((len(column), width))
    sizes = np.diff(ends)
    at = np.repeat(np.arange(len(column)), sizes), np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    out[at] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale))
    return out


def _narrow(points: np.ndarray) -> np.ndarray:
    """The smallest type that holds all values; huge ones stay doubles."""
    most = np.abs(points).max(initial=0.0)
    for kind in (np.int8, np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return points.astype(kind)
    return points


def _trees(rows: DataFrame, blocks: int, width: int, scale: int) -> DataFrame:
    """(block, kind, data): one cover tree per block."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block = [], None
        for batch in batches:
            if batch.num_rows:
                block = batch.column(0)[0].as_py()
                parts.append(batch)
        if parts:
            own = pa.Table.from_batches(parts).combine_chunks()
            column = {n: own.column(n).combine_chunks() for n in own.column_names}
            tree = CoverTree(
                _narrow(_vectors(column["v"], width, scale)),
                column["row"].to_numpy(),
                column["id"].fill_null(0).to_numpy(),
                column["id"].is_null().to_numpy(zero_copy_only=False),
                column["label"].to_numpy(),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([tree.dump()], pa.binary())],
                names=["block", "kind", "data"],
            )

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "row", "id", "label", "v").repartitionById(
        blocks, F.col("block")
    )
    return stage(dealt.mapInArrow(plant, "block int, kind int, data binary"), "trees")


def _visits(trees: DataFrame, queries: DataFrame, blocks: int, pack: int, visit: Callable) -> DataFrame:
    """Every query row meets every tree; ``visit(tree, table)`` yields result tuples."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, pack):
                part = pa.Table.from_batches([batch.slice(at, pack)]).combine_chunks()
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as sink:
                    sink.write_table(part)
                data = pa.array([out.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([data], names=["data"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if kind == 0:
                    tree = CoverTree.load(data.as_py())
                    continue
                if tree is None:  # a block without rows
                    continue
                out = list(visit(tree, pa.ipc.open_stream(data.as_py()).read_all()))
                if out:
                    made = [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]
                    yield pa.RecordBatch.from_arrays(made, names=_NAMES)

    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    packs = queries.mapInArrow(packed, "data binary").select(
        F.explode(every).alias("block"), F.lit(1).alias("kind"), "data"
    )
    met = trees.union(packs).repartitionById(blocks, F.col("block"))
    return met.sortWithinPartitions("kind").mapInArrow(search, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows per key: higher scores, then smaller ids, none last."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc("score"), F.asc_nulls_last("other_id"), F.asc("other")
    )
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _results(window: Scores, *head) -> Iterator[tuple]:
    for down, unnamed, other_id, other in window.found:
        yield (*head, other, None if unnamed else other_id, -down)


def mine(
    rows: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block: int = BLOCK,
    pack: int = PACK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id`` (the vector's id); ``label`` a column of
    ``rows``. Vectors are compared by the inner product of floor(scale * component).
    """
    label = F.col(label) if isinstance(label, str) else label
    used = usable(rows, vec_id, label, vector)
    count, width = used.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, width = max(1, -(-count // block)), width or 0
    trees = _trees(used, blocks, width, scale)
    asked = used.filter(anchors)

    def best_of_label(tree: CoverTree, table: pa.Table) -> Iterator[tuple]:
        points = _vectors(table.column("v").combine_chunks(), width, scale)
        columns = (table.column(n).to_pylist() for n in ("row", "id", "label"))
        for point, row, own_id, kind in zip(points, *columns):
            window = Scores(-np.inf, np.inf, positives, [])
            tree.search(point, row, kind, True, [window])
            yield from _results(window, row, own_id, kind, None, None, None)

    found = _visits(trees, asked.select("row", "id", "label", "v"), blocks, pack, best_of_label)
    best = stage(_first(found, ["anchor"], positives), "positives")
    one = F.struct("rank", "other", "other_id", "score")
    per_anchor = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(one).alias("best"))

    def in_windows(tree: CoverTree, table: pa.Table) -> Iterator[tuple]:
        points = _vectors(table.column("v").combine_chunks(), width, scale)
        columns = (table.column(n).to_pylist() for n in ("row", "id", "label", "best"))
        for point, row, own_id, kind, best in zip(points, *columns):
            windows = {
                p["score"]: Scores(-(-low * p["score"] // 100), high * p["score"] // 100, negatives, [])
                for p in best
            }
            open_ = [w for w in windows.values() if w.low <= w.high]
            tree.search(point, row, kind, False, open_)
            for p in best:
                head = (row, own_id, kind, p["rank"], p["other_id"], p["score"])
                yield from _results(windows[p["score"]], *head)

    with_best = asked.join(per_anchor, "row").select("row", "id", "label", "v", "best")
    found = _visits(trees, with_best, blocks, pack, in_windows)
    return _first(found, ["anchor", "positive"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same,
    list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND a.vec_id % 100 = 0
), positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id NULLS LAST) <= {POSITIVES}
)
SELECT p.anchor_id, p.other_id AS positive_id,
  row_number() OVER w::INTEGER AS rank, n.other_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n
  ON p.r = n.r AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
WINDOW w AS (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.other_id NULLS LAST)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
