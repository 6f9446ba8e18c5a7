"""Token ids as Parquet files in ascending document order.

One row per document: id, list of token ids, their number. Files are ranges of ids, so file and
row order is document order. Token columns are dictionary-encoded (the vocabulary is small),
counts and ids delta-encoded by the version 2 pages; row groups and pages are kept small and
carry statistics, so a reader takes the rows of an id range, or the counts without the tokens.

Cases: null or empty text is the end id alone; null ids come first; equal ids lie next to each
other in text order; an empty table gives files without rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import partitions
from tillroll.llm.tokens import crc, encoder, slices, with_end

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def encoded(
    docs: DataFrame, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row, in the order and partitions of ``docs``."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, starts = with_end(*encoder(vocabulary).encode(batch.column(1)), end)
            lists = pa.ListArray.from_arrays(starts.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(np.diff(starts), pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )
            # before the next slice: Arrow would keep what this one took
            pa.default_memory_pool().release_unused()

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint")


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end: int,
    doc_id: str = "doc_id",
    text: str = "text",
    layout: dict[str, str] | None = None,
) -> None:
    """Write the files. Texts are range-split (smaller than their ids), then encoded in place."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(partitions(docs.sparkSession), order[0])
        .sortWithinPartitions(*order)
    )
    encoded(ranged, vocabulary, end).write.options(**LAYOUT | (layout or {})).parquet(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens) of the rows that meet ``where``; pages without any are skipped."""
    rows = spark.read.parquet(path)
    return rows if where is None else rows.filter(where)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without touching the token pages."""
    return with_start(spark.read.parquet(path).select("doc_id", "n_tokens", *_place()))


def _place() -> list[Column]:
    return [
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ]


def with_start(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Replace (file, row) by ``start``, the ids of all documents before.

    One file is one range. Files go by the number of the task in their name, which has five
    digits or more, so names as such do not sort. ``counts`` (file, n_tokens) are the same rows
    where ``rows`` cost more to read a second time.
    """
    counts = rows if counts is None else counts
    per_file = counts.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    task = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    ahead = Window.orderBy(task, "file").rowsBetween(Window.unboundedPreceding, -1)
    before = per_file.select(
        F.col("file").alias("of_file"), F.coalesce(F.sum("in_file").over(ahead), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    # one row per file
    return (
        rows.withColumn("here", here)
        .join(before, F.col("file") == F.col("of_file"))
        .withColumn("start", (F.col("before") + F.col("here")).cast("bigint"))
        .drop("file", "row", "here", "of_file", "before")
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all from the files."""
    files = spark.read.parquet(path)
    rows = files.select("doc_id", "ids", *_place())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            sums = [crc(ids[e - n : e]) for e, n in zip(ends, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(size, pa.int64()),
                 pa.array(sums, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    read = rows.mapInArrow(
        run, f"doc_id {kind}, file string, row bigint, n_tokens bigint, ids_crc32 bigint"
    )
    counts = files.select("n_tokens", _place()[0])
    return with_start(read, counts).select("doc_id", "start", "n_tokens", "ids_crc32")
